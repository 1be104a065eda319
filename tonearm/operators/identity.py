"""Reviews and files matched with confidence by stated keys; parked reviews kept once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import text
from tonearm.operators.merge import label_by_hand
from tonearm.plans.staging import numbered, stage


def code(isrc: Column) -> Column:
    c = F.upper(F.trim(isrc))
    return F.when(c != "", c)


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"artist_key": text.artist_key(F.col("artist")), "title_key": text.title_key(F.col("title")), "isrc_key": code(F.col("isrc"))})


def find_match(reviews: DataFrame, tracks: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(track_id, review_id, confident, reason) for each file with a review of its identity.

    An equal ISRC is confident (the latest review); else equal names: exactly one within the length tolerance is confident, none is ``duration-mismatch``, several ``multiple-name``.
    Unknown lengths agree.
    """
    r = keyed(reviews).select(F.col("id").alias("review_id"), "artist_key", "title_key", "isrc_key", F.col("duration_s").cast("double").alias("rd"))
    t = keyed(tracks).select(F.col("id").alias("track_id"), "artist_key", "title_key", "isrc_key", F.col("duration_s").cast("double").alias("td"))
    by_code = t.join(r.select("isrc_key", "review_id"), "isrc_key").groupBy("track_id").agg(F.max("review_id").alias("review_id")).select("track_id", "review_id", F.lit(True).alias("confident"), F.lit("isrc").alias("reason"))
    near = F.coalesce(F.abs(F.col("rd") - F.col("td")) <= tolerance, F.lit(True))
    named = t.where("artist_key <> '' and title_key <> ''").join(by_code, "track_id", "left_anti").join(r.drop("isrc_key"), ["artist_key", "title_key"])
    counts = named.groupBy("track_id").agg(F.sum(near.cast("int")).alias("k"), F.max(F.when(near, F.col("review_id"))).alias("close"), F.max("review_id").alias("latest"))
    by_name = counts.select("track_id", F.when(F.col("k") == 0, F.col("latest")).otherwise(F.col("close")).alias("review_id"), (F.col("k") == 1).alias("confident"), F.when(F.col("k") == 1, "name+duration").when(F.col("k") == 0, "duration-mismatch").otherwise("multiple-name").alias("reason"))
    return by_code.unionByName(by_name)


def library_match(asked: DataFrame, tracks: DataFrame) -> DataFrame:
    """(id, path) of the file an (isrc, artist, title) means: exact ISRC (lowest id), else the only file of that artist and title, else null."""
    by_code = tracks.where("isrc is not null").groupBy("isrc").agg(F.min_by("path", "id").alias("p1"))
    by_name = tracks.where("artist is not null and title is not null").groupBy(F.lower("artist").alias("a"), F.lower("title").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("p2")).where("n = 1")
    j = asked.join(by_code, "isrc", "left").join(by_name, (F.lower(asked["artist"]) == F.col("a")) & (F.lower(asked["title"]) == F.col("t")), "left")
    return j.select("id", F.coalesce("p1", "p2").alias("path"))


def parked_once(reviews: DataFrame) -> DataFrame:
    """Reviews of one identity folded into the first: the newest note and source, the newest known value of the rest, the first capture time.

    The identity is the ISRC where there is one, else artist and title key.
    """
    k = keyed(reviews)
    identity = F.coalesce(F.concat(F.lit("i|"), F.col("isrc_key")), F.concat_ws("|", F.lit("n"), "artist_key", "title_key"))
    at = F.struct("captured_at", "id")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return k.groupBy(identity.alias("identity")).agg(F.min("id").alias("id"), F.max_by("note", at).alias("note"), F.max_by("source", at).alias("source"), *(newest(c) for c in ("isrc", "rating", "role", "duration_s")), F.min("captured_at").alias("captured_at"), F.count(F.lit(1)).alias("n"))


def add_reviews(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` parked reviews with ``new`` ones added: a second review of one identity changes the row that is there.

    The identity of a waiting review is looked for by ISRC first, then by artist and title key, the newest row first. The note and source are overwritten, other fields where the new one
    knows them; the rest gets ids above the greatest. New reviews of one identity are folded first, and of those that meet one row the newest counts.
    """
    columns = stored.columns
    fresh = parked_once(new).join(new.select("id", *[c for c in columns if c not in ("id", "note", "source", "isrc", "rating", "role", "duration_s", "captured_at")]), "id")
    k = keyed(fresh)
    waiting = keyed(stored.where("status = 'pending'"))
    newest = F.struct("captured_at", "id")
    by_code = waiting.where("isrc_key is not null").groupBy("isrc_key").agg(F.max_by("id", newest).alias("c"))
    by_name = waiting.groupBy("artist_key", "title_key").agg(F.max_by("id", newest).alias("m"))
    met = k.join(by_code, "isrc_key", "left").join(by_name, ["artist_key", "title_key"], "left").withColumn("at", F.coalesce("c", "m"))
    known = [c for c in ("rating", "role", "isrc", "spotify_id", "album", "duration_s") if c in columns]
    change = met.where("at is not null").groupBy("at").agg(F.max(F.struct("captured_at", F.col("id").alias("by"), "note", "source", *known)).alias("u")).withColumnRenamed("at", "id")
    j = stored.join(change, "id", "left")
    hit = F.col("u").isNotNull()
    put = {c: F.when(hit, F.col("u." + c)).otherwise(F.col(c)) for c in ("note", "source")} | {c: F.coalesce(F.col("u." + c), F.col(c)) for c in known}
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = numbered(met.where("at is null").select(*(c for c in columns if c not in ("id", "status")), F.lit("pending").alias("status")), [F.col("captured_at"), F.col("artist"), F.col("title")], "id", top)
    return j.withColumns(put).select(*columns).unionByName(added.select(*columns))


def mark_applied(reviews: DataFrame, applied: DataFrame) -> DataFrame:
    """``reviews`` with those in ``applied`` (id, path) taken out of the waiting ones."""
    a = applied.groupBy("id").agg(F.min("path").alias("__path"))
    j = reviews.join(a, "id", "left")
    return j.withColumns({"status": F.when(F.col("__path").isNotNull(), "applied").otherwise(F.col("status")), "matched_path": F.coalesce("__path", "matched_path")}).select(*reviews.columns)


def drain(tracks: DataFrame, reviews: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Waiting reviews written onto the files that arrived (their ``path``), where the match is confident: (tracks, reviews) after it.

    A file labelled by hand keeps its label and leaves the review waiting; a review that means several files goes to the one of lowest id. A review's own ``taste_vec`` is written if it has that column, else none.
    """
    open_ = tracks.join(arrived.select("path").distinct(), "path", "left_semi").where("coalesce(taste_source, '') <> 'manual'")
    waiting = reviews.where("status = 'pending'")
    met = find_match(waiting, open_).where("confident").join(open_.select(F.col("id").alias("track_id"), "path"), "track_id")
    one = stage(met.groupBy("review_id").agg(F.min_by("path", "track_id").alias("path")), "met")
    vec = F.col("taste_vec") if "taste_vec" in reviews.columns else F.lit(None).cast(tracks.schema["taste_vec"].dataType)
    labels = one.join(waiting.select(F.col("id").alias("review_id"), F.col("note").alias("taste_note"), vec.alias("taste_vec"), "rating", "role"), "review_id")
    return label_by_hand(tracks, labels), mark_applied(reviews, one.select(F.col("review_id").alias("id"), "path"))


# Words that a result must not have unless the request has them.
OTHER_TAKES = ("live", "sped up", "slowed", "music video", "reaction", "cover")


def pick_best(results: DataFrame, tolerance: float = 25.0) -> DataFrame:
    """The search result likeliest to be the recording asked for, one row a request: (request_id, id, score).

    ``results``: (request_id, ord, id, title, uploader, duration, target_s, request_title). Ties keep the earliest; results without an id are skipped.
    """
    title, want = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("request_title", F.lit("")))
    delta = F.abs(F.col("duration") - F.col("target_s"))
    known = F.coalesce(F.col("duration") != 0, F.lit(False))
    score = F.when(F.col("target_s").isNull(), 0.0).when(~known, -50.0).otherwise(-delta - F.when(delta > tolerance, 500.0).otherwise(0.0))
    score += F.when(F.coalesce("uploader", F.lit("")).endswith(" - Topic"), 30.0).otherwise(0.0)
    score += F.when(title.contains("official audio"), 20.0).when(title.rlike(r"\baudio\b"), 10.0).otherwise(0.0)
    for token in OTHER_TAKES:
        score -= F.when(title.rlike(rf"\b{token}\b") & ~want.rlike(rf"\b{token}\b"), 40.0).otherwise(0.0)
    return results.where("id is not null and id <> ''").withColumn("score", score).groupBy("request_id").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "ord")).alias("b")).select("request_id", "b.id", "b.score")
