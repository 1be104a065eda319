"""Upserts and label writes as joins of old and new rows; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.plans.staging import numbered, stage

KEPT = ["id", "taste_note", "taste_vec", "taste_source", "taste_confidence", "rating", "role", "created_at"]


def upsert_tracks(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with ``new`` merged by path.

    A known ISRC stays unless a new one comes, a favourite stays one, taste columns and the id stay; all else takes the new value, nulls too. New paths get ids above
    the greatest. Several new rows of one path: the one with the greatest duration, then title, counts.
    """
    new = new.groupBy("path").agg(F.max(F.struct("duration_s", "title", *[c for c in new.columns if c not in ("path", "duration_s", "title")])).alias("r")).select("path", "r.*")
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    j = o.join(n, F.col("o.path") == F.col("n.path"), "full")
    touched = F.col("n.__new").isNotNull()
    cols = []
    for c in old.columns:
        if c == "path":
            cols.append(F.coalesce("o.path", "n.path").alias(c))
        elif c == "isrc":
            cols.append(F.coalesce(F.nullif(F.col("n.isrc"), F.lit("")), F.col("o.isrc")).alias(c))
        elif c == "is_favorite":
            cols.append((F.coalesce("o.is_favorite", F.lit(False)) | F.coalesce("n.is_favorite", F.lit(False))).alias(c))
        elif c in KEPT or c not in new.columns:
            cols.append(F.col("o." + c).alias(c))
        else:
            cols.append(F.when(touched, F.col("n." + c)).otherwise(F.col("o." + c)).alias(c))
    merged = j.select(*cols)
    if "id" not in old.columns:
        return merged
    merged = stage(merged, "merged")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(merged.where("id is null").drop("id"), [F.col("path")], "id", top)
    return merged.where("id is not null").unionByName(fresh.select(*merged.columns))


def replace_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """All sections of the tracks in ``new`` replaced by its rows."""
    touched = new.select("track_id").distinct()
    return old.join(touched, "track_id", "left_anti").unionByName(new.select(*old.columns))


def label_by_hand(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """Tracks with labels (path, taste_note, taste_vec, rating, role) written by hand: nulls are written too, an old confidence stays."""
    n = labels.select("path", *(F.col(c).alias("n_" + c) for c in ("taste_note", "taste_vec", "rating", "role")), F.lit(True).alias("hit")).dropDuplicates(["path"])
    j = tracks.join(n, "path", "left")
    put = {c: F.when(F.col("hit"), F.col("n_" + c)).otherwise(F.col(c)) for c in ("taste_note", "taste_vec", "rating", "role")}
    return j.withColumns(put | {"taste_source": F.when(F.col("hit"), "manual").otherwise(F.col("taste_source"))}).select(*tracks.columns)


def label_propagated(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """Tracks with propagated labels (id, taste_vec, rating, confidence), where none was given by hand."""
    n = labels.select("id", *(F.col(c).alias("n_" + c) for c in ("taste_vec", "rating", "confidence")), F.lit(True).alias("hit"))
    j = tracks.join(n, "id", "left")
    on = F.col("hit") & (F.coalesce("taste_source", F.lit("")) != "manual")
    put = {
        "taste_vec": F.when(on, F.col("n_taste_vec")).otherwise(F.col("taste_vec")), "rating": F.when(on, F.col("n_rating")).otherwise(F.col("rating")),
        "taste_confidence": F.when(on, F.col("n_confidence")).otherwise(F.col("taste_confidence")), "taste_source": F.when(on, "propagated").otherwise(F.col("taste_source")),
    }
    return j.withColumns(put).select(*tracks.columns)
