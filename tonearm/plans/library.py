"""Registry of the library's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import keys, text, vectors
from tonearm.operators import arcs, identity, labels, merge, retrieval, scorecard, sequencing, sets, structure
from tonearm.plans.staging import table
from tonearm.sources import exports, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _seeds(t: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return t.where("id % 100 = 0")


# --- retrieval ---------------------------------------------------------------------------------------------------

_COS = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])))"
_DIST = f"round(1 - {_COS.format(a='q.v', b='r.v')}, 9)"


def _knn_sql(rows: str, queries: str, k: int) -> str:
    return f"""WITH r AS ({rows}), q AS ({queries}), d AS (SELECT q.id AS qid, r.id AS id, {_DIST} AS distance FROM q JOIN r ON q.id <> r.id)
    SELECT qid, id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d.distance, id) <= {k}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", F.round("distance", 6).alias("distance"))


_TRACK_Q = "SELECT id, embedding AS v FROM tracks WHERE id % 100 = 0"


@query(_knn_sql("SELECT id, embedding AS v FROM tracks", _TRACK_Q, 10))
def knn_tracks(spark, d):
    t = table(spark, d, "tracks")
    return _rounded(retrieval.nearest(t, _seeds(t), 10))


@query(_knn_sql("SELECT id, embedding AS v FROM tracks WHERE bpm BETWEEN 110 AND 130 AND camelot IN ('8A','8B','9A') AND NOT path LIKE '%/favorites/%'", _TRACK_Q, 10))
def knn_filtered(spark, d):
    t = table(spark, d, "tracks")
    return _rounded(retrieval.nearest(t, _seeds(t), 10, retrieval.where(bpm=(110, 130), camelot={"8A", "8B", "9A"}) & ~F.col("path").like("%/favorites/%")))


@query(_knn_sql("SELECT id, embedding AS v FROM tracks WHERE is_favorite", _TRACK_Q, 5))
def knn_favorites(spark, d):
    t = table(spark, d, "tracks")
    return _rounded(retrieval.nearest(t, _seeds(t), 5, retrieval.where(favourite=True)))


@query(_knn_sql("SELECT DISTINCT ON (s.id) s.id, s.embedding AS v FROM sections s JOIN tracks t ON t.id = s.track_id WHERE s.is_mixin AND t.bpm BETWEEN 100 AND 140", "SELECT DISTINCT ON (id) id, embedding AS v FROM sections WHERE id % 100 = 0", 10))
def knn_sections(spark, d):
    s = table(spark, d, "sections")
    return _rounded(retrieval.nearest_section(s, table(spark, d, "tracks"), _seeds(s), 10, retrieval.where(bpm=(100, 140)), mixin=True))


@query(_knn_sql("SELECT id, taste_vec AS v FROM tracks WHERE taste_vec IS NOT NULL", "SELECT id, taste_vec AS v FROM tracks WHERE id % 100 = 0 AND taste_vec IS NOT NULL", 10))
def knn_taste(spark, d):
    t = table(spark, d, "tracks")
    return _rounded(retrieval.nearest(t, _seeds(t), 10, vec="taste_vec"))


def _ranked_sql(w: tuple[float, float, float], k: int = 10, pool: int = 200) -> str:
    return f"""WITH r AS (SELECT id, embedding AS v FROM tracks), q AS ({_TRACK_Q}),
    d AS (SELECT q.id AS qid, r.id AS id, {_DIST} AS distance FROM q JOIN r ON q.id <> r.id),
    p AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= {pool}),
    s AS (SELECT p.qid, p.id, t.path, p.distance, round({w[0]} * (1 - p.distance)
      + {w[1]} * (CASE t.taste_source WHEN 'manual' THEN 1.0 WHEN 'propagated' THEN coalesce(t.taste_confidence::DOUBLE, 0.5) ELSE 0.0 END)
        * coalesce({_COS.format(a='t.taste_vec', b='x.taste_vec')}, 0.0) + {w[2]} * coalesce(t.rating::DOUBLE, 0.0) / 5, 9) AS score
      FROM p JOIN tracks t ON t.id = p.id JOIN tracks x ON x.id = p.qid),
    k AS (SELECT qid, id, path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, distance, id) AS rank FROM s)"""


@query(_ranked_sql((0.5, 0.4, 0.1)) + " SELECT qid, id, path, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 10")
def ranked_blend(spark, d):
    t = table(spark, d, "tracks")
    return retrieval.ranked(t, _seeds(t)).withColumn("score", F.round("score", 6))


@query(_ranked_sql((1.0, 0.0, 0.0)) + " SELECT qid, id, path, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 10")
def ranked_acoustic_only(spark, d):
    t = table(spark, d, "tracks")
    return retrieval.ranked(t, _seeds(t), w=retrieval.Blend(1.0, 0.0, 0.0)).withColumn("score", F.round("score", 6))


_AB = "SELECT k.qid, count(*) AS n, avg(t.rating::DOUBLE) AS rating, avg((NOT (t.is_favorite OR coalesce(t.taste_source, '') = 'manual'))::INT::DOUBLE) AS discovery FROM k JOIN tracks t ON t.id = k.id WHERE k.rank <= 10 GROUP BY k.qid"


@query(f"SELECT a.qid, round(a.discovery, 6) AS discovery_blend, round(b.discovery, 6) AS discovery_acoustic, round(coalesce(a.rating, 0) - coalesce(b.rating, 0), 6) AS rating_delta FROM ({_ranked_sql((0.5, 0.4, 0.1))} {_AB}) a JOIN ({_ranked_sql((1.0, 0.0, 0.0))} {_AB}) b ON a.qid = b.qid")
def ab_delta(spark, d):
    t = table(spark, d, "tracks")
    return scorecard.compare(t, retrieval.ranked(t, _seeds(t)), retrieval.ranked(t, _seeds(t), w=retrieval.Blend(1.0, 0.0, 0.0)))


@query("SELECT count(*) AS n FROM tracks")
def count_tracks(spark, d):
    return table(spark, d, "tracks").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT s.id, t.path, s.idx::INT AS idx, s.label, round(s.start_s::DOUBLE, 4) AS start_s, round(s.end_s::DOUBLE, 4) AS end_s FROM sections s JOIN tracks t ON t.id = s.track_id")
def section_listing(spark, d):
    s = table(spark, d, "sections").dropDuplicates(["id"]).join(table(spark, d, "tracks").select(F.col("id").alias("track_id"), "path"), "track_id")
    return s.select("id", "path", F.col("idx").cast("int").alias("idx"), "label", F.round(F.col("start_s").cast("double"), 4).alias("start_s"), F.round(F.col("end_s").cast("double"), 4).alias("end_s"))


@query("SELECT DISTINCT c.run_id, c.path, coalesce(t.title, '') AS title, coalesce(t.artist, '') AS artist, round(t.duration_s::DOUBLE, 4) AS duration_s, t.camelot FROM track_cards c JOIN tracks t ON t.path = c.path")
def card_lookup(spark, d):
    t = table(spark, d, "tracks").select("path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("artist", F.lit("")).alias("artist"), F.round(F.col("duration_s").cast("double"), 4).alias("duration_s"), "camelot")
    return table(spark, d, "track_cards").select("run_id", "path").distinct().join(t, "path").select("run_id", "path", "title", "artist", "duration_s", "camelot")


# --- harmonic keys ------------------------------------------------------------------------------------------------

_STEP = "least(((a.n - b.n) % 12 + 12) % 12, ((b.n - a.n) % 12 + 12) % 12)"
_WHEEL = "SELECT n, l, n || l AS code FROM range(1, 13) t(n), (VALUES ('A'), ('B')) s(l)"


@query(f"""WITH w AS ({_WHEEL}), p AS (SELECT a.code AS code_a, b.code AS code_b, a.l = b.l AS same, {_STEP} AS st FROM w a, w b)
    SELECT code_a, code_b, (st = 0 OR (same AND st = 1)) AS compatible, (CASE WHEN same AND st = 5 THEN 2 ELSE st + (NOT same)::INT END)::INT AS distance, (same AND st = 5) AS boost,
    (CASE WHEN st = 0 THEN 0 WHEN same AND st = 1 THEN 0 WHEN same AND st = 5 THEN 1 WHEN same AND st = 2 THEN 2 WHEN same THEN 3 WHEN st = 1 THEN 1 ELSE 3 END)::INT AS grade FROM p""")
def key_matrix(spark, d):
    w = keys.wheel(spark).select("code")
    a, b = F.col("code_a"), F.col("code_b")
    p = w.select(F.col("code").alias("code_a")).join(F.broadcast(w.select(F.col("code").alias("code_b"))), how="cross")  # 24 by 24
    return p.select("code_a", "code_b", keys.compatible(a, b).alias("compatible"), keys.distance(a, b).cast("int").alias("distance"), keys.energy_boost(a, b).alias("boost"), keys.grade(a, b).cast("int").alias("grade"))


@query("""WITH p AS (SELECT i AS pc, m FROM range(12) t(i), (VALUES ('major'), ('minor')) s(m)), k AS (SELECT pc, m, CASE m WHEN 'major' THEN ((pc * 7 % 12 + 7) % 12 + 1) || 'B' ELSE ((pc * 7 % 12 + 4) % 12 + 1) || 'A' END AS code,
    ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][pc + 1] || CASE m WHEN 'minor' THEN 'm' ELSE '' END AS key_name FROM p) SELECT t.camelot, k.key_name, count(*) AS n FROM tracks t JOIN k ON k.code = upper(trim(t.camelot)) GROUP BY 1, 2""")
def key_names(spark, d):
    w = keys.wheel(spark)
    t = table(spark, d, "tracks").withColumn("code", F.upper(F.trim("camelot")))
    return t.join(F.broadcast(w), "code").groupBy("camelot", "key_name").agg(F.count(F.lit(1)).alias("n"))


# --- curves and genres ---------------------------------------------------------------------------------------------

_PROFILES = "(VALUES " + ", ".join(f"({p[0]}, '{p[1]}', {p[3]}.0, {p[4]}.0, {p[5]}.0, {p[6]}.0, '{p[7]}', {p[10]}, {p[11]})" for p in arcs.PROFILES) + ") p(ord, name, bpm_lo, bpm_hi, lufs_lo, lufs_hi, shape, max_stretch, cap)"
_CURVE = "(CASE shape WHEN 'flat' THEN 0.5 WHEN 'down' THEN 1.0 - x WHEN 'peak' THEN CASE WHEN x <= 0.7 THEN x / 0.7 ELSE 1.0 - 0.5 * (x - 0.7) / (1 - 0.7) END WHEN 'wave' THEN 0.5 - 0.5 * cos(2 * pi() * x) ELSE x END)"
_POINTS = f"SELECT name, x AS position, bpm_lo + {_CURVE} * (bpm_hi - bpm_lo) AS bpm, lufs_lo + {_CURVE} * (lufs_hi - lufs_lo) AS lufs FROM (SELECT p.*, (i / 8.0)::DOUBLE AS x FROM {_PROFILES}, range(9) r(i))"


@query(f"SELECT name, round(position, 6) AS position, round(bpm::DOUBLE, 6) AS bpm, round(lufs::DOUBLE, 6) AS lufs FROM ({_POINTS})")
def arc_points(spark, d):
    return arcs.points(arcs.profiles(spark)).select("name", *(F.round(c, 6).alias(c) for c in ("position", "bpm", "lufs")))


@query(f"SELECT name, round((min(bpm) - 4)::DOUBLE, 6) AS bpm_lo, round((max(bpm) + 4)::DOUBLE, 6) AS bpm_hi FROM ({_POINTS}) GROUP BY name")
def bpm_band(spark, d):
    return arcs.bpm_band(arcs.points(arcs.profiles(spark))).select("name", F.round("bpm_lo", 6).alias("bpm_lo"), F.round("bpm_hi", 6).alias("bpm_hi"))


@query("WITH s AS (SELECT i, 1.0 * i / 20 AS x, shape FROM range(21) t(i), (VALUES ('flat'), ('build'), ('down'), ('peak'), ('wave')) v(shape)) SELECT shape, i::INT AS i, round((" + _CURVE + ")::DOUBLE, 6) AS intensity FROM s")
def arc_shapes(spark, d):
    s = spark.createDataFrame([(x,) for x in ("flat", "build", "down", "peak", "wave")], "shape string").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20))))
    return s.select("shape", "i", F.round(arcs.intensity(F.col("shape"), F.col("i") / 20), 6).alias("intensity"))


def _contains(words: str, c: str, sep: str) -> str:
    return " OR ".join(f"contains({c}, '{w}')" for w in words.split(sep))


_DETECT = "CASE " + " ".join(f"WHEN {_contains(p[2], 'lower(b)', ',')} THEN '{p[1]}'" for p in arcs.PROFILES[:-1]) + " ELSE 'open' END"
_SHAPE = "CASE " + " ".join(f"WHEN {_contains(w, 'lower(b)', '|')} THEN '{s}'" for s, w in arcs.SHAPE_WORDS) + " ELSE 'build' END"


@query(f"SELECT id, {_DETECT} AS genre, {_SHAPE} AS shape FROM (SELECT doc_id AS id, text AS b FROM documents UNION ALL SELECT -id, genre FROM tracks WHERE genre IS NOT NULL)")
def detect_genre_shape(spark, d):
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("b")).unionByName(table(spark, d, "tracks").where("genre is not null").select((-F.col("id")).alias("id"), F.col("genre").alias("b")))
    return b.select("id", arcs.detect(F.col("b")).alias("genre"), arcs.shape_of(F.col("b")).alias("shape"))


# --- sets ----------------------------------------------------------------------------------------------------------

_SLOTS = """SELECT *, CASE WHEN n > 1 THEN i / (n - 1)::DOUBLE ELSE 0.0 END AS position FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, path) - 1 AS i, count(*) OVER (PARTITION BY set_id) AS n
    FROM (SELECT DISTINCT ON (run_id, path) run_id AS set_id, path, score, title, artist, camelot, bpm::DOUBLE AS bpm, lufs::DOUBLE AS lufs FROM track_cards ORDER BY run_id, path, loaded_at DESC))"""
_ARC = f"WITH slots AS ({_SLOTS}), pts AS (SELECT position AS x, bpm AS tb, lufs AS tl, lead(position) OVER w AS x2, lead(bpm) OVER w AS tb2, lead(lufs) OVER w AS tl2 FROM ({_POINTS}) WHERE name = 'house' WINDOW w AS (ORDER BY position)), t AS (SELECT s.*, tb + (tb2 - tb) * (position - x) / (x2 - x) AS target_bpm, tl + (tl2 - tl) * (position - x) / (x2 - x) AS target_lufs FROM slots s JOIN pts ON (position > x OR (x = 0 AND position = 0)) AND position <= x2)"
_N = "regexp_extract(upper(trim({c})), '^([0-9]{{1,2}})[AB]$', 1)"
_PAIR = f"""SELECT *, abs(n_bpm - bpm) AS bpm_jump, abs(n_lufs - lufs) AS lufs_jump, coalesce(la = lb, false) AS same, least((ka - kb + 12) % 12, (kb - ka + 12) % 12) AS st, coalesce(artist <> '' AND artist = n_artist, false) AS same_artist FROM (
    SELECT *, try_cast(nullif({_N.format(c='camelot')}, '') AS INT) AS ka, try_cast(nullif({_N.format(c='n_camelot')}, '') AS INT) AS kb, right(upper(trim(camelot)), 1) AS la, right(upper(trim(n_camelot)), 1) AS lb FROM (
    SELECT *, lead(bpm) OVER w AS n_bpm, lead(lufs) OVER w AS n_lufs, lead(camelot) OVER w AS n_camelot, lead(artist) OVER w AS n_artist, lead(path) OVER w AS n_path FROM t WINDOW w AS (PARTITION BY set_id ORDER BY i)) WHERE n_path IS NOT NULL)"""
_TRANS = f"SELECT set_id, i, bpm_jump, lufs_jump, coalesce(st = 0 OR (same AND st = 1), true) AS compatible, coalesce(CASE WHEN same AND st = 5 THEN 2 ELSE st + (NOT same)::INT END, 0) AS key_distance, same_artist FROM ({_PAIR})"


def _slots(spark, d) -> DataFrame:
    return sets.slots(table(spark, d, "track_cards"))


def _aimed(spark, d, name: str = "house") -> DataFrame:
    return arcs.targets(_slots(spark, d).withColumn("name", F.lit(name)), arcs.points(arcs.profiles(spark)))


@query(f"{_ARC} SELECT set_id, i::INT AS i, round(target_bpm, 5) AS target_bpm, round(target_lufs, 5) AS target_lufs FROM t")
def arc_targets(spark, d):
    return _aimed(spark, d).select("set_id", "i", F.round("target_bpm", 5).alias("target_bpm"), F.round("target_lufs", 5).alias("target_lufs"))


@query(f"""{_ARC} SELECT set_id, i::INT AS i, round(bpm_jump, 6) AS bpm_jump, round(lufs_jump, 6) AS lufs_jump, compatible, key_distance::INT AS key_distance, same_artist, (NOT compatible OR bpm_jump > 6 OR lufs_jump > 5 OR same_artist) AS rough,
    concat_ws(',', CASE WHEN NOT compatible THEN 'key clash' END, CASE WHEN bpm_jump > 6 THEN 'bpm jump' END, CASE WHEN lufs_jump > 5 THEN 'energy jump' END, CASE WHEN same_artist THEN 'same artist' END) AS reasons FROM ({_TRANS})""")
def transitions(spark, d):
    t = sets.transitions(_slots(spark, d))
    return t.select("set_id", "i", F.round("bpm_jump", 6).alias("bpm_jump"), F.round("lufs_jump", 6).alias("lufs_jump"), "compatible", F.col("key_distance").cast("int").alias("key_distance"), "same_artist", "rough", F.array_join("reasons", ",").alias("reasons"))


_RUNS = "SELECT set_id, max(c) AS longest_run FROM (SELECT set_id, g, count(*) AS c FROM (SELECT *, sum(b) OVER (PARTITION BY set_id ORDER BY i) AS g FROM (SELECT *, (i = 0 OR camelot IS DISTINCT FROM lag(camelot) OVER (PARTITION BY set_id ORDER BY i))::INT AS b FROM slots)) GROUP BY 1, 2) GROUP BY 1"
_CLOSE = "SELECT set_id, i, i + 2 AS j FROM (SELECT set_id, i, artist, lead(artist, 2) OVER (PARTITION BY set_id ORDER BY i) AS o FROM slots) WHERE artist <> '' AND artist = o"


@query(f"WITH slots AS ({_SLOTS}) {_RUNS}")
def key_runs(spark, d):
    return sets.key_runs(_slots(spark, d))


@query(f"WITH slots AS ({_SLOTS}) SELECT set_id, i::INT AS i, j::INT AS j FROM ({_CLOSE})")
def close_artist_pairs(spark, d):
    return sets.close_artists(_slots(spark, d))


@query(f"""{_ARC}, tr AS ({_TRANS}), a AS (SELECT set_id, avg(bpm_jump) AS avg_bpm_jump, max(bpm_jump) AS max_bpm_jump, avg(compatible::INT::DOUBLE) AS harmonic, sum(same_artist::INT)::INT AS repeats,
    sum((NOT compatible OR bpm_jump > 6 OR lufs_jump > 5 OR same_artist)::INT)::INT AS n_rough FROM tr GROUP BY 1), f AS (SELECT set_id, count(*) AS n, sqrt(avg(pow(lufs - target_lufs, 2))) AS arc_rmse FROM t GROUP BY 1), rr AS ({_RUNS}), c AS (SELECT set_id, count(*) AS n_close FROM ({_CLOSE}) GROUP BY 1)
    SELECT f.set_id, f.n, round(coalesce(avg_bpm_jump, 0), 5) AS avg_bpm_jump, round(coalesce(max_bpm_jump, 0), 5) AS max_bpm_jump, round(coalesce(harmonic, 1), 6) AS harmonic, coalesce(repeats, 0) AS repeats, coalesce(n_rough, 0) AS n_rough, round(arc_rmse, 5) AS arc_rmse, longest_run, coalesce(n_close, 0) AS n_close,
    (coalesce(harmonic, 1) >= 0.7 AND coalesce(max_bpm_jump, 0) <= 6 AND arc_rmse <= 4 AND coalesce(repeats, 0) <= 0) AS passed FROM f LEFT JOIN a USING (set_id) LEFT JOIN rr USING (set_id) LEFT JOIN c USING (set_id)""")
def set_report(spark, d):
    r = sets.report(_aimed(spark, d), F.col("target_lufs"))
    return r.select("set_id", "n", *(F.round(c, k).alias(c) for c, k in (("avg_bpm_jump", 5), ("max_bpm_jump", 5), ("harmonic", 6))), F.col("repeats").cast("int").alias("repeats"), F.col("n_rough").cast("int").alias("n_rough"), F.round("arc_rmse", 5).alias("arc_rmse"), "longest_run", "n_close", "passed")


_SPAN_SLOTS = "SELECT id AS slot_id, id AS track_id, (-18 + 10 * (id % 11) / 10.0)::DOUBLE AS target_lufs FROM tracks"
_SPANS = f"""WITH sl AS ({_SPAN_SLOTS}), sec AS (SELECT DISTINCT ON (id) * FROM sections), j AS (SELECT sl.*, sec.* EXCLUDE (track_id, id, embedding) FROM sl JOIN sec USING (track_id)),
    core AS (SELECT DISTINCT ON (slot_id) slot_id, idx AS c_idx, label AS c_label, start_s AS c_start, end_s AS c_end, energy_lufs AS c_lufs FROM j WHERE energy_lufs IS NOT NULL AND NOT isnan(energy_lufs) ORDER BY slot_id, abs(energy_lufs - target_lufs), idx),
    k AS (SELECT * FROM j JOIN core USING (slot_id)),
    e AS (SELECT slot_id, idx AS e_idx, label AS e_label, start_s AS e_start FROM k WHERE is_mixin AND idx <= c_idx UNION ALL SELECT slot_id, c_idx, c_label, c_start FROM core WHERE slot_id NOT IN (SELECT slot_id FROM k WHERE is_mixin AND idx <= c_idx)),
    x AS (SELECT slot_id, idx AS x_idx, label AS x_label, end_s AS x_end FROM k WHERE is_mixout AND idx >= c_idx UNION ALL SELECT slot_id, c_idx, c_label, c_end FROM core WHERE slot_id NOT IN (SELECT slot_id FROM k WHERE is_mixout AND idx >= c_idx)),
    p AS (SELECT *, x_end::DOUBLE - e_start::DOUBLE AS span FROM e JOIN x USING (slot_id)),
    b AS (SELECT DISTINCT ON (slot_id) * FROM p ORDER BY slot_id, CASE WHEN span <= 0 THEN 2 WHEN span < 120 OR span > 330 THEN 1 ELSE 0 END, CASE WHEN span <= 0 THEN 0.0 WHEN span < 120 THEN 120 - span WHEN span > 330 THEN span - 330 ELSE 330 - span END, e_idx, x_idx)"""


def _spans(spark, d) -> DataFrame:
    t = table(spark, d, "tracks").select(F.col("id").alias("slot_id"), F.col("id").alias("track_id"), (-18 + 10 * F.pmod("id", F.lit(11)) / 10.0).cast("double").alias("target_lufs"))
    return sequencing.play_spans(table(spark, d, "sections"), t)


@query(_SPANS + """ SELECT slot_id, c_idx::INT AS section_idx, c_label AS section_label, round(c_lufs::DOUBLE, 4) AS lufs, round(e_start::DOUBLE, 4) AS cue_start_s, round(x_end::DOUBLE, 4) AS cue_end_s, e_label AS mixin_label, x_label AS mixout_label,
    CASE WHEN c_start > e_start THEN round(c_start::DOUBLE, 4) END AS core_start_s FROM b JOIN core USING (slot_id)""")
def play_spans(spark, d):
    return _spans(spark, d).select("slot_id", "section_idx", "section_label", F.round("lufs", 4).alias("lufs"), F.round("cue_start_s", 4).alias("cue_start_s"), F.round("cue_end_s", 4).alias("cue_end_s"), "mixin_label", "mixout_label", F.round("core_start_s", 4).alias("core_start_s"))


def _curved(spark, d) -> DataFrame:
    c = arcs.points(arcs.profiles(spark)).where("name = 'house'").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("position", "bpm", "lufs"))).alias("p"))
    return _slots(spark, d).join(F.broadcast(c), how="cross").withColumns({"xs": F.transform("p", lambda r: r["position"]), "bpms": F.transform("p", lambda r: r["bpm"]), "lufss": F.transform("p", lambda r: r["lufs"])}).drop("p", "name", "position", "n", "title")  # one curve


@query()
def greedy_order(spark, d):
    return sequencing.greedy(_curved(spark, d))


_FADES = f"""{_ARC}, l AS (SELECT t.*, tr.duration_s::DOUBLE AS len FROM t LEFT JOIN (SELECT path, min(duration_s) AS duration_s FROM tracks GROUP BY 1) tr USING (path)),
    m AS (SELECT *, lead(bpm) OVER w AS nb, lead(target_bpm) OVER w AS nt, lead(path) OVER w AS np FROM l WINDOW w AS (PARTITION BY set_id ORDER BY i)),
    b AS (SELECT *, CASE WHEN coalesce(len, 0) <> 0 AND bpm > 0 THEN greatest(1, round_even(len * bpm / 240, 0)::INT) END AS sb FROM m WHERE np IS NOT NULL),
    h AS (SELECT *, CASE WHEN sb IS NULL THEN 4 ELSE least(16, CASE WHEN sb // 2 = 0 THEN 1 ELSE sb // 2 END) END AS ask, least(greatest(nt, nb * (1 - 0.08)), nb * (1 + 0.08)) AS tb FROM b),
    x AS (SELECT set_id, i, pow(2, floor(log2(greatest(1, ask))))::INT AS bars, tb AS target_bpm FROM h)"""


def _fades(spark, d) -> DataFrame:
    s = _aimed(spark, d).join(table(spark, d, "tracks").groupBy("path").agg(F.min(F.col("duration_s").cast("double")).alias("len")), "path", "left")
    return s, sets.crossfades(s, F.col("len"), F.col("target_bpm"), F.lit(16), F.lit(0.08))


@query(_FADES + " SELECT set_id, i::INT AS i, bars, round(target_bpm, 5) AS target_bpm, round(bars * 240.0 / target_bpm, 5) AS crossfade_s FROM x")
def crossfade_plan(spark, d):
    _, f = _fades(spark, d)
    return f.select("set_id", "i", "bars", F.round("target_bpm", 5).alias("target_bpm"), F.round("crossfade_s", 5).alias("crossfade_s"))


@query(_FADES + " SELECT l2.set_id, round(greatest(0, l2.t - coalesce(x2.f, 0)), 3) AS seconds FROM (SELECT set_id, sum(coalesce(nullif(len, 0), 210)) AS t FROM l GROUP BY 1) l2 LEFT JOIN (SELECT set_id, sum(bars * 240.0 / target_bpm) AS f FROM x GROUP BY 1) x2 USING (set_id)")
def set_duration(spark, d):
    s, f = _fades(spark, d)
    return sets.duration(s, F.col("len"), f).select("set_id", F.round("seconds", 3).alias("seconds"))


# --- labels and scorecard --------------------------------------------------------------------------------------------

_NEAR = f"""WITH r AS (SELECT id, embedding AS v, taste_vec, coalesce(rating::DOUBLE, 0.0) AS rating FROM tracks WHERE taste_source = 'manual' AND taste_vec IS NOT NULL), q AS (SELECT id, path, embedding AS v FROM tracks WHERE coalesce(taste_source, '') <> 'manual'),
    d AS (SELECT q.id AS qid, r.id, {_DIST} AS distance, r.rating, r.taste_vec FROM q JOIN r ON q.id <> r.id), n AS (SELECT *, 1 - distance AS sim, greatest(1 - distance, 0) AS w FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, d.id) <= 8)"""


@query(_NEAR + " SELECT qid AS id, round(sum(w * rating) / sum(w), 6) AS raw_rating, round(sum(w * sim) / sum(w), 6) AS confidence FROM n GROUP BY qid HAVING sum(w) >= 1e-9")
def propagate_labels(spark, d):
    return labels.propagate(table(spark, d, "tracks")).select("id", F.round("raw_rating", 6).alias("raw_rating"), F.round("confidence", 6).alias("confidence"))


@query(_NEAR + """, e AS (SELECT qid, w, unnest(taste_vec) AS x, unnest(range(len(taste_vec))) AS p FROM n), m AS (SELECT qid, p, sum(w * x::DOUBLE) / sum(w) AS x FROM e GROUP BY 1, 2), z AS (SELECT qid, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1)
    SELECT m.qid AS id, p::INT AS position, round(x / norm, 5) AS value FROM m JOIN z USING (qid)""")
def propagate_vectors(spark, d):
    return labels.propagate(table(spark, d, "tracks")).select("id", F.posexplode("taste_vec").alias("position", "v")).select("id", "position", F.round("v", 5).alias("value"))


@query(_NEAR + """, u AS (SELECT qid, avg(sim) AS m, stddev_pop(rating) AS s FROM n GROUP BY 1), f AS (SELECT q.path, q.id, round(coalesce(greatest(least(1 - greatest(least(m, 1), 0) + coalesce(s, 0) / 4, 1), 0), 1.0), 6) AS uncertainty FROM q LEFT JOIN u ON u.qid = q.id)
    SELECT id, path, uncertainty FROM f ORDER BY uncertainty DESC, path DESC LIMIT 20""")
def labeling_queue(spark, d):
    return labels.labeling_queue(table(spark, d, "tracks"))


_FAV = "SELECT p, avg(x::DOUBLE) AS x FROM (SELECT unnest(taste_vec) AS x, unnest(range(len(taste_vec))) AS p FROM tracks WHERE is_favorite AND taste_vec IS NOT NULL) GROUP BY p"


@query(f"WITH m AS ({_FAV}), n AS (SELECT sqrt(sum(x * x)) AS norm FROM m) SELECT p::INT AS position, round(x / norm, 6) AS value FROM m, n")
def taste_centroid(spark, d):
    return scorecard.centroid(table(spark, d, "tracks")).select(F.posexplode("centroid").alias("position", "v")).select("position", F.round("v", 6).alias("value"))


@query(f"""WITH slots AS ({_SLOTS}), m AS ({_FAV}), c AS (SELECT list(x / (SELECT sqrt(sum(x * x)) FROM m) ORDER BY p) AS c FROM m), s AS (SELECT set_id, t.taste_vec, (t.is_favorite OR coalesce(t.taste_source, '') = 'manual') AS known FROM slots JOIN tracks t USING (path))
    SELECT set_id, count(*) AS n, count(taste_vec) AS n_with_taste, round(coalesce(avg(list_inner_product(taste_vec::DOUBLE[], c)), 0), 5) AS taste_match, round(avg((NOT known)::INT::DOUBLE), 6) AS discovery FROM s, c GROUP BY set_id""")
def scorecards(spark, d):
    return scorecard.scores(_slots(spark, d), table(spark, d, "tracks")).select("set_id", "n", "n_with_taste", F.round("taste_match", 5).alias("taste_match"), F.round("discovery", 6).alias("discovery"))


# --- identity -------------------------------------------------------------------------------------------------------

# compatibility forms by rule: full-width characters and blanks of other widths
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " " * 13
_BASIC = f"trim(lower(strip_accents(replace(translate(coalesce({{c}}, ''), '{_WIDE}', '{_NARROW}'), '\ufb03', 'ffi'))))"
_TAIL = r"'\s*[\(\[]?\s*(?:feat\.?|ft\.?|featuring)\b.*$', ' ', 'i'"
_TKEY = "trim(regexp_replace(string_split_regex(regexp_replace(regexp_replace(replace(" + _BASIC.replace("{c}", "title") + r", '&', ' and '), '[\(\[][^\)\]]*[\)\]]', ' ', 'g'), " + _TAIL + r"), '\s-\s')[1], '[^a-z0-9]+', ' ', 'g'))"
_AKEY = "trim(regexp_replace(string_split_regex(regexp_replace(replace(" + _BASIC.replace("{c}", "artist") + ", '&', ' and '), " + _TAIL + r"), '\s*(?:,|;|/| x | vs\.? | with )\s*')[1], '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT 't' AS kind, id, {_AKEY} AS artist_key, {_TKEY} AS title_key FROM tracks UNION ALL SELECT 'p', id, {_AKEY}, {_TKEY} FROM pending_taste")
def normalize_keys(spark, d):
    parts = [table(spark, d, n).select(F.lit(k).alias("kind"), "id", text.artist_key(F.col("artist")).alias("artist_key"), text.title_key(F.col("title")).alias("title_key")) for k, n in (("t", "tracks"), ("p", "pending_taste"))]
    return parts[0].unionByName(parts[1])


_KEYED = "SELECT id, {a} AS ak, {t} AS tk, nullif(upper(trim(isrc)), '') AS ik, duration_s::DOUBLE AS dur FROM {n}"


@query(f"""WITH r AS ({_KEYED.replace("{a}", _AKEY).replace("{t}", _TKEY).replace("{n}", "pending_taste")}), t AS ({_KEYED.replace("{a}", _AKEY).replace("{t}", _TKEY).replace("{n}", "tracks")}),
    c AS (SELECT t.id AS track_id, max(r.id) AS review_id, true AS confident, 'isrc' AS reason FROM t JOIN r ON t.ik = r.ik GROUP BY 1),
    n AS (SELECT t.id AS track_id, r.id AS rid, coalesce(abs(r.dur - t.dur) <= 5.0, true) AS ok FROM t JOIN r ON t.ak = r.ak AND t.tk = r.tk WHERE t.ak <> '' AND t.tk <> '' AND t.id NOT IN (SELECT track_id FROM c)),
    g AS (SELECT track_id, sum(ok::INT) AS k, max(CASE WHEN ok THEN rid END) AS near, max(rid) AS latest FROM n GROUP BY 1)
    SELECT * FROM c UNION ALL SELECT track_id, CASE WHEN k = 0 THEN latest ELSE near END, k = 1, CASE WHEN k = 1 THEN 'name+duration' WHEN k = 0 THEN 'duration-mismatch' ELSE 'multiple-name' END FROM g""")
def match_reviews(spark, d):
    return identity.find_match(table(spark, d, "pending_taste"), table(spark, d, "tracks"))


@query("""WITH c AS (SELECT isrc, arg_min(path, id) AS p1 FROM tracks WHERE isrc IS NOT NULL GROUP BY 1), n AS (SELECT lower(artist) AS a, lower(title) AS t, min(path) AS p2 FROM tracks WHERE artist IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT p.id, coalesce(p1, p2) AS path FROM pending_taste p LEFT JOIN c ON p.isrc = c.isrc LEFT JOIN n ON lower(p.artist) = a AND lower(p.title) = t""")
def library_match(spark, d):
    return identity.library_match(table(spark, d, "pending_taste").select("id", "isrc", "artist", "title"), table(spark, d, "tracks"))


@query(f"""WITH k AS (SELECT *, coalesce('i|' || nullif(upper(trim(isrc)), ''), 'n|' || {_AKEY} || '|' || {_TKEY}) AS identity FROM pending_taste)
    SELECT identity, min(id) AS id, arg_max(note, (captured_at, id)) AS note, count(*) AS n, arg_max(rating, (captured_at, id)) FILTER (rating IS NOT NULL) AS rating, min(captured_at) AS captured_at FROM k GROUP BY identity""")
def parked_reviews(spark, d):
    return identity.parked_once(table(spark, d, "pending_taste")).select("identity", "id", "note", "n", "rating", "captured_at")


@query("SELECT id, row_number() OVER (ORDER BY captured_at DESC, id)::INT AS place FROM pending_taste WHERE status = 'pending'")
def pending_newest_first(spark, d):
    return readers.newest_first(table(spark, d, "pending_taste")).select("id", "place")


# --- writes ------------------------------------------------------------------------------------------------------------


def _incoming(spark, d) -> DataFrame:
    t = table(spark, d, "tracks")
    return t.where("id % 3 = 0").select(
        F.when(F.col("id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/new"), "path")).alias("path"), (F.col("duration_s") + 1).cast("float").alias("duration_s"), F.when(F.col("id") % 5 != 0, F.col("title")).alias("title"), "bpm",
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("NEW"), F.col("id").cast("string"))).alias("isrc"), (F.col("id") % 7 == 0).alias("is_favorite"), "camelot",
    )


@query("""WITH n AS (SELECT CASE WHEN id % 2 = 0 THEN path ELSE '/new' || path END AS path, (duration_s + 1)::FLOAT AS duration_s, CASE WHEN id % 5 <> 0 THEN title END AS title, CASE WHEN id % 4 = 0 THEN 'NEW' || id END AS isrc, id % 7 = 0 AS fav FROM tracks WHERE id % 3 = 0)
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN o.title ELSE n.title END AS title, coalesce(n.isrc, o.isrc) AS isrc, (coalesce(o.is_favorite, false) OR coalesce(n.fav, false)) AS is_favorite, round((CASE WHEN n.path IS NULL THEN o.duration_s ELSE n.duration_s END)::DOUBLE, 3) AS duration_s,
    o.taste_source, coalesce(o.id, (SELECT max(id) FROM tracks) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY n.path)) AS id FROM tracks o FULL JOIN n ON o.path = n.path""")
def upsert_tracks(spark, d):
    out = merge.upsert_tracks(table(spark, d, "tracks"), _incoming(spark, d))
    return out.select("path", "title", "isrc", "is_favorite", F.round(F.col("duration_s").cast("double"), 3).alias("duration_s"), "taste_source", "id")


@query("""SELECT id, CASE WHEN id % 10 = 0 THEN 'manual' WHEN id % 10 = 1 AND coalesce(taste_source, '') <> 'manual' THEN 'propagated' ELSE taste_source END AS taste_source, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 AND coalesce(taste_source, '') <> 'manual' THEN 4 ELSE rating END::INT AS rating FROM tracks""")
def label_writes(spark, d):
    t = table(spark, d, "tracks")
    hand = t.where("id % 10 = 0").select("path", F.lit("note").alias("taste_note"), "taste_vec", F.lit(None).cast("smallint").alias("rating"), "role")
    carried = t.where("id % 10 = 1").select("id", "taste_vec", F.lit(4).cast("smallint").alias("rating"), F.lit(0.5).cast("float").alias("confidence"))
    out = merge.label_propagated(merge.label_by_hand(t, hand), carried)
    return out.select("id", "taste_source", F.col("rating").cast("int").alias("rating"))


@query("SELECT id, track_id, label FROM (SELECT DISTINCT ON (id) * FROM sections) WHERE track_id % 4 <> 0 UNION ALL SELECT -id, track_id, 'new' FROM (SELECT DISTINCT ON (id) * FROM sections) WHERE track_id % 4 = 0 AND idx = 0")
def replace_sections(spark, d):
    s = table(spark, d, "sections").dropDuplicates(["id"]).select("id", "track_id", "idx", "label")
    return merge.replace_sections(s, s.where("track_id % 4 = 0 and idx = 0").withColumns({"id": -F.col("id"), "label": F.lit("new")})).select("id", "track_id", "label")


def _log(spark, d) -> DataFrame:
    """Retrieval runs read as a log of sets."""
    return table(spark, d, "track_cards").groupBy("run_id").agg(F.max("logged_at").alias("captured_at"), F.collect_set("path").alias("paths"), F.lit(True).alias("approved"))


@query("WITH r AS (SELECT run_id, max(logged_at) AS t FROM track_cards GROUP BY 1 ORDER BY t DESC LIMIT 3) SELECT id, path FROM tracks WHERE path NOT IN (SELECT path FROM track_cards WHERE run_id IN (SELECT run_id FROM r))")
def recent_exclusion(spark, d):
    return readers.without_recent(table(spark, d, "tracks").select("id", "path"), _log(spark, d))


@query(f"""WITH slots AS ({_SLOTS}), k AS (SELECT *, lead(camelot) OVER (PARTITION BY set_id ORDER BY i) AS c2 FROM slots),
    b AS (SELECT *, CASE WHEN {_N.format(c='camelot')} <> '' AND {_N.format(c='c2')} <> '' AND right(upper(trim(camelot)), 1) = right(upper(trim(c2)), 1)
      AND least((({_N.format(c='camelot')}::INT - {_N.format(c='c2')}::INT) % 12 + 12) % 12, (({_N.format(c='c2')}::INT - {_N.format(c='camelot')}::INT) % 12 + 12) % 12) = 5 THEN i END AS up FROM k)
    SELECT set_id, count(*) AS n, count(DISTINCT camelot) AS keys, arg_min(bpm, i) AS open_bpm, arg_min(lufs, i) AS open_lufs, arg_min(i, (-lufs, i))::INT AS peak, arg_min(bpm, (-lufs, i)) AS peak_bpm, max(lufs) AS peak_lufs, arg_max(bpm, i) AS close_bpm, arg_max(lufs, i) AS close_lufs, min(up)::INT AS lift FROM b GROUP BY set_id""")
def set_journeys(spark, d):
    j = sets.journey(_slots(spark, d))
    return j.withColumns({"peak": F.col("peak").cast("int"), "lift": F.col("lift").cast("int")})


@query("SELECT id, least(40, greatest(4, round_even(duration_s::DOUBLE / 3.5, 0)))::INT AS tracks FROM tracks WHERE duration_s IS NOT NULL")
def slots_for_minutes(spark, d):
    return table(spark, d, "tracks").where("duration_s is not null").select("id", sets.slots_for(F.col("duration_s").cast("double")).alias("tracks"))


@query()
def review_drain(spark, d):
    """All waiting reviews against the whole library, every file taken for new."""
    t, r = table(spark, d, "tracks"), table(spark, d, "pending_taste")
    _, after = identity.drain(t, r, t)
    return after.select("id", "status", "matched_path")


@query()
def review_adds(spark, d):
    """Reviews of odd ids added to those of even ids."""
    r = table(spark, d, "pending_taste")
    return identity.add_reviews(r.where("id % 2 = 0"), r.where("id % 2 = 1")).select("id", "isrc", "note", "status")


# --- structure -----------------------------------------------------------------------------------------------------


@query("SELECT id, round(CASE WHEN v >= 168 THEN v / 2 ELSE v END, 4) AS bpm FROM (SELECT id, CASE WHEN x <= 0 THEN 0 ELSE x * pow(2, ceil(log2(84 / x))) END AS v FROM (SELECT id, bpm::DOUBLE * [0.25, 0.5, 1, 2, 3, 0][(id % 6 + 1)::INT] AS x FROM tracks))")
def octave_corrected(spark, d):
    f = F.element_at(F.array(*(F.lit(x) for x in (0.25, 0.5, 1.0, 2.0, 3.0, 0.0))), (F.col("id") % 6 + 1).cast("int"))
    return table(spark, d, "tracks").select("id", F.round(structure.octave_correct(F.col("bpm").cast("double") * f), 4).alias("bpm"))


_SEC = "SELECT DISTINCT ON (id) id, track_id, idx, label, start_s::DOUBLE AS s, end_s::DOUBLE AS e, CASE WHEN isnan(energy_lufs) THEN -14 ELSE coalesce(energy_lufs, -14) END::DOUBLE AS energy, embedding FROM sections"
_REC = f"""sec AS ({_SEC}), rec AS (SELECT a.id, max({_COS.format(a='a.embedding', b='b.embedding')}) AS r FROM sec a JOIN sec b ON a.track_id = b.track_id AND abs(a.idx - b.idx) > 1 GROUP BY 1), nn AS (SELECT track_id, count(*) AS n FROM sec GROUP BY 1),
    q AS (SELECT sec.id, sec.track_id, sec.idx, sec.energy, n, CASE WHEN n < 3 THEN 0 ELSE greatest(0, least(1, coalesce(r, 0))) END AS rec FROM sec JOIN nn USING (track_id) LEFT JOIN rec USING (id))"""


def _sections(spark, d) -> DataFrame:
    s = table(spark, d, "sections").dropDuplicates(["id"])
    return s.withColumn("energy", F.coalesce(F.nanvl(F.col("energy_lufs").cast("double"), F.lit(-14.0)), F.lit(-14.0)))


@query(f"WITH {_REC} SELECT id, round(rec, 6) AS recurrence FROM q")
def section_recurrence(spark, d):
    return structure.recurrence(_sections(spark, d)).select("id", F.round("recurrence", 6).alias("recurrence"))


@query(f"""WITH {_REC}, e AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS k, CASE WHEN max(energy) OVER w - min(energy) OVER w <= 1e-9 THEN 0.5 ELSE (energy - min(energy) OVER w) / (max(energy) OVER w - min(energy) OVER w) END AS x FROM q WINDOW w AS (PARTITION BY track_id)),
    f AS (SELECT *, lead(x) OVER (PARTITION BY track_id ORDER BY idx) AS nx, first_value(k) OVER (PARTITION BY track_id ORDER BY (k > 0 AND k < n - 1)::INT DESC, x DESC, k) AS pk FROM e),
    g AS (SELECT *, CASE WHEN n = 1 THEN 'drop' WHEN k = 0 THEN CASE WHEN n >= 4 AND x > 0.75 THEN 'chorus' ELSE 'intro' END WHEN k = n - 1 THEN CASE WHEN n >= 4 AND x > 0.75 THEN 'chorus' ELSE 'outro' END WHEN k = pk THEN 'drop' WHEN nx - x > 0.25 AND x < 0.6 THEN 'build'
      WHEN x > 0.7 OR (rec >= 0.6 AND x >= 0.45) THEN 'chorus' WHEN x < 0.3 THEN 'break' ELSE 'verse' END AS l FROM f)
    SELECT track_id, idx::INT AS idx, CASE WHEN k > 0 AND k = n - 2 AND l = 'verse' AND x < 0.6 THEN 'bridge' ELSE l END AS label FROM g""")
def section_labels(spark, d):
    s = _sections(spark, d)
    return structure.label_sections(s.join(structure.recurrence(s), "id").select("track_id", "idx", "energy", "recurrence")).select("track_id", F.col("idx").cast("int").alias("idx"), "label")


@query(f"""WITH sec AS ({_SEC}), f AS (SELECT track_id, idx, label IN ('intro','break','verse') AS i, label IN ('outro','break','bridge') AS o, label IN ('break','intro') AS l, min(idx) OVER w AS a, max(idx) OVER w AS b FROM sec WINDOW w AS (PARTITION BY track_id))
    SELECT track_id, idx::INT AS idx, (i OR (NOT bool_or(i) OVER w AND idx = a)) AS is_mixin, (o OR (NOT bool_or(o) OVER w AND idx = b)) AS is_mixout, l AS loopable FROM f WINDOW w AS (PARTITION BY track_id)""")
def mix_flags(spark, d):
    return structure.mix_flags(_sections(spark, d).select("track_id", "idx", "label")).withColumn("idx", F.col("idx").cast("int"))


@query("SELECT DISTINCT s.id, nullif(round_even((s.end_s::DOUBLE - s.start_s::DOUBLE) * t.bpm::DOUBLE / 240, 0)::INT, 0) AS bars FROM sections s JOIN tracks t ON t.id = s.track_id")
def section_bars(spark, d):
    s = _sections(spark, d).join(table(spark, d, "tracks").select(F.col("id").alias("track_id"), "bpm"), "track_id")
    return s.select("id", structure.bars(F.col("end_s").cast("double") - F.col("start_s").cast("double"), F.col("bpm").cast("double")).alias("bars"))


def _grids(spark, d) -> DataFrame:
    s = _sections(spark, d).select("track_id", F.struct("idx", F.col("start_s").cast("double").alias("s"), F.col("end_s").cast("double").alias("e")).alias("r"))
    g = s.groupBy("track_id").agg(F.array_sort(F.collect_list("r")).alias("r")).select("track_id", F.transform("r", lambda r: r["s"]).alias("starts"), F.transform("r", lambda r: r["e"]).alias("ends"))
    t = table(spark, d, "tracks").select(F.col("id").alias("track_id"), F.col("bpm").cast("double").alias("bpm"), F.coalesce(F.nanvl(F.col("first_downbeat_s").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("t0"))
    j = g.join(t, "track_id")
    beats = F.greatest(F.lit(1), F.floor((F.element_at("ends", -1) - F.col("t0")) * F.col("bpm") / 60).cast("int"))
    return j.withColumn("beats", F.transform(F.sequence(F.lit(0), beats), lambda i: F.col("t0") + i * 60 / F.col("bpm")))


@query()
def snapped_sections(spark, d):
    g = _grids(spark, d)
    return g.select("track_id", F.posexplode(structure.snap("starts", "ends", structure.downbeats(F.col("beats"), F.lit(0)), F.lit(2.0))).alias("i", "x")).select("track_id", "i", F.round("x.start", 4).alias("start"), F.round("x.end", 4).alias("end"))


@query()
def merged_sections(spark, d):
    return _grids(spark, d).select("track_id", F.posexplode(structure.merge_short("starts", "ends", F.lit(40.0))).alias("i", "x")).select("track_id", "i", F.round("x.start", 4).alias("start"), F.round("x.end", 4).alias("end"))


@query("SELECT id AS track_id, len(list_filter(range(0, 64), lambda i: i >= id % 4 AND (i - id % 4) % 4 = 0))::INT AS n_downbeats FROM tracks")
def downbeat_counts(spark, d):
    return table(spark, d, "tracks").select(F.col("id").alias("track_id"), F.size(structure.downbeats(F.sequence(F.lit(0), F.lit(63)), (F.col("id") % 4).cast("int"))).alias("n_downbeats"))


# --- texts and exports ---------------------------------------------------------------------------------------------------


@query(r"""SELECT id, tag, pos::INT AS pos FROM (SELECT id, unnest(l) AS tag, unnest(range(len(l))) AS pos FROM (SELECT id, list_distinct_ordered AS l FROM (SELECT id, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(list_transform(string_split_regex(x, '[,;/|]+|\s{2,}'), lambda y: lower(trim(y))), lambda y: y <> ''), lambda y: [y])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS list_distinct_ordered
    FROM (SELECT id, coalesce(array_to_string(tags, ' / '), '') || ', ' || coalesce(genre, '') || '  ' || coalesce(genre, '') AS x FROM tracks))))""")
def tag_lists(spark, d):
    x = F.concat(F.coalesce(F.array_join("tags", " / "), F.lit("")), F.lit(", "), F.coalesce("genre", F.lit("")), F.lit("  "), F.coalesce("genre", F.lit("")))
    return table(spark, d, "tracks").select("id", F.posexplode(text.tags(x)).alias("pos", "tag")).select("id", "tag", "pos")


@query(r"""SELECT id, CASE WHEN m THEN trim(regexp_extract(title, '^(.*?)( - | – | — | \| )(.*)$', 1)) ELSE trim(coalesce(artist, '')) END AS artist, trim(regexp_replace(regexp_replace(CASE WHEN m THEN regexp_extract(title, '^(.*?)( - | – | — | \| )(.*)$', 3) ELSE title END, '\s*【[^】]*】', '', 'g'),
    '@@NOTE@@', '', 'gi')) AS title FROM (SELECT id, title, artist, regexp_matches(title, '^(.*?)( - | – | — | \| )(.*)$') AS m FROM pending_taste WHERE title IS NOT NULL)""".replace("@@NOTE@@", text.BRACKETED_NOTE))
def title_split(spark, d):
    a, t = text.split_title(F.col("title"), F.coalesce("artist", F.lit("")))
    return table(spark, d, "pending_taste").where("title is not null").select("id", a.alias("artist"), t.alias("title"))


_URL = "CASE id % 7 WHEN 0 THEN 'https://open.spotify.com/track/' || id WHEN 1 THEN 'spotify:album:' || id WHEN 2 THEN 'https://www.youtube.com/watch?v=v' || id || '&list=x' WHEN 3 THEN 'youtu.be/' || id WHEN 4 THEN 'https://open.spotify.com/intl-pt/playlist/' || id || '?si=1' WHEN 5 THEN 'https://music.youtube.com/playlist?list=l' || id ELSE 'https://elsewhere.example/' || id END"


@query("SELECT id, CASE id % 7 WHEN 0 THEN 'spotify' WHEN 1 THEN 'spotify' WHEN 2 THEN 'youtube' WHEN 3 THEN 'youtube' WHEN 4 THEN 'spotify' WHEN 5 THEN 'youtube' END AS service, CASE id % 7 WHEN 0 THEN 'track' WHEN 1 THEN 'album' WHEN 2 THEN 'video' WHEN 3 THEN 'video' WHEN 4 THEN 'playlist' WHEN 5 THEN 'playlist' END AS kind, CASE id % 7 WHEN 2 THEN 'v' || id WHEN 5 THEN 'l' || id WHEN 6 THEN NULL ELSE id::VARCHAR END AS link_id FROM tracks")
def link_classify(spark, d):
    t = table(spark, d, "tracks").select("id", F.expr(_URL).alias("url"))
    return t.select("id", text.link(F.col("url")).alias("l")).select("id", "l.service", "l.kind", F.col("l.id").alias("link_id"))


@query("""SELECT p.id AS request_id, max_by(t.id, (s, -t.id)) AS best, max(s) AS score FROM (SELECT id, artist, title, CASE WHEN duration_s > 5000 THEN duration_s::DOUBLE / 1000 ELSE duration_s::DOUBLE END AS dur FROM pending_taste WHERE artist IS NOT NULL) p JOIN tracks t ON t.artist = p.artist, LATERAL (SELECT round(CASE WHEN p.dur IS NULL THEN 0.0 WHEN coalesce(t.duration_s, 0) = 0 THEN -50.0 ELSE -abs(t.duration_s::DOUBLE - p.dur) - CASE WHEN abs(t.duration_s::DOUBLE - p.dur) > 25 THEN 500.0 ELSE 0.0 END END
    + CASE WHEN t.artist LIKE '% - Topic' THEN 30.0 ELSE 0.0 END + CASE WHEN contains(lower(coalesce(t.title, '')), 'official audio') THEN 20.0 WHEN regexp_matches(lower(coalesce(t.title, '')), '\\baudio\\b') THEN 10.0 ELSE 0.0 END"""
       + "".join(f" - CASE WHEN regexp_matches(lower(coalesce(t.title, '')), '\\b{w}\\b') AND NOT regexp_matches(lower(coalesce(p.title, '')), '\\b{w}\\b') THEN 40.0 ELSE 0.0 END" for w in ("live", "sped up", "slowed", "music video", "reaction", "cover")) + ", 6) AS s) GROUP BY p.id")
def pick_best(spark, d):
    p = table(spark, d, "pending_taste").where("artist is not null").select(F.col("id").alias("request_id"), "artist", F.col("title").alias("request_title"), F.when(F.col("duration_s") > 5000, F.col("duration_s").cast("double") / 1000).otherwise(F.col("duration_s").cast("double")).alias("target_s"))
    t = table(spark, d, "tracks").select("artist", F.col("artist").alias("uploader"), F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), "title", F.col("duration_s").cast("double").alias("duration"))
    best = identity.pick_best(p.join(t, "artist"))
    return best.select("request_id", F.col("id").cast("long").alias("best"), F.round("score", 6).alias("score"))


def _played(spark, d) -> DataFrame:
    t = table(spark, d, "tracks").groupBy("path").agg(F.min(F.col("duration_s").cast("double")).alias("duration_s"))
    return _slots(spark, d).join(t, "path", "left").withColumn("cue_end_s", F.lit(None).cast("double"))


@query(f"""WITH slots AS ({_SLOTS}) SELECT set_id, '#EXTM3U' || chr(10) || string_agg('#EXTINF:' || coalesce(CASE WHEN d > 0 THEN round_even(d, 0)::INT END, -1) || ',' || coalesce(artist, '') || ' - ' || coalesce(title, '') || chr(10) || path, chr(10) ORDER BY i) || chr(10) AS text
    FROM slots LEFT JOIN (SELECT path, min(duration_s)::DOUBLE AS d FROM tracks GROUP BY 1) USING (path) GROUP BY set_id""")
def m3u8_lists(spark, d):
    return exports.m3u8(_played(spark, d))


@query(f"WITH slots AS ({_SLOTS}), f AS (SELECT set_id, i, path, min(i) OVER (PARTITION BY set_id, path) AS fi FROM slots) SELECT set_id, i::INT AS i, path, dense_rank() OVER (PARTITION BY set_id ORDER BY fi)::INT AS track_no, i = fi AS first FROM f")
def playlist_collection(spark, d):
    return exports.collection(_slots(spark, d)).select("set_id", "i", "path", "track_no", "first")


@query()
def set_sheets(spark, d):
    s, f = _fades(spark, d)
    return exports.sheet(s, f)
