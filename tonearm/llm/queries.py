"""The pN_ queries: each problem's operator over the whole tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import language, leakage, lookalike, mixing, names, quantise, ranking, recordings, spectral
from tonearm.plans import staging
from tonearm.plans.staging import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The five candidates of each run nearest to its ideal point."""
    scored = ranking.rank_runs(table(spark, d, "track_cards"), table(spark, d, "neighbors"), table(spark, d, "tracks"))
    return ranking.top_per_group(scored.select("run_id", "path", "closeness"), "run_id", "path", 5).select("run_id", "path")


@query
def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of every run with its closeness."""
    scored = ranking.rank_runs(table(spark, d, "track_cards"), table(spark, d, "neighbors"), table(spark, d, "tracks"))
    return scored.select("run_id", "path", F.round("closeness", 6).alias("closeness"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, column in (("tracks", "title"), ("tracks", "artist"), ("pending_taste", "title")):
        t = table(spark, d, name)
        parts.append(t.select(F.lit(f"{name}.{column}").alias("field"), F.col("id").alias("rec_id"), F.col(column).alias("text")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells with at least one irregular character."""
    return lookalike.irregular_cells(_cells(spark, d), "text").select("field", "rec_id").distinct()


@query
def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null cell with its one form."""
    return lookalike.unify(_cells(spark, d).where("text is not null"), ["text"]).select("field", "rec_id", F.col("text_canonical").alias("canonical"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the held-out items they give away."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the target mix that cannot reach their share."""
    _, report = mixing.balance(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.where(~F.col("reachable")).select("source")


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every document of a target source with its copies in the mix."""
    mix, _ = mixing.balance(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mix.select("doc_id", "source", "tokens", "copies")


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of every source."""
    _, report = mixing.balance(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.select("source", "documents", "tokens", "capacity", "reachable", "mixed_tokens", F.round("target_share", 6).alias("target_share"), F.round("share", 6).alias("share"), F.round("share_of_wanted", 6).alias("share_of_wanted"))


def _stretches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame | None]:
    docs = table(spark, d, "documents")
    model = language.train(docs)
    return docs, language.stretches(docs, model) if model else None


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents whose label is missing or wrong, and of those in several languages."""
    docs, segments = _stretches(spark, d)
    if segments is None:
        return spark.createDataFrame([], "doc_id long, lang string")
    return language.corrected(docs, segments).select("doc_id", "lang")


@query
def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    _, segments = _stretches(spark, d)
    if segments is None:
        return spark.createDataFrame([], "doc_id long, segment int, lang string, n_sentences int, confidence double")
    return segments.select("doc_id", "segment", "lang", "n_sentences", F.round("confidence", 6).alias("confidence"))


FIELDS = (("tracks", "embedding", 0.06), ("sections", "embedding", 0.06), ("tracks", "taste_vec", 0.02))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Close pairs of each vector field of which one is among the ten nearest of the other."""
    parts = []
    for name, column, limit in FIELDS:
        pairs = quantise.close_pairs(table(spark, d, name), "id", column, 10, limit)
        parts.append(pairs.select(F.lit(f"{name}.{column}").alias("vec_field"), "id_a", "id_b"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest rows, however far, of every row whose id is divisible by 100."""
    parts = []
    for name, column, _ in FIELDS:
        t = table(spark, d, name)
        near = quantise.neighbours(t, "id", column, 10, queries=t.select("id").where("id % 100 = 0"), rule=quantise.Quantiser(probes=16, beam=16, recall=0.95))
        parts.append(near.select(F.lit(f"{name}.{column}").alias("vec_field"), "id", "neighbour", F.round("distance", 5).alias("distance")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TRACK_FIELDS = (("embedding", 0.06), ("taste_vec", 0.02))


def _groups(spark: SparkSession, d: str, column: str, near: float) -> DataFrame:
    return staging.stage(spectral.grouped(table(spark, d, "tracks"), "id", column, spectral.Spectral(near=near)), "groups")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Probes whose two tracks fall into the same group."""
    parts = []
    probes = table(spark, d, "cluster_probes").select("vec_field", "track_a", "track_b").distinct()
    for column, near in TRACK_FIELDS:
        own = probes.where(F.col("vec_field") == f"tracks.{column}")
        parts.append(spectral.together(own, _groups(spark, d, column, near), "track_a", "track_b"))
    return parts[0].unionByName(parts[1])


@query
def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group of tracks with its size and five most typical tracks."""
    parts = []
    for column, near in TRACK_FIELDS:
        parts.append(spectral.described(_groups(spark, d, column, near)).withColumn("vec_field", F.lit(f"tracks.{column}")))
    return parts[0].unionByName(parts[1]).select("vec_field", "group", "size", "typical")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one person or group."""
    return names.entity_pairs(staging.stage(names.linked(table(spark, d, "artist_credits")), "entities"))


@query
def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with its entity and the posterior of the attribution."""
    return names.linked(table(spark, d, "artist_credits")).select("id", "entity", F.round("posterior", 6).alias("posterior"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each review with the files of the same recording."""
    return recordings.matched(table(spark, d, "pending_taste"), table(spark, d, "tracks")).select("pending_id", "track_id")


@query
def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each match with the rule that made it and its confidence."""
    return recordings.matched(table(spark, d, "pending_taste"), table(spark, d, "tracks")).withColumn("confidence", F.round("confidence", 6))
