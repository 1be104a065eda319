"""Nearest rows with hard filters, and the blended ranking of a bounded acoustic pool."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import vectors


@dataclass(frozen=True)
class Blend:
    """Weights of acoustic similarity, taste similarity and rating."""

    acoustic: float = 0.5
    taste: float = 0.4
    rating: float = 0.1


def where(bpm: tuple[float, float] | None = None, camelot: set[str] | None = None, favourite: bool = False, exclude_paths: list[str] | None = None, exclude_path: str | None = None) -> Column:
    """The filters joined by AND; absent, false and empty ones filter nothing."""
    cond = F.lit(True)
    if bpm:
        cond &= F.col("bpm").between(*bpm)
    if camelot:
        cond &= F.col("camelot").isin(*sorted(camelot))
    if favourite:
        cond &= F.col("is_favorite")
    if left_out := [*(exclude_paths or []), *([exclude_path] if exclude_path else [])]:
        cond &= ~F.col("path").isin(*left_out)
    return cond


def nearest(tracks: DataFrame, queries: DataFrame, k: int = 10, cond: Column | None = None, vec: str = "embedding") -> DataFrame:
    """(qid, id, distance): the ``k`` nearest rows that pass the filters, other than the query itself."""
    rows = tracks if cond is None else tracks.where(cond)
    return vectors.nearest_rows(rows.select("id", F.col(vec).alias("v")), queries.select("id", F.col(vec).alias("v")), k)


def nearest_section(sections: DataFrame, tracks: DataFrame, queries: DataFrame, k: int = 10, cond: Column | None = None, mixin: bool | None = None, mixout: bool | None = None) -> DataFrame:
    """As ``nearest`` over section vectors; filters are on the parent track, flags on the section when given."""
    parents = (tracks if cond is None else tracks.where(cond)).select(F.col("id").alias("track_id"))
    rows = sections.dropDuplicates(["id"])
    for name, want in (("is_mixin", mixin), ("is_mixout", mixout)):
        if want is not None:
            rows = rows.where(F.col(name) == want)
    return vectors.nearest_rows(rows.join(parents, "track_id", "left_semi").select("id", F.col("embedding").alias("v")), queries.dropDuplicates(["id"]).select("id", F.col("embedding").alias("v")), k)


def confidence(source: Column, stored: Column) -> Column:
    """How far a taste label counts: 1 by hand, the stored value (else 0.5) when propagated, 0 otherwise."""
    return F.when(source == "manual", 1.0).when(source == "propagated", F.coalesce(stored.cast("double"), F.lit(0.5))).otherwise(0.0)


def blend(acoustic: Column, taste: Column, rating: Column, source: Column, stored: Column, w: Blend = Blend()) -> Column:
    """Unknown taste and rating count 0."""
    return F.lit(w.acoustic) * acoustic + F.lit(w.taste) * confidence(source, stored) * F.coalesce(taste, F.lit(0.0)) + F.lit(w.rating) * F.coalesce(rating.cast("double"), F.lit(0.0)) / 5


def ranked(tracks: DataFrame, queries: DataFrame, k: int = 10, pool: int = 200, cond: Column | None = None, w: Blend = Blend()) -> DataFrame:
    """(qid, id, path, score): the acoustic pool of each query, reordered by the blend; ties by distance, then id."""
    near = nearest(tracks, queries, pool, cond)
    rows = tracks.select("id", "path", F.col("taste_vec").alias("tv"), "rating", "taste_source", "taste_confidence")
    asked = queries.select(F.col("id").alias("qid"), F.col("taste_vec").alias("qv"))
    scored = near.join(rows, "id").join(asked, "qid").withColumn("score", F.round(blend(1 - F.col("distance"), vectors.cosine(F.col("tv"), F.col("qv")), F.col("rating"), F.col("taste_source"), F.col("taste_confidence"), w), 9))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "distance", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "id", "path", "score", "rank")
