"""How a set fits the owner's taste, and two rankings side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions import vectors


def known() -> Column:
    return F.col("is_favorite") | (F.coalesce("taste_source", F.lit("")) == "manual")


def centroid(tracks: DataFrame) -> DataFrame:
    """One row: the unit mean taste vector of the favourites; none without favourites."""
    mean = vectors.mean_vector(tracks.where("is_favorite").withColumn("__all", F.lit(1)), ["__all"], "taste_vec")
    return mean.select(vectors.unit(F.col("mean")).alias("centroid"))


def scores(slots: DataFrame, tracks: DataFrame) -> DataFrame:
    """(set_id, n, n_with_taste, taste_match, discovery): mean similarity to the centroid, and the share of slots not yet known; a path counts each time it is played."""
    s = slots.select("set_id", "path").join(tracks.select("path", "taste_vec", known().alias("known")), "path")
    s = s.join(F.broadcast(centroid(tracks)), how="left")  # one row
    return s.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("taste_vec").alias("n_with_taste"), F.coalesce(F.avg(vectors.dot(F.col("taste_vec"), F.col("centroid"))), F.lit(0.0)).alias("taste_match"), F.avg((~F.col("known")).cast("double")).alias("discovery")
    )


def compare(tracks: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, discovery_blend, discovery_acoustic, rating_delta) of two rankings of the same queries."""
    facts = tracks.select("id", F.col("rating").cast("double").alias("rating"), known().alias("known"))

    def side(r: DataFrame, name: str) -> DataFrame:
        return r.select("qid", "id").join(facts, "id").groupBy("qid").agg(F.avg((~F.col("known")).cast("double")).alias("discovery_" + name), F.avg("rating").alias("r_" + name))

    j = side(a, "blend").join(side(b, "acoustic"), "qid")
    return j.select("qid", F.round("discovery_blend", 6).alias("discovery_blend"), F.round("discovery_acoustic", 6).alias("discovery_acoustic"), F.round(F.coalesce("r_blend", F.lit(0.0)) - F.coalesce("r_acoustic", F.lit(0.0)), 6).alias("rating_delta"))
