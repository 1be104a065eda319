"""Taste labels carried over from similar tracks, and the queue of tracks worth labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions import vectors


def corpus(tracks: DataFrame) -> DataFrame:
    """Tracks labelled by hand; an absent rating counts 0."""
    return tracks.where("taste_source = 'manual' and taste_vec is not null").select("id", "embedding", "taste_vec", F.coalesce(F.col("rating").cast("double"), F.lit(0.0)).alias("rating"))


def untagged(tracks: DataFrame) -> DataFrame:
    return tracks.where("coalesce(taste_source, '') <> 'manual'").select("id", "path", "embedding")


def _near(tracks: DataFrame, k: int) -> DataFrame:
    own = corpus(tracks)
    near = vectors.nearest_of(own.select("id", F.col("embedding").alias("v")), untagged(tracks).select("id", F.col("embedding").alias("v")), k)
    return near.join(own.select("id", "taste_vec", "rating"), "id").withColumn("sim", 1 - F.col("distance"))


def propagate(tracks: DataFrame, k: int = 8) -> DataFrame:
    """(id, taste_vec, rating, confidence) of every track not labelled by hand, from its ``k`` nearest labelled ones.

    Weights are the positive similarities; confidence is the weighted mean similarity. Tracks whose weights sum to nothing are left out.
    The stored rating is rounded half to even, 0 becoming null.
    """
    near = _near(tracks, k).withColumn("w", F.greatest("sim", F.lit(0.0)))
    sums = near.groupBy("qid").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("rating")).alias("r"), F.sum(F.col("w") * F.col("sim")).alias("c")).where("total >= 1e-9")
    means = vectors.mean_vector(near, ["qid"], "taste_vec", F.col("w"))
    raw = F.col("r") / F.col("total")
    return sums.join(means, "qid").select(F.col("qid").alias("id"), vectors.unit(F.col("mean")).alias("taste_vec"), raw.alias("raw_rating"), F.nullif(F.rint(raw), F.lit(0.0)).cast("smallint").alias("rating"), (F.col("c") / F.col("total")).alias("confidence"))


def uncertainty(tracks: DataFrame, k: int = 8) -> DataFrame:
    """(id, path, uncertainty): far from the labelled, or between disagreeing ratings; 1 with nothing labelled."""
    near = _near(tracks, k).groupBy("qid").agg(F.avg("sim").alias("m"), F.stddev_pop("rating").alias("s"))
    u = 1 - F.greatest(F.least("m", F.lit(1.0)), F.lit(0.0)) + F.coalesce("s", F.lit(0.0)) / 4
    joined = untagged(tracks).select("id", "path").join(near, F.col("id") == F.col("qid"), "left")
    return joined.select("id", "path", F.when(F.col("m").isNull(), 1.0).otherwise(F.greatest(F.least(u, F.lit(1.0)), F.lit(0.0))).alias("uncertainty"))


def labeling_queue(tracks: DataFrame, n: int = 20, k: int = 8) -> DataFrame:
    """The ``n`` most uncertain tracks, ties by path, both descending."""
    return uncertainty(tracks, k).withColumn("uncertainty", F.round("uncertainty", 6)).orderBy(F.col("uncertainty").desc(), F.col("path").desc()).limit(n)
