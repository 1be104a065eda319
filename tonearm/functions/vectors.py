"""Vector columns: cosine similarity, exact nearest rows in blocks, means."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; null if either side is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _units(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest_rows(rows: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(qid, id, distance): the ``k`` rows of least cosine distance for each query, ties by id; a row never answers its own id.

    ``rows`` and ``queries`` have (id, v). The stated queries come to the executors in blocks of at most ``block`` vectors; each
    partition of the rows keeps its own ``k`` best, so what is shuffled does not grow with the rows of a partition. Rows without a vector take no part.
    """
    spark = rows.sparkSession
    rows = rows.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), "v")
    it = queries.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), "v").toLocalIterator()
    parts = []
    while chunk := list(itertools.islice(it, block)):
        sent = spark.sparkContext.broadcast((np.array([r.id for r in chunk]), np.array([r.v for r in chunk], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qid, q = sent.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            ids, dist = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))
            for b in batches:
                for start in range(0, len(b), 2000):
                    part = b.iloc[start : start + 2000]
                    own = part["id"].to_numpy()
                    d = np.round(1 - q @ _units(part["v"]).T, 9)
                    d[qid[:, None] == own[None, :]] = np.inf
                    ids = np.concatenate([ids, np.broadcast_to(own, d.shape)], axis=1)
                    dist = np.concatenate([dist, d], axis=1)
                    order = np.lexsort((ids, dist), axis=1)[:, :k]
                    ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
            keep = np.isfinite(dist)
            yield pd.DataFrame({"qid": np.broadcast_to(qid[:, None], dist.shape)[keep], "id": ids[keep], "distance": dist[keep]})

        parts.append(rows.mapInPandas(run, "qid long, id long, distance double"))
    if not parts:
        return spark.createDataFrame([], "qid long, id long, distance double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def nearest_of(rows: DataFrame, queries: DataFrame, k: int, block: int = 8192, most: int = 256 << 20) -> DataFrame:
    """``nearest_rows`` for few ``rows`` and any number of ``queries``: the rows go to the executors, the queries are read once and not shuffled.

    Rows travel in blocks of at most ``block`` vectors, and blocks of at most ``most`` bytes together are held by an executor; where the rows are more, the queries are read once again
    for each further part of that size, and the parts' answers are merged.
    """
    spark = rows.sparkSession
    rows = rows.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), "v")
    queries = queries.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), "v")
    kind = "qid long, id long, distance double"

    def answers(held: list) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for start in range(0, len(b), 500):
                    part = b.iloc[start : start + 500]
                    qid, q = part["id"].to_numpy(), _units(part["v"])
                    ids, dist = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))
                    for sent in held:
                        own, x = sent.value
                        d = np.round(1 - q @ x.T, 9)
                        d[qid[:, None] == own[None, :]] = np.inf
                        ids, dist = np.concatenate([ids, np.broadcast_to(own, d.shape)], axis=1), np.concatenate([dist, d], axis=1)
                        order = np.lexsort((ids, dist), axis=1)[:, :k]
                        ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
                    keep = np.isfinite(dist)
                    yield pd.DataFrame({"qid": np.broadcast_to(qid[:, None], dist.shape)[keep], "id": ids[keep], "distance": dist[keep]})

        return queries.mapInPandas(run, kind)

    it, parts, held, size = rows.toLocalIterator(), [], [], 0
    while chunk := list(itertools.islice(it, block)):
        x = np.array([r.v for r in chunk], dtype=np.float64)
        if held and size + x.nbytes > most:
            parts.append(answers(held))
            held, size = [], 0
        held, size = [*held, spark.sparkContext.broadcast((np.array([r.id for r in chunk]), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)))], size + x.nbytes
    if held:
        parts.append(answers(held))
    if len(parts) < 2:
        return parts[0] if parts else spark.createDataFrame([], kind)
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return functools.reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def mean_vector(df: DataFrame, group: list[str], vec: str, weight: Column | None = None) -> DataFrame:
    """The (weighted) mean of a vector column in each group, from sums by position that combine before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    long = df.where(F.col(vec).isNotNull()).select(*group, w.alias("__w"), F.posexplode(vec).alias("__i", "__x"))
    means = long.groupBy(*group, "__i").agg((F.sum(F.col("__x").cast("double") * F.col("__w")) / F.sum("__w")).alias("__m"))
    return means.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("mean"))


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm > 1e-9, norm).otherwise(1.0))
