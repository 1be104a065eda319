"""Intermediate results that must survive the loss of an executor.

A staged frame is written once as Parquet to the folder all executors share
and read back, so later actions neither recompute it nor depend on blocks kept
by one executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = "file://" + tempfile.mkdtemp(prefix="tonearm-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, with its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: the place of each row in the order of ``order``, from ``start + 1``.

    Rows are range-partitioned and sorted, and written once with their partition and place in it: a second range partitioning would draw other bounds. Then the partitions' sizes, a
    row each, give the offsets, so no task numbers all rows.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    rows = stage(sorted_, "numbered")
    offsets, at = [], start
    for r in rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).orderBy("__p").collect():
        offsets.append((r["__p"], at))
        at += r["n"]
    base = df.sparkSession.createDataFrame(offsets, "__p int, __start long")
    return rows.join(F.broadcast(base), "__p").withColumn(name, F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__p", "__m", "__start")  # a row per partition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder) of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, tasks_per_core: int = 3) -> DataFrame:
    """``df`` over enough tasks for work that is heavy per row, where its files are fewer than the cores.

    A scan that has as many tasks as cores is left alone, so a large table is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(tasks_per_core * cores)
