"""Tracks that arrive in a folder, merged into the library batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tonearm.operators.merge import upsert_tracks


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the class of its paths."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, library: str) -> list[int]:
    """The whole versions under ``library``, oldest first."""
    fs, path = _files(spark, library)
    found = fs.globStatus(path(f"{library}/v=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found)


def current(spark: SparkSession, library: str) -> DataFrame:
    """The newest whole version of the library under ``library``."""
    return spark.read.parquet(f"{library}/v={versions(spark, library)[-1]}")


def _origin(spark: SparkSession, library: str, version: int) -> dict | None:
    """Which batch of which checkpoint wrote a version."""
    fs, path = _files(spark, library)
    at = path(f"{library}/v={version}/_batch")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def ingest(spark: SparkSession, incoming: str, library: str, checkpoint: str) -> StreamingQuery:
    """Upserts every new Parquet file of ``incoming`` into the version after the newest.

    A version is written beside the library and renamed into it, with the checkpoint and number of its batch, so readers see whole versions only, and a
    batch that runs again after its version came to be is passed over. One stream writes to a library at a time.
    """
    schema = current(spark, library).schema

    def merge(batch: DataFrame, number: int) -> None:
        newest, origin = versions(spark, library)[-1], {"checkpoint": checkpoint, "batch": number}
        if _origin(spark, library, newest) == origin:
            return
        draft = f"{library}/_draft"
        upsert_tracks(spark.read.parquet(f"{library}/v={newest}"), batch).write.mode("overwrite").parquet(draft)
        fs, path = _files(spark, library)
        out = fs.create(path(f"{draft}/_batch"), True)
        out.write(bytearray(json.dumps(origin).encode()))
        out.close()
        if not fs.rename(path(draft), path(f"{library}/v={newest + 1}")):
            raise OSError(f"version {newest + 1} of {library} could not be put in place")

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
