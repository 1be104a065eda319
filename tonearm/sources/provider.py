"""A pluggable batch source: any class with ``tracks(options)`` served through Spark's Python data source API."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, source string, is_favorite boolean, title string, artist string"


class TrackReader(DataSourceReader):
    def __init__(self, owner: type[TrackSource], options: dict) -> None:
        self.owner, self.options = owner, dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.owner.parts(self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.owner.tracks(self.options, partition.value)


class TrackSource(DataSource):
    """Subclass with ``name``, ``parts`` (what one task reads) and ``tracks`` (rows of ``SCHEMA``)."""

    @staticmethod
    def parts(options: dict) -> list:
        return [None]

    @staticmethod
    def tracks(options: dict, part: object) -> Iterator[tuple]:
        raise NotImplementedError

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return TrackReader(type(self), self.options)


def register(spark: SparkSession, source: type[TrackSource]) -> None:
    spark.dataSource.register(source)
