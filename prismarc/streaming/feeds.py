"""Streams with offsets of their own: the changes of a stored table, and paged lists that grow.

``table_changes`` follows a table of ``operators.tables``: an offset is a version,
a batch holds what the versions since the last one brought, and a batch that
fails is read again as it was, because versions don't change.  ``page_feed``
follows a paged list: an offset is the number of pages read.  Offsets live in
the checkpoint of the query, so a restart goes on where the last whole batch
ended.

A folder of changes is read file by file through ``pyarrow.fs``; only the names
of files reach the driver.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructType

from ..operators import tables
from ..sources.feeds import PagedReader, Span, spans
from ..sources.sinks import Place

VERSION = "_version"


@dataclass
class ChangeFile(InputPartition):
    version: int
    folder: str
    name: str


class ChangeReader(DataSourceStreamReader):
    """Offsets are versions; the one before the first to read is where a new query starts."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.place, self.columns = Place(options["path"]), schema.fieldNames()
        self.first = int(options.get("after", -1))
        self.types = schema

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.place.names(tables.VERSIONS) if n.startswith("v")]

    def initialOffset(self) -> dict:
        return {"version": self.first}

    def latestOffset(self) -> dict:
        return {"version": max(self.versions(), default=self.first)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        there, out = self.versions(), []
        for v in range(start["version"] + 1, end["version"] + 1):
            if v not in there:
                raise ValueError(f"version {v} of {self.place.uri} is gone; start anew after it")
            told = json.loads(self.place.get(tables.VERSIONS, f"v{v:019d}.json"))["changes"]
            if told:
                out += [ChangeFile(v, told, n) for n in self.place.names(tables.CHANGES, told) if n.endswith(".parquet") and not n.startswith((".", "_"))]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not isinstance(partition, ChangeFile):
            return
        fs, path = self.place._at[0], self.place.under(tables.CHANGES, partition.folder, partition.name)
        want = to_arrow_schema(self.types)
        for batch in pq.ParquetFile(fs.open_input_file(path)).iter_batches(10_000):
            told = {n: batch.column(n) for n in batch.schema.names} | {VERSION: pa.array([partition.version] * batch.num_rows, pa.int64())}
            yield pa.RecordBatch.from_arrays([told[f.name].cast(f.type) for f in want], schema=want)

    def commit(self, end: dict) -> None:
        pass  # versions stay until the table is vacuumed


class TableChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "table_changes"

    def schema(self) -> StructType:
        place = Place(self.options["path"])
        last = max(n for n in place.names(tables.VERSIONS) if n.startswith("v"))
        return StructType.fromJson(json.loads(place.get(tables.VERSIONS, last))["schema"]).add(tables.ACTION, StringType()).add(VERSION, LongType())

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(self.options, schema)


class PageFeedReader(DataSourceStreamReader):
    """``transport`` (module:function) gives the rows of a page, None after the end; ``count`` (module:function) says how many pages there are."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.pages, self.options = PagedReader(schema, options), options

    def initialOffset(self) -> dict:
        return {"page": int(self.options.get("first", 1)) - 1}

    def latestOffset(self) -> dict:
        module, _, name = self.options["count"].partition(":")
        return {"page": max(self.initialOffset()["page"], int(getattr(importlib.import_module(module), name)()))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["page"] <= start["page"]:
            return [Span(1, 0)]
        return list(spans(start["page"] + 1, end["page"], int(self.options.get("partitions", 4))))

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from self.pages.read(partition)


class PageFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_feed"

    def schema(self) -> str:
        return "id long, version string, body string"

    def streamReader(self, schema: StructType) -> PageFeedReader:
        return PageFeedReader(schema, self.options)


def changes_of(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """The changes of a stored table as a stream."""
    spark.dataSource.register(TableChanges)
    return spark.readStream.format("table_changes").option("path", path).option("after", after).load()


def pages_of(spark: SparkSession, **options: object) -> DataFrame:
    spark.dataSource.register(PageFeed)
    return spark.readStream.format("page_feed").options(**options).load()


def drained(df: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs ``batch`` over what there is and ends; a batch that fails ends the run, and the next run begins with it."""
    df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def mirrored(spark: SparkSession, source: str, target: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Brings the stored table ``target`` up to the version of ``source``: the rows of a batch first, then the offset.

    The batch's number is that of the merge, so a batch that is run again after its merge does nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        gone = F.col(tables.ACTION) == "deleted"
        last = tables.latest_rows(rows, tables.version(spark, source).key, VERSION)
        kept, keys = shape(last.filter(~gone)).drop(tables.ACTION, VERSION), last.filter(gone).drop(tables.ACTION, VERSION)
        every = kept.withColumn("__gone", F.lit(False)).unionByName(keys.withColumn("__gone", F.lit(True)), allowMissingColumns=True)
        tables.merge(spark, target, every, batch=f"batch {number}", delete_by="__gone")

    drained(changes_of(spark, source), batch, checkpoint)
