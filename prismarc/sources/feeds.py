"""Python data sources: paged lists over any transport, and SQLite tables read-only.

``register(spark)`` makes them known as ``prismarc_pages`` and ``prismarc_sqlite``.
"""

from __future__ import annotations

import importlib
import json
import sqlite3
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Span(InputPartition):
    first: int
    last: int


def spans(first: int, last: int, many: int) -> list[Span]:
    """``many`` or fewer stretches of first to last, both included."""
    size = max(1, -(-(last - first + 1) // many))
    return [Span(a, min(last, a + size - 1)) for a in range(first, last + 1, size)]


class PagedReader(DataSourceReader):
    """Pages ``first`` to ``last`` through ``transport`` (module:function of a page number, giving a list of objects or None after the end).

    A task makes ``per_second`` calls at most and tries a page ``tries`` times; a page that fails every time fails the job.
    """

    def __init__(self, schema, options: dict) -> None:
        self.names = [f.name for f in schema.fields]
        self.options = options

    def partitions(self) -> list[Span]:
        o = self.options
        return spans(int(o.get("first", 1)), int(o["last"]), int(o.get("partitions", 4)))

    def read(self, partition: Span) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        call = getattr(importlib.import_module(module), name)
        pause, tries, last = 1 / float(self.options.get("per_second", 1000)), int(self.options.get("tries", 3)), 0.0
        for page in range(partition.first, partition.last + 1):
            for left in range(tries - 1, -1, -1):
                time.sleep(max(0.0, last + pause - time.monotonic()))
                last = time.monotonic()
                try:
                    rows = call(page)
                    break
                except OSError:
                    if not left:
                        raise
            if rows is None:
                return
            for row in rows:
                yield tuple(json.dumps(v) if isinstance(v, (dict, list)) else v for v in (row.get(k) for k in self.names))


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prismarc_pages"

    def schema(self) -> str:
        return "id long, version string, body string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)


class SqliteReader(DataSourceReader):
    """Table ``table`` of the file ``path`` (on a folder that all machines see), by ranges of its row numbers; the file is never written, locked or journalled."""

    def __init__(self, schema, options: dict) -> None:
        self.names, self.options = [f.name for f in schema.fields], options

    def open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro&immutable=1", uri=True)

    def quoted(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def partitions(self) -> list[Span]:
        with self.open() as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.quoted(self.options['table'])}").fetchone()
        return [] if low is None else spans(low, high, int(self.options.get("partitions", 4)))

    def read(self, partition: Span | None) -> Iterator[tuple]:
        if partition is None:  # an empty table has no partition
            return
        with self.open() as db:
            columns = ", ".join(map(self.quoted, self.names))
            yield from db.execute(f"SELECT {columns} FROM {self.quoted(self.options['table'])} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))


class Sqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prismarc_sqlite"

    def schema(self) -> str:
        reader = SqliteReader.__new__(SqliteReader)
        reader.options = self.options
        kinds = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "BLOB": "binary"}
        with reader.open() as db:
            return ", ".join(f"`{name}` {kinds.get(kind.upper(), 'string')}" for _, name, kind, *_ in db.execute(f"PRAGMA table_info({reader.quoted(self.options['table'])})"))

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
    spark.dataSource.register(Sqlite)
