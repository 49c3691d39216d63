"""Table functions: a row for each find in a text, and for each session of an ordered partition.

``register(spark)`` makes them known to SQL as ``finds`` and ``sessions_of``;
they stand in a lateral join or take a table argument:

    SELECT t.id, f.* FROM t, LATERAL finds(t.text, 'arguments') f
    SELECT * FROM sessions_of(TABLE(SELECT user_id, ts FROM events) PARTITION BY user_id ORDER BY (ts), 30)

Their columns follow from the kind that is asked for, before anything runs.
A null text has no finds; an unknown kind is an error of the query.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from .normalise import arguments, fences

KINDS = {
    "arguments": (arguments, (("begin", IntegerType()), ("end", IntegerType()), ("name", StringType()), ("default", StringType()))),
    "fences": (fences, (("anchor", StringType()), ("language", StringType()), ("body", StringType()))),
}


@udtf
class Finds:
    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if kind.value not in KINDS:
            raise ValueError(f"finds are of {', '.join(KINDS)}")
        return AnalyzeResult(StructType([StructField("ordinal", IntegerType()), *[StructField(n, t) for n, t in KINDS[kind.value][1]]]))

    def eval(self, text: str | None, kind: str) -> Iterator[tuple]:
        find, columns = KINDS[kind]
        for ordinal, found in enumerate(find(text)):
            yield ordinal, *[found[name] for name, _ in columns]


@udtf
class SessionsOf:
    """Sessions of a partition's rows in their order: a row that comes ``minutes`` or more after the last one begins the next."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, minutes: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or [f.name for f in rows.dataType.fields][1:] != ["ts"]:
            raise ValueError("sessions are of a table of a key and ts")
        return AnalyzeResult(StructType([rows.dataType.fields[0], StructField("session", IntegerType()), StructField("rows", LongType()), StructField("first", TimestampType()), StructField("last", TimestampType())]))

    def __init__(self) -> None:
        self.key = self.first = self.last = None
        self.session = self.rows = 0

    def eval(self, row, minutes: int) -> Iterator[tuple]:
        key, ts = row[0], row[1]
        if ts is None:
            return
        if self.rows and ts - self.last >= datetime.timedelta(minutes=minutes):
            yield self.key, self.session, self.rows, self.first, self.last
            self.session, self.rows = self.session + 1, 0
        self.first = ts if not self.rows else self.first
        self.key, self.last, self.rows = key, ts, self.rows + 1

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield self.key, self.session, self.rows, self.first, self.last


def register(spark: SparkSession) -> None:
    spark.udtf.register("finds", Finds)
    spark.udtf.register("sessions_of", SessionsOf)
