"""Where the query modules register their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def n() -> F.Column:
    return F.count(F.lit(1))


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
