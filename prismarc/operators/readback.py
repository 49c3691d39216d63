"""Stores that are compared by digests, level by level, before readers see them.

A store keeps its rows in folders by the first ``LEAF`` bits of the hash of
their key, and beside them a small table of digests, one a leaf.  Two stores are
compared from the root down, ``STEP`` bits a level: only the children of ranges
that differ are looked at, and only rows of leaves that differ are read again.
A digest is the number of rows and two sums of row hashes, so it doesn't depend
on order or files.  A store becomes the current one of its place by a claim of
the next number, once what was read back is equal to what it was made from.

Null keys are keys.  Repeated rows count: a key whose rows differ in number is
changed.  Both stores must have the same columns.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .tables import Files

LEAF, STEP = 8, 4
ROWS, DIGESTS, CURRENT = "rows", "digests", "_current"


class NotEqual(RuntimeError):
    """What was read back isn't what was written."""


def with_leaf(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("_leaf", IntegerType())])


def leaf(key: list[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - LEAF).cast("int")


def digests(rows: DataFrame, by: str) -> DataFrame:
    """by, n, a, b of each range: the sums wrap, as they are of halves of hashes in decimals."""
    own = [c for c in sorted(rows.columns) if c != by]
    parts = [F.sum(F.xxhash64(*own, F.lit(seed)).cast("decimal(38,0)")).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *parts)


def stage(rows: DataFrame, path: str, key: list[str]) -> None:
    """Writes the rows, then the digests of what is read back from the rows' files."""
    spark = rows.sparkSession
    rows.withColumn("_leaf", leaf(key)).repartition("_leaf", F.pmod(F.xxhash64(*key), F.lit(8))).write.partitionBy("_leaf").parquet(f"{path}/{ROWS}")
    stored = spark.read.schema(with_leaf(rows.schema)).parquet(f"{path}/{ROWS}")
    digests(stored, "_leaf").coalesce(1).write.parquet(f"{path}/{DIGESTS}")  # a row a leaf


def stored_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_leaf int, n long, a decimal(38,0), b decimal(38,0)").parquet(f"{path}/{DIGESTS}")


def differing(left: DataFrame, right: DataFrame) -> tuple[list[int], list[dict[str, int]]]:
    """The leaves that differ, and for each level how many ranges were compared and how many differ; 2 ** LEAF leaves at most."""
    level, compared, open_ = 0, [], [0]
    while True:
        shift = LEAF - level
        up = lambda t: t.withColumn("_range", F.shiftright("_leaf", shift)).filter(F.col("_range").isin(open_)).groupBy("_range").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))  # noqa: E731, B023
        told = up(left).join(up(right).toDF("_range", "n2", "a2", "b2"), "_range", "full")
        same = F.col("n").eqNullSafe(F.col("n2")) & F.col("a").eqNullSafe(F.col("a2")) & F.col("b").eqNullSafe(F.col("b2"))
        found = sorted(r[0] for r in told.filter(~same).select("_range").collect())
        compared.append({"level": level // STEP, "compared": len(open_), "differ": len(found)})
        if not found or level == LEAF:
            return found, compared
        level += STEP
        open_ = [(r << STEP) + k for r in found for k in range(1 << STEP)]


def differences(spark: SparkSession, left: str, right: str, schema: StructType, key: list[str]) -> tuple[DataFrame, list[dict[str, int]]]:
    """(key columns, state), and the ranges compared by level.  A state is ``missing`` (on the right), ``extra`` or ``changed``."""
    leaves, compared = differing(stored_digests(spark, left), stored_digests(spark, right))
    sides = []
    for sign, path in ((1, left), (-1, right)):
        rows = spark.read.schema(with_leaf(schema)).parquet(f"{path}/{ROWS}").filter(F.col("_leaf").isin(leaves))
        own = [c for c in sorted(rows.columns) if c != "_leaf"]
        sides.append(rows.select(*key, F.lit(sign).alias("_sign"), F.xxhash64(*own, F.lit(1)).alias("_a"), F.xxhash64(*own, F.lit(2)).alias("_b")))
    counted = sides[0].unionByName(sides[1]).groupBy(*key, "_a", "_b").agg(F.sum("_sign").alias("_off"), F.count_if(F.col("_sign") > 0).alias("_l"), F.count_if(F.col("_sign") < 0).alias("_r"))
    told = counted.groupBy(*key).agg(F.bool_or(F.col("_off") != 0).alias("_differs"), F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).filter("_differs")
    state = F.when(F.col("_r") == 0, "missing").when(F.col("_l") == 0, "extra").otherwise("changed")
    return told.select(*key, state.alias("state")), compared


def publish(rows: DataFrame, root: str, key: list[str]) -> str:
    """Stages the rows, compares what came back with them, and makes the store the current one; its path.

    A store that isn't equal stays where it is, and readers go on with the one before.
    """
    spark = rows.sparkSession
    path = f"{root}/{uuid.uuid4().hex}"
    stage(rows, path, key)
    own = digests(rows.withColumn("_leaf", leaf(key)), "_leaf")
    if found := differing(own, stored_digests(spark, path))[0]:
        raise NotEqual(f"{len(found)} ranges of {path} differ from what was written")
    files = Files(spark, root)
    while not files.claim(json.dumps({"path": path}), CURRENT, f"v{len(files.names(CURRENT)):019d}.json"):
        pass
    return path


def current(spark: SparkSession, root: str) -> str | None:
    """The path of the store that readers see."""
    files = Files(spark, root)
    there = [n for n in files.names(CURRENT) if n.startswith("v")]
    return json.loads(files.text(CURRENT, there[-1]))["path"] if there else None
