"""Ranks over groups of any size: range partitions are counted and numbered, so no group has to fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import written


def ranks(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with the 1-based rank of each row within its group, ascending by ``order`` (which must be unique within a group).

    The range-partitioned rows are written once: their bounds are sampled, and the count and the numbering must see the same ones.
    The offsets have one row a group and partition.
    """
    ranged = written(rows.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return ranged.withColumn("_own", own).join(offsets, same).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).select(*rows.columns, name)


def running_sums(rows: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over its group up to and including each row, by ``order`` (unique within a group); no group has to fit one task."""
    ranged = written(rows.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*groups, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return ranged.withColumn("_own", own).join(offsets, same).withColumn(name, F.coalesce("_own", F.lit(0)) + F.col("_before")).select(*rows.columns, name)
