"""Structured Streaming wrappers: watermarked windows, first-writer dedup, version state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_dir


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_writer(events: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first row of each key; keys are forgotten after ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def commit_then_advance(sink: Callable[[DataFrame, int], None], state: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the state follows the sink, so a failed batch leaves it where it was.  Both must be idempotent by batch id."""

    def batch(df: DataFrame, n: int) -> None:
        sink(df, n)
        state(df, n)

    return batch


def run_to_files(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream to the end of its input; what each batch gives is written to the shared folder, where the offsets are kept, too.

    Append gives the rows of all batches, complete those of the last one.
    """
    spark = df.sparkSession
    path, batches = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}", []

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")
        batches.append(n)

    query = df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = sorted(set(batches)) if mode == "append" else batches[-1:]
    return spark.read.schema(df.schema).parquet(*[f"{path}/batch={n}" for n in kept]) if kept else spark.createDataFrame([], df.schema)
