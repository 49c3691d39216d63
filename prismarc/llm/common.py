"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it, and its separators.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table, as they lie: tables of all sizes are read by one plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one is set only where none is and the session is a local one (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster the operators need a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="prismarc-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that ``cut`` and ``fresh_path`` made and nobody has deleted yet.
_alive: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again, so that lost executors cost nothing upstream.

    The shuffle files of the write go with its end, the table goes with ``drop`` or ``sweep``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._table)


def mark() -> int:
    """A point to ``sweep`` back to."""
    return len(_alive)


def sweep(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Delete the folders made since ``mark`` but those of ``keep``; for when the result that reads them has been written."""
    for path in _alive[since:]:
        if path not in [df._table for df in keep]:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _alive:
        _alive.remove(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _alive.append(path)
    return path


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column ``name`` holds about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        sizes = [len(x or b"") for x in as_bytes(batch, name)]
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 64
        if start < batch.num_rows:
            yield batch.slice(start)


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by place, so that none clashes with a name used here; and the new names.  ``toDF`` turns it back."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def null_key(name: str):
    """A string that orders and joins as the column does, null apart from every value."""
    return F.coalesce(F.concat(F.lit("v"), F.col(name).cast("string")), F.lit("n"))
