"""Stored tables with versions, merged into by key: copy on write by bucket.

A row lives in the bucket of its key's hash.  A version is a manifest that names
a folder for each bucket that has rows; its number is claimed by a rename that
fails where the name is taken, so of two writers that start from one version the
second fails, and its data goes.  A merge reads the keys and hashes of the
buckets that the source touches, rewrites those in which a row really changes,
and names the old folders for the rest.  A merge that changes nothing writes no
version.  A batch that a version names already isn't applied again.

Beside the rows a version keeps what it changed (``changes``): the rows that came
or were updated and those that went, so readers can follow a table without
reading it again.

Folders of old versions stay until ``vacuum``; a reader of any kept version sees
the same rows always.  Manifests have a line a bucket, whatever the rows.

A null key is a key like others.  Keys must be unique in the source unless
``order`` says which of their rows is the last; null orders come first, and of
equal ones the row with the greatest hash stays.  Further columns of the source
raise; missing ones are null.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

BUCKETS = 64
VERSIONS, ROWS, BATCHES, CHANGES = "_versions", "rows", "_batches", "changes"


#: The column of ``changes`` that says what became of a row.
ACTION = "_change"


class StaleWriter(RuntimeError):
    """Another version came since the one that the writer read."""


@dataclass
class Version:
    number: int
    key: list[str]
    buckets: int
    schema: dict
    folders: dict[str, str] = field(default_factory=dict)
    batch: str | None = None
    counts: dict[str, int] = field(default_factory=dict)
    changes: str | None = None


class Files:
    """Small files in any store that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def names(self, *folder: str) -> list[str]:
        at = self.path(*folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def text(self, *names: str) -> str | None:
        at = self.path(*names)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def claim(self, text: str, *names: str) -> bool:
        """Writes a file that must not be there yet; False if it is."""
        draft = self.path(*names[:-1], f".{names[-1]}.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName(options.NONE.getClass().getName()), 0)
        try:
            self.context.rename(draft, self.path(*names), none)
            return True
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def drop(self, *names: str) -> None:
        self.fs.delete(self.path(*names), True)


def _name(number: int) -> str:
    return f"v{number:019d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[1:-5]) for n in Files(spark, path).names(VERSIONS) if n.startswith("v")]


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version's manifest; the latest if no number is given."""
    every = versions(spark, path)
    if not every or (number is not None and number not in every):
        raise ValueError(f"no such version: {path} {'' if number is None else number}")
    return Version(**json.loads(Files(spark, path).text(VERSIONS, _name(every[-1] if number is None else number))))


def bucket(key: list[str] | list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _empty(spark: SparkSession, v: Version) -> DataFrame:
    return spark.createDataFrame([], StructType.fromJson(v.schema))


def _rows(spark: SparkSession, path: str, v: Version, only: list[int] | None = None) -> DataFrame:
    folders = [f"{path}/{ROWS}/{f}" for b, f in v.folders.items() if only is None or int(b) in only]
    return spark.read.schema(StructType.fromJson(v.schema)).parquet(*folders) if folders else _empty(spark, v)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    return _rows(spark, path, version(spark, path, number))


def changes(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The rows that a version brought, changed (as they are then) or took away, with ``ACTION``."""
    v = version(spark, path, number)
    schema = StructType.fromJson(v.schema).add(ACTION, StringType())
    return spark.read.schema(schema).parquet(f"{path}/{CHANGES}/{v.changes}") if v.changes else spark.createDataFrame([], schema)


def create(spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int = BUCKETS) -> None:
    """Version 0, without rows."""
    if not Files(spark, path).claim(json.dumps(Version(0, key, buckets, json.loads(schema.json())).__dict__), VERSIONS, _name(0)):
        raise ValueError(f"a table is there already: {path}")


def latest_rows(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key the row with the greatest ``order``."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("_best"))
    return best.select(*key, *[F.col("_best")[c].alias(c) for c in rest]).select(*rows.columns)


def merge(spark: SparkSession, path: str, source: DataFrame, when: str | None = None, values: dict[str, str] | None = None, insert: str | None = None, delete: str | None = None, delete_by: str | None = None, order: str | None = None, batch: str | None = None, read_at: int | None = None) -> dict[str, int | bool]:
    """Merges ``source`` into the table at ``path``: version, replayed, inserted, updated, deleted, unchanged (rows of the source).

    Conditions and values are SQL over the stored row ``t`` and the source's ``s``.  A matched row takes ``values`` (all columns
    of ``s`` if none are given) if ``when`` holds; without ``when``, if that changes it.  It goes if ``delete`` holds.  A new key
    comes in if ``insert`` holds (always, if not given).  ``delete_by`` is a further column of the source: where it is true the
    key goes, and doesn't come in.  ``read_at`` is the version that the caller has decided upon.
    """
    files, base = Files(spark, path), version(spark, path)
    if batch is not None and (batch == base.batch or files.text(BATCHES, f"{batch}.json") is not None):
        return {"version": base.number, "replayed": True, "inserted": 0, "updated": 0, "deleted": 0, "unchanged": 0}
    if read_at is not None and read_at != base.number:
        raise StaleWriter(f"{path}: decided upon version {read_at}, there is {base.number}")
    columns = [f["name"] for f in base.schema["fields"]]
    if unknown := set(source.columns) - set(columns) - {delete_by}:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    types = {f.name: f.dataType for f in StructType.fromJson(base.schema).fields}
    gone = F.coalesce(F.col(delete_by), F.lit(False)) if delete_by else F.lit(False)
    own = source.select(*[(F.col(c) if c in source.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns], gone.alias("__gone"))
    work = uuid.uuid4().hex
    if order is not None:
        own = latest_rows(own, base.key, order)
    # written once, so that all that follows sees the same source
    own.withColumn("__bucket", bucket(base.key, base.buckets)).write.parquet(f"{path}/{ROWS}/.{work}/source")
    own = spark.read.schema(StructType([*own.schema.fields, StructField("__bucket", IntegerType())])).parquet(f"{path}/{ROWS}/.{work}/source")
    try:
        if order is None and not (twice := own.groupBy(*base.key).count().filter("count > 1").limit(1)).isEmpty():
            raise ValueError(f"keys repeat in the source: {twice.first()}")
        touched = [r[0] for r in own.select("__bucket").distinct().collect()]  # as many as there are buckets, at most
        stored = _rows(spark, path, base, touched)
        t, s = stored.select(F.struct(*columns).alias("t"), *[F.col(k).alias(f"__t{i}") for i, k in enumerate(base.key)]), own.select(F.struct(*columns).alias("s"), "__gone", *[F.col(k).alias(f"__s{i}") for i, k in enumerate(base.key)])
        same = F.lit(True)
        for i in range(len(base.key)):
            same &= F.col(f"__t{i}").eqNullSafe(F.col(f"__s{i}"))
        both = t.join(s, same, "full")
        sets = F.struct(*[(F.expr(values[c]) if values and c in values else F.col("t")[c] if values or c in base.key else F.col("s")[c]).cast(types[c]).alias(c) for c in columns])
        fit = F.expr(when) if when else ~F.xxhash64(sets).eqNullSafe(F.xxhash64("t"))
        action = (
            F.when(F.col("s").isNull(), "kept")
            .when(F.col("t").isNull(), F.when(F.col("__gone"), "unchanged").when(F.expr(insert) if insert else F.lit(True), "inserted").otherwise("unchanged"))
            .when(F.col("__gone") | (F.coalesce(F.expr(delete), F.lit(False)) if delete else F.lit(False)), "deleted")
            .when(F.coalesce(fit, F.lit(False)), "updated")
            .otherwise("unchanged")
        )
        told = both.withColumn("__action", action)
        told = told.withColumn("__row", F.when(F.col("__action") == "updated", sets).when(F.col("__action") == "inserted", F.col("s")).when(F.col("__action") != "deleted", F.col("t")))
        places = told.select("__action", "__row", "t", bucket([F.coalesce(F.col("s")[k], F.col("t")[k]) for k in base.key], base.buckets).alias("__bucket"))
        # which buckets change is decided before anything is written
        changes = places.filter("__action IN ('inserted', 'updated', 'deleted')").select("__bucket").distinct()
        tally = {r["__action"]: r["count"] for r in places.groupBy("__action").count().collect()}
        counts = {a: tally.get(a, 0) for a in ("inserted", "updated", "deleted", "unchanged")}
        if not sum(counts[a] for a in ("inserted", "updated", "deleted")):
            return {"version": base.number, "replayed": False, **counts}
        changed = [r[0] for r in changes.collect()]
        fresh = places.filter(F.col("__bucket").isin(changed) & F.col("__row").isNotNull()).select("__row.*", F.col("__bucket").alias("bucket"))
        name = f"{base.number + 1:019d}-{work}"
        told = F.when(F.col("__action") == "deleted", F.col("t")).otherwise(F.col("__row"))
        moved = places.filter("__action IN ('inserted', 'updated', 'deleted')").select(told.alias("__row"), "__action").select("__row.*", F.col("__action").alias(ACTION))
        moved.write.parquet(f"{path}/{CHANGES}/{name}")
        fresh.repartition("bucket").sortWithinPartitions(*base.key).write.partitionBy("bucket").parquet(f"{path}/{ROWS}/{name}")
        made = {n.partition("=")[2]: f"{name}/{n}" for n in files.names(ROWS, name) if n.startswith("bucket=")}
        folders = {b: f for b, f in base.folders.items() if int(b) not in changed} | made
        if base.batch is not None:
            files.claim(json.dumps({"version": base.number}), BATCHES, f"{base.batch}.json")
        if not files.claim(json.dumps(Version(base.number + 1, base.key, base.buckets, base.schema, folders, batch, counts, name).__dict__), VERSIONS, _name(base.number + 1)):
            files.drop(ROWS, name)
            files.drop(CHANGES, name)
            raise StaleWriter(f"{path}: version {base.number + 1} came meanwhile")
        return {"version": base.number + 1, "replayed": False, **counts}
    finally:
        files.drop(ROWS, f".{work}")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all but the last ``keep`` versions and the folders that none of these names; how many folders went."""
    files, every = Files(spark, path), versions(spark, path)
    kept = [version(spark, path, v) for v in every[-keep:]]
    named = {f for v in kept for f in v.folders.values()}
    for v in every[:-keep]:
        if (old := version(spark, path, v).changes) is not None:
            files.drop(CHANGES, old)
        files.drop(VERSIONS, _name(v))
    gone = 0
    for name in files.names(ROWS):
        if name.startswith("."):
            continue
        parts = [f"{name}/{b}" for b in files.names(ROWS, name) if b.startswith("bucket=")]
        for f in parts:
            if f not in named:
                files.drop(ROWS, *f.split("/"))
                gone += 1
        if not any(f in named for f in parts) and int(name.partition("-")[0]) <= every[-1]:
            files.drop(ROWS, name)
    return gone
