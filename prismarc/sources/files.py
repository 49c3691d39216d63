"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema, strict: bool = True) -> DataFrame:
    """Strict: any bad line fails the job.  Otherwise bad lines are dropped; blank ones always are."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def scan_jsonl(spark: SparkSession, path: str, schema: str, key: str, strict: bool = True, limit: int | None = None) -> DataFrame:
    """state, bytes, sha256 and the record of every line that isn't blank; a byte order mark and a carriage return don't count.

    The state is ``sound``, ``not an object``, ``bad json`` or ``no key``; strict raises for all but the first.  ``limit`` takes
    the sound records with the least keys.
    """
    body = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r$", "")
    lines = spark.read.option("lineSep", "\n").text(path).select(body.alias("__line")).filter(F.trim("__line") != "")
    record = F.from_json("__line", f"{schema}, `__bad` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    parsed = lines.withColumn("__r", record)
    state = F.when(~F.startswith(F.ltrim("__line"), F.lit("{")), "not an object").when(F.col("__r.__bad").isNotNull(), "bad json").when(F.col("__r")[key].isNull(), "no key").otherwise("sound")
    if strict:
        state = F.when(state == "sound", state).otherwise(F.raise_error(F.concat(state, F.lit(": "), F.substring("__line", 1, 80))))
    out = parsed.select(state.alias("state"), F.octet_length("__line").cast("long").alias("bytes"), F.sha2("__line", 256).alias("sha256"), "__r.*").drop("__bad")
    return out if limit is None else out.filter("state = 'sound'").orderBy(key).limit(limit)


def read_json_rows(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The rows of the array under ``key`` of one JSON object a file."""
    return spark.read.schema(f"`{key}` array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline(key))


def read_js_assignment(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The value of ``window.NAME = <json>;``."""
    body = F.regexp_extract("value", r"(?s)^\s*window\.[A-Za-z_$][\w$]*\s*=\s*(.*?);?\s*$", 1)
    return spark.read.text(path, wholetext=True).select(F.from_json(body, schema).alias("v")).select(F.inline("v") if schema.startswith("array") else "v.*")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_versioned(df: DataFrame, path: str, version: int) -> str:
    """A version is written once; the manifest comes last and marks it complete."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    df.sparkSession.read.parquet(target).agg(F.count("*").alias("rows")).withColumn("version", F.lit(version)).write.mode("errorifexists").json(f"{path}/manifests/version={version}")
    return target


def union_lanes(*lanes: DataFrame) -> DataFrame:
    out = lanes[0]
    for lane in lanes[1:]:
        out = out.unionByName(lane, allowMissingColumns=True)
    return out
