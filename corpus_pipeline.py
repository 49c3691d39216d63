"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage gets the documents that the one before it kept, and all but the last
return the columns of documents.  ``run`` writes each stage to the shared folder,
reads it again and deletes what the stage itself had written there.

Null and empty texts pass quality, passages and benchmark; for near_duplicates
they are one text, of which the row with the smallest id stays; a text that
passages empties goes with its row.  Repeated rows (one id and text) stay or go
together everywhere; rows without an id are cut by no stage but quality.  Of
equal similarities and keys the smaller id holds.  Further columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismarc.llm import decontaminate, mixing, near_copies, quality, suffixes
from prismarc.llm.common import fresh_path, mark, sweep, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Candidates are op7's components of fingerprints and, for pairs beyond their 4 bits, MinHash bands; both are checked on the whole sets.
    """
    return near_copies.keep_one(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 100 bytes and more are cut from the texts; documents that lose all of a text go."""
    return suffixes.cut_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("rate", 6).alias("rate"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]

#: Not expressible in SQL: hashed models, MinHash and tilings.  tests/llm holds every stage against brute force (quality: a model of exact
#: words; near_duplicates: all pairs; passages: all strings of 100 bytes; benchmark: tilings by definition; mixing: a plain computation)
#: and run() against planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        since = mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        sweep(spark, since)
        docs = spark.read.parquet(path)
    return docs
