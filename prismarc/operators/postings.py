"""A stored inverted index: blocks of postings by token, and the tokens by trigram.

A block holds the documents of one token within one stretch of ``STRETCH`` ids:
their gaps, how often the token stands in each, the most that it does, and the sum.  So
the list of a token that every document has is many blocks, none of them large.
Blocks lie in folders by the hash of their token, sorted by it: a search reads
the folders of its tokens and in these the row groups that can hold them, and
never a text.  Tokens that begin with a string or hold it are found by trigrams
of the vocabulary (``^`` stands before each token).

Texts are counted where they are read, a few megabytes at a time; what moves is
a row for each token and stretch of such a piece, once, to the folder it is for.

Ids are whole numbers; rows of one id are one document; a null id or text isn't
indexed.  An empty search finds nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRETCH, FOLDERS, PIECE = 1 << 16, 32, 4 << 20
BLOCKS, VOCABULARY, GRAMS = "blocks", "vocabulary", "grams"
SCHEMAS = {BLOCKS: "token string, stretch long, n int, top int, total long, gaps array<int>, times array<int>, folder int", VOCABULARY: "token string, documents long, times long, folder int", GRAMS: "gram string, token string, folder int"}


def folder(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FOLDERS)).cast("int")


#: Bytes of lower-cased text that belong to no token become spaces.
_TOKENS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)], pa.int32()), pa.array(values, pa.int32()))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, stretch, offs, times of (id, lower-cased text): a row for each token and stretch of a piece of ``PIECE`` bytes."""
    ids: list[int] = []
    sizes: list[int] = []
    tokens: list[bytes] = []
    times: list[int] = []

    def piece() -> pa.RecordBatch:
        own = np.repeat(np.array(ids, np.int64), sizes)
        words = pa.array(tokens, pa.binary()).dictionary_encode()
        stretches, place = np.unique(own // STRETCH, return_inverse=True)
        key = words.indices.to_numpy().astype(np.int64) * len(stretches) + place
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        token = words.dictionary.cast(pa.string()).take(pa.array(key[first] // len(stretches)))
        return pa.RecordBatch.from_arrays([token, pa.array(stretches[key[first] % len(stretches)]), lists((own % STRETCH)[order], first), lists(np.array(times, np.int64)[order], first)], names=["token", "stretch", "offs", "times"])

    held = 0
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = Counter(memoryview(raw.as_buffer()).tobytes().translate(_TOKENS).split()) if raw.is_valid else ()
            if found:
                ids.append(i)
                sizes.append(len(found))
                tokens += found.keys()
                times += found.values()
                held += raw.as_buffer().size
            if held > PIECE:
                yield piece()
                ids, sizes, tokens, times, held = [], [], [], [], 0
    if ids:
        yield piece()


def blocks_from(part: pa.Table) -> pa.RecordBatch:
    """Blocks of rows of ``counted`` that are sorted by token and stretch; rows of one id are added up."""
    stretch = part.column("stretch").to_numpy()
    token = part.column("token").combine_chunks()
    fresh = np.r_[True, pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False) | (stretch[1:] != stretch[:-1])]
    offs, times = part.column("offs").combine_chunks(), part.column("times").combine_chunks()
    group = np.repeat(np.cumsum(fresh) - 1, pc.list_value_length(offs).to_numpy())
    off, often = offs.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
    order = np.argsort(group * STRETCH + off, kind="stable")
    group, off, often = group[order], off[order], often[order]
    once = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (off[1:] != off[:-1])])
    often = np.add.reduceat(often, once)
    group, off = group[once], off[once]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    gaps = np.diff(off, prepend=0)
    gaps[first] = off[first]
    at = pa.array(np.flatnonzero(fresh))
    columns = [token.take(at), pa.array(stretch).take(at), pa.array(np.diff(np.r_[first, len(off)]), pa.int32()), pa.array(np.maximum.reduceat(often, first), pa.int32()), pa.array(np.add.reduceat(often, first)), lists(gaps, first), lists(often, first), part.column("folder").combine_chunks().take(at)]
    return pa.RecordBatch.from_arrays(columns, names=["token", "stretch", "n", "top", "total", "gaps", "times", "folder"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``blocks_from`` over batches: the last token and stretch wait for the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part])
        last = part.slice(part.num_rows - 1).to_pylist()[0]
        other = pc.or_(pc.not_equal(part.column("token"), last["token"]), pc.not_equal(part.column("stretch"), last["stretch"])).to_numpy()
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield blocks_from(part.slice(0, cut))
        held = part.slice(cut)
    if held is not None:
        yield blocks_from(held)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of one folder together, in as many parts (by the keys) as the shuffle's partitions allow."""
    parts = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // FOLDERS)
    return rows.repartitionById(FOLDERS * parts, (F.col("folder") * parts + F.pmod(F.xxhash64(*keys), F.lit(parts))).cast("int"))


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    told = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text"))
    rows = told.mapInArrow(counted, "token string, stretch long, offs array<int>, times array<int>").withColumn("folder", folder(F.col("token")))
    blocks = dealt(rows, "token", "stretch").sortWithinPartitions("folder", "token", "stretch").mapInArrow(merged, SCHEMAS[BLOCKS])
    blocks.sortWithinPartitions("folder", "token", "stretch").write.partitionBy("folder").parquet(f"{path}/{BLOCKS}")
    held = read(spark, path, BLOCKS)
    words = held.groupBy("token").agg(F.sum("n").alias("documents"), F.sum("total").alias("times")).withColumn("folder", folder(F.col("token")))
    dealt(words, "token").sortWithinPartitions("folder", "token").write.partitionBy("folder").parquet(f"{path}/{VOCABULARY}")
    marked = F.concat(F.lit("^"), "token")
    grams = read(spark, path, VOCABULARY).select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(marked) - 2, F.lit(1))), lambda i: F.substring(marked, i, 3)))).alias("gram"), "token")
    dealt(grams.withColumn("folder", folder(F.col("gram"))), "gram", "token").sortWithinPartitions("folder", "gram", "token").write.partitionBy("folder").parquet(f"{path}/{GRAMS}")


def read(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[part]).parquet(f"{path}/{part}")


def of_folders(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """The rows with one of the values, from the folders that can hold them."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(v,) for v in values], "v string").select(folder(F.col("v"))).distinct().collect() if values else []
    return rows.filter(F.col("folder").isin([r[0] for r in every]) & F.col(column).isin(list(values)))


def blocks_of(spark: SparkSession, path: str, tokens: Sequence[str]) -> DataFrame:
    return of_folders(read(spark, path, BLOCKS), "token", tokens)


def each_id(blocks: DataFrame) -> DataFrame:
    """token, id, times of blocks: gaps are added up over the places of a block."""
    placed = blocks.select("token", "stretch", F.posexplode(F.arrays_zip("gaps", "times")).alias("at", "z"))
    upto = F.sum("z.gaps").over(Window.partitionBy("token", "stretch").orderBy("at"))
    return placed.select("token", (F.col("stretch") * STRETCH + upto).alias("id"), F.col("z.times").alias("times"))


def with_all(spark: SparkSession, path: str, tokens: Sequence[str]) -> DataFrame:
    """id of the documents that have all tokens.  Stretches in which one is missing are never opened."""
    wanted = sorted(set(tokens))
    found = blocks_of(spark, path, wanted)
    open_ = found.groupBy("stretch").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") == len(wanted)).select("stretch")
    return each_id(found.join(open_, "stretch")).groupBy("id").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") == len(wanted)).select("id")


def with_any(spark: SparkSession, path: str, tokens: Sequence[str] | DataFrame) -> DataFrame:
    """id of the documents that have one of the tokens (a list, or a table of them)."""
    if isinstance(tokens, DataFrame):
        blocks = read(spark, path, BLOCKS).join(tokens.select("token").distinct().withColumn("folder", folder(F.col("token"))), ["folder", "token"], "left_semi")
    else:
        blocks = blocks_of(spark, path, tokens)
    return each_id(blocks).select("id").distinct()


def top(spark: SparkSession, path: str, tokens: Sequence[str], k: int) -> DataFrame:
    """id, score (how often the tokens stand in it) of the first ``k`` documents by score down and id.

    Each stretch has a document that reaches its largest block maximum, so the kth largest of these is a score that k
    documents reach; stretches whose maxima don't add up to it are never opened.
    """
    found = blocks_of(spark, path, sorted(set(tokens)))
    bounds = found.groupBy("stretch").agg(F.sum("top").alias("most"), F.max("top").alias("sure"))
    sure = [r[0] for r in bounds.select("sure").orderBy(F.desc("sure")).limit(k).collect()]
    open_ = bounds.filter(F.col("most") >= (sure[-1] if len(sure) == k else 0)).select("stretch")
    scored = each_id(found.join(open_, "stretch")).groupBy("id").agg(F.sum("times").cast("long").alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def tokens_with(spark: SparkSession, path: str, part: str, prefix: bool = False) -> DataFrame:
    """token of the vocabulary's tokens that hold ``part``, or begin with it.

    A part of fewer than three characters has no trigram: the vocabulary is read, which is small beside the postings.
    """
    part = part.lower()
    if not re.fullmatch("[a-z0-9]+", part):
        raise ValueError("tokens are of a to z and 0 to 9")
    fit = F.startswith("token", F.lit(part)) if prefix else F.contains("token", F.lit(part))
    marked = f"^{part}" if prefix else part
    grams = sorted({marked[i : i + 3] for i in range(len(marked) - 2)})
    if not grams:
        return read(spark, path, VOCABULARY).filter(fit).select("token")
    met = of_folders(read(spark, path, GRAMS), "gram", grams).groupBy("token").agg(F.count(F.lit(1)).alias("met"))
    return met.filter((F.col("met") == len(grams)) & fit).select("token")


def containing(spark: SparkSession, path: str, part: str, prefix: bool = False) -> DataFrame:
    """id of the documents with a token that holds ``part`` (or begins with it): as a text holds a string of token characters."""
    return with_any(spark, path, tokens_with(spark, path, part, prefix))
