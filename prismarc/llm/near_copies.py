"""Near copies by Jaccard similarity of word shingles, found by SimHash rings and then by MinHash bands, and checked exactly.

Two texts are near copies if their sets of ``shingle`` lower-cased words in a
row have a Jaccard similarity of ``least`` or more; texts of fewer words have
one shingle.  Texts with the same words are one node (a 64-bit hash), so exact
copies cost nothing; null texts and texts without words are one node too.

The first candidates are those of op7 (``simhash``): fingerprints of four-word
shingles that pigeonring keys, chain budgets and the Hamming check link at 4 bits
or fewer; each of their components is a group.  64 bits can't find all: pairs at
0.8 differ in ten bits on average and in up to twenty, too many for keys that
agree exactly.  So the others share one of ``bands`` keys of ``rows`` MinHash
values: at similarity s they are missed with probability (1 - s**rows)**bands,
6e-7 at 0.8 with 20 bands of 3.  Bands whose members the rings have joined
already are not looked at.  Groups with the same members are held once.  In a group every pair is compared on the whole
sets unless links found before already join it.  Groups of more than ``BLOCK``
bytes are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, mark, renamed, slices, sweep
from .repeats import U, mixed, prefix, spans_hash, word_hashes
from .simhash import components, fingerprint, links

SHINGLE, LEAST, BANDS, ROWS, BLOCK = 5, 0.8, 20, 3, 8 << 20


def plain_words(text: Column) -> Column:
    """The lower-cased words with single spaces between them; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+", " "))


def shingle_sets(raws: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none if it has no words."""
    hashes, counts = word_hashes(raws)
    ends = np.cumsum(counts)
    sums = prefix(mixed(hashes))
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        at = np.arange(a, max(a + 1, b - shingle + 1)) if b > a else np.zeros(0, np.int64)
        yield np.unique(spans_hash(sums, at, np.minimum(at + shingle, b)))


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, U)
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=U))
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, mixed(shingles[at : at + 2048, None] ^ seeds).min(axis=0))
    keys = np.arange(bands, dtype=U)
    for column in least.reshape(bands, rows).T:
        keys = mixed(keys * U(3) + column)
    return keys


def similar_links(nodes: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all nodes of a group which pairs of ``least`` or more join: each node is held against those not reached yet."""
    sizes = np.array([len(s) for s in sets])
    rest, a, b = np.arange(len(nodes)), [], []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            fit = (sizes[rest] >= least * sizes[i] - 1e-6) & (sizes[i] >= least * sizes[rest] - 1e-6)
            other = rest[fit]
            if not len(other) or not sizes[i]:
                continue
            every = np.concatenate([sets[j] for j in other])
            at = np.minimum(np.searchsorted(sets[i], every), sizes[i] - 1)
            shared = np.bincount(np.repeat(np.arange(len(other)), sizes[other])[sets[i][at] == every], minlength=len(other))
            near = other[shared >= least * (sizes[i] + sizes[other] - shared) - 1e-9]
            queue += near.tolist()
            a += [i] * len(near)
            b += near.tolist()
            rest = np.setdiff1d(rest, near, assume_unique=True)
    return nodes[a] if a else nodes[:0], nodes[b] if b else nodes[:0]


def similar_in_groups(keyed: DataFrame, worded: DataFrame, least: float, shingle: int, block: int) -> DataFrame:
    """Links (__a, __b) that join the similar nodes of each group of ``keyed`` (__key, __node, __size, __of): those that share a key, unless all have one __of."""
    groups = keyed.groupBy("__key").agg(F.count("*").alias("__n"), F.sum("__size").alias("__bytes"), F.min("__of").alias("__low"), F.max("__of").alias("__high"), *[F.bit_xor(F.xxhash64("__node", F.lit(k))).alias(f"__x{k}") for k in (1, 2)])
    groups = groups.filter("__n > 1 AND __low <> __high").groupBy("__n", "__bytes", "__x1", "__x2").agg(F.min("__key").alias("__key"))
    groups = groups.select("__key", F.ceil(F.col("__bytes") / block).cast("int").alias("__blocks"))
    met = keyed.join(groups, "__key").withColumn("__own", F.pmod(F.xxhash64("__node"), F.col("__blocks")).cast("int"))
    # of a group of many blocks every two meet
    others = F.filter(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda x: x != F.col("__own"))
    met = met.select("*", F.explode(F.when(F.col("__blocks") == 1, F.array(F.lit(0))).otherwise(others)).alias("__other"))
    cell = F.xxhash64("__key", F.least("__own", "__other"), F.greatest("__own", "__other"))
    cells = cut(met.select(cell.alias("__cell"), "__node"))
    texts = worded.select("__node", "__words").join(cells.select("__node").distinct(), "__node", "left_semi").dropDuplicates(["__node"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        now = None

        def found() -> pa.RecordBatch:
            a, b = similar_links(np.array(list(held), np.int64), list(shingle_sets(list(held.values()), shingle)), least)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["__a", "__b"])

        for batch in batches:
            for at, node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch, "__words"), strict=True):
                if at != now and held:
                    yield found()
                    held = {}
                now, held[node] = at, raw
        if held:
            yield found()

    return cells.join(texts, "__node").select("__cell", "__node", "__words").repartition("__cell").sortWithinPartitions("__cell").mapInArrow(verify, "__a long, __b long").distinct()


def near_links(docs: DataFrame, least: float, shingle: int, bands: int, rows: int, block: int) -> DataFrame:
    """Links (__a, __b) between the nodes of ``docs`` (__node, __words)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__words", 2 << 20):
            raws = as_bytes(batch, "__words")
            keys = np.concatenate([band_keys(s, bands, rows) for s in shingle_sets(raws, shingle)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands), pa.int32()), pa.array(keys))
            prints = np.array([fingerprint(r) for r in raws], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(prints), lists], names=["__node", "__size", "__fp", "__keys"])

    worded = docs.filter(F.col("__words") != "")
    sketches = worded.select("__node", "__words").mapInArrow(sketch, "__node long, __size long, __fp long, __keys array<long>")
    sketches = cut(sketches.dropDuplicates(["__node"]))
    rings = components(links(sketches.select("__fp").distinct())).select(F.col("__node").alias("__fp"), F.col("__root").alias("__ring"))
    ringed = sketches.join(rings, "__fp", "left").select(F.coalesce("__ring", "__fp").alias("__key"), "__node", "__size", F.col("__node").alias("__of"))
    first = cut(similar_in_groups(ringed, worded, least, shingle, block))
    joined = cut(components(first))
    keyed = sketches.join(joined, "__node", "left").select("__node", "__size", F.coalesce("__root", "__node").alias("__of"), F.explode("__keys").alias("__key"))
    return similar_in_groups(keyed, worded, least, shingle, block).unionByName(first)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Of each component of near copies the text with the smallest id (of several, the one with the smallest hash).

    Texts are judged, not ids: where an id repeats with different texts, only the near copies among them go.  Rows that
    repeat both id and words all stay or all go.  Rows with a null id stay.
    """
    plain, at = renamed(docs)
    plain = plain.withColumn("__words", plain_words(F.col(at[text_col]))).withColumn("__node", F.xxhash64("__words"))
    prints = cut(plain.select(F.col(at[id_col]).alias("__id"), "__node"))
    since = mark()
    found = cut(components(near_links(plain, least, shingle, bands, rows, block)))
    sweep(docs.sparkSession, since, found)
    nodes = prints.filter("__id IS NOT NULL").groupBy("__node").agg(F.min("__id").alias("__least"))
    rooted = nodes.join(found.withColumnRenamed("__node", "__of"), F.col("__node") == F.col("__of"), "left").select("__node", "__least", F.coalesce("__root", "__node").alias("__root"))
    best = rooted.groupBy("__root").agg(F.min(F.struct("__least", "__node")).alias("__best")).select(F.col("__best.__least").alias("__id"), F.col("__best.__node").alias("__node"))
    gone = cut(prints.filter("__id IS NOT NULL").distinct().join(best, ["__id", "__node"], "left_anti")).select(F.col("__id").alias("__gone"), F.col("__node").alias("__gone_node"))
    left = plain.join(gone, (F.col(at[id_col]) == F.col("__gone")) & (F.col("__node") == F.col("__gone_node")), "left_anti")
    return left.drop("__words", "__node").toDF(*docs.columns)
