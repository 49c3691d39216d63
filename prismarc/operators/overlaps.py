"""Pairs of token sets that share nearly all tokens: met over their rarest tokens, counted in blocks that each hold few sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import tabled

#: Cells of the table of token counts, whatever the corpus, and sets of a block.
CELLS, BLOCK = 1 << 20, 1024


def _hashes(own: bytes) -> np.ndarray:
    return np.array([zlib.crc32(x) for x in own.split(b"\0")], np.int64)


def cell_counts(sets: DataFrame, column: str) -> np.ndarray:
    """How often tokens fall in each of ``CELLS`` cells by their hash, as the logarithm in eighths: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for own in batch.column(0):
                np.add.at(cells, _hashes(own.as_py()) % CELLS, 1)
        found = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(cells[found])], names=["cell", "n"])

    got = sets.select(column).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.round(F.log2(F.sum("n")) * 8).cast("short").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int16)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def rare_keys(sets: DataFrame, column: str, share: float) -> DataFrame:
    """``sets`` with ``keys``, hashes of the first (rarest first) floor(share n) + 1 tokens of n, and ``home``, the least hash of all, instead of the tokens.

    The order is by the count of a token's cell, then by its hash: one order for all sets, so none moves to get its keys.
    """
    counts = cell_counts(sets, column)
    rest = [c for c in sets.columns if c != column]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, home = [], []
            for own in batch.column(len(rest)):
                h = _hashes(own.as_py())
                keys.append(np.unique(h[np.lexsort((h, counts[h % CELLS]))[: int(len(h) * share + 1e-9) + 1]]))
                home.append(int(h.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(keys, pa.list_(pa.int64())), pa.array(home, pa.int64())], names=[*rest, "keys", "home"])

    schema = ", ".join(f"`{c}` {t}" for c, t in sets.select(*rest).dtypes)
    return sets.select(*rest, column).mapInArrow(cut, f"{schema}, keys array<long>, home long")


def with_block(nodes: DataFrame, node: str) -> DataFrame:
    """``nodes`` with a ``block`` of about ``BLOCK`` of them: those of one home (mostly near copies) together, dealt out where they are more."""
    many = max(1, nodes.count() // BLOCK)
    full = nodes.groupBy("home").count().filter(F.col("count") > BLOCK).select("home", F.ceil(F.col("count") / BLOCK).alias("_parts"))
    part = F.pmod(F.xxhash64(node), F.coalesce("_parts", F.lit(1)))
    return nodes.join(full, "home", "left").withColumn("block", F.xxhash64(F.pmod(F.xxhash64("home"), F.lit(many)), F.when(F.col("_parts").isNotNull(), F.col("home")), part)).drop("_parts", "home")


def slot(a: Column, b: Column, many: int) -> Column:
    """Where two blocks meet."""
    return F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b)), F.lit(4 * many))


def counted(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """(node, other, met) of ``pairs`` (slot, node, other): the tokens that both have.

    ``sets`` (node, column) go once to each slot that has a pair of theirs, however many pairs that are.
    """
    wanted = pairs.select(F.col("slot").alias("at"), F.explode(F.array("node", "other")).alias("held")).distinct()
    moved = wanted.join(sets.select(F.col("node").alias("held"), column), "held").select("at", "held", column)

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        own = {n: set(x.split(b"\0")) for n, x in zip(held.column("held").to_pylist(), held.column(column).to_pylist(), strict=True)}
        met = [len(own[a] & own[b]) for a, b in zip(asked.column("node").to_pylist(), asked.column("other").to_pylist(), strict=True)]
        return pa.table({"node": asked.column("node"), "other": asked.column("other"), "met": pa.array(met, pa.int64())})

    return pairs.groupBy("slot").cogroup(moved.groupBy("at")).applyInArrow(meet, "node long, other long, met long")


def close_pairs(nodes: DataFrame, sets: DataFrame, column: str, close) -> DataFrame:
    """(node, other, met), node < other, of all pairs that share a key and are ``close`` (a condition on the columns of both, the other's named other_).

    ``nodes`` has node, keys, home and the columns that ``close`` reads.
    """
    blocks = tabled(with_block(nodes, "node"))
    left = blocks.withColumn("key", F.explode("keys")).drop("keys")
    right = left.select("key", *[F.col(c).alias("other" if c == "node" else f"other_{c}") for c in left.columns if c != "key"])
    many = max(1, nodes.count() // BLOCK)
    met = left.join(right, "key").filter((F.col("node") < F.col("other")) & close)
    pairs = tabled(met.select(slot(F.col("block"), F.col("other_block"), many).alias("slot"), "node", "other").distinct())
    return counted(pairs, sets, column)
