"""Exact nearest neighbours of a query set against all vectors, in blocks.

Vectors and queries are packed where they lie into rows of up to ``BLOCK``
vectors; every packed row of vectors meets every packed row of queries in the
executors, and of a meeting the best k a query go on (or the best of each
group).  Nothing passes through the driver.  Scores are cosines rounded to six
decimals before ranking; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import written

BLOCK = 2048
#: Queries of a packed row that are scored at once.
ROWS = 256


def packed(rows: DataFrame, id_col: str, vector_col: str, extra: str, prefix: str) -> DataFrame:
    """ids, extras and unit vectors of up to ``BLOCK`` rows each, as binaries.  Rows without an id or a vector stay away; a null extra is -1."""
    schema = f"{prefix}ids binary, {prefix}extras binary, {prefix}unit binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def row() -> pa.RecordBatch:
            ids, extras, unit = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, extras, unit)], names=schema.replace(" binary", "").split(", "))

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                unit = np.stack(part.column(2).to_numpy(zero_copy_only=False)).astype(float)
                unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
                held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), unit))
                if sum(len(h[0]) for h in held) >= BLOCK:
                    yield row()
                    held = []
        if held:
            yield row()

    narrow = rows.select(F.col(id_col).cast("long"), F.coalesce(F.col(extra).cast("long"), F.lit(-1)), vector_col).toDF("id", "extra", "v")
    return narrow.filter("id IS NOT NULL AND v IS NOT NULL").mapInArrow(pack, schema)


def _met(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, extra: str, pick, by_group: bool) -> DataFrame:
    # both are written: else each meeting packs its vectors anew, by a second Python worker in its task
    own = written(packed(vectors, id_col, vector_col, extra, "v_"))
    asked = own.toDF("q_ids", "q_extras", "q_unit") if vectors is queries else written(packed(queries, id_col, vector_col, extra, "q_"))
    asked = asked.select("q_ids", "q_unit")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                v_ids, v_extras, v_unit, q_ids, q_unit = (batch.column(c)[at].as_buffer() for c in ("v_ids", "v_extras", "v_unit", "q_ids", "q_unit"))
                ids, extras, q = (np.frombuffer(x, np.int64) for x in (v_ids, v_extras, q_ids))
                unit, asked = np.frombuffer(v_unit).reshape(len(ids), -1), np.frombuffer(q_unit).reshape(len(q), -1)
                for first in range(0, len(q), ROWS):
                    mine = q[first : first + ROWS]
                    scores = asked[first : first + ROWS] @ unit.T
                    np.round(scores, 6, out=scores)
                    if not by_group:
                        scores[mine[:, None] == ids[None, :]] = -np.inf
                    row, col = pick(scores, ids, extras)
                    ok = np.isfinite(scores[row, col])
                    row, col = row[ok], col[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(mine[row]), pa.array(ids[col]), pa.array(extras[col]), pa.array(scores[row, col])], names=["query_id", id_col, extra, "score"])

    # a stated query set against all rows, packed: not a join of rows
    return own.crossJoin(asked).mapInArrow(scan, f"query_id long, {id_col} long, {extra} long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", extra: str = "label") -> DataFrame:
    """query_id, id, extra, score, rank (1 to k); a query isn't its own neighbour."""

    def best(scores: np.ndarray, ids: np.ndarray, extras: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if scores.shape[1] <= k:
            return np.repeat(np.arange(len(scores)), scores.shape[1]), np.tile(np.arange(scores.shape[1]), len(scores))
        # all above the kth score go on, and of those equal to it the least ids
        kth = np.partition(scores, -k, axis=1)[:, -k, None]
        row, at = np.nonzero(scores >= kth)
        order = np.lexsort((ids[at], -scores[row, at], row))
        row, at = row[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < k], at[place < k]

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    found = _met(vectors, queries, id_col, vector_col, extra, best, False)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def nearest_groups(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", group: str = "label") -> DataFrame:
    """query_id, group, score, id, rank: the k groups whose best member is nearest, with that member."""

    def best(scores: np.ndarray, ids: np.ndarray, extras: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, places = [], []
        for g in np.unique(extras):
            own = np.flatnonzero(extras == g)
            own = own[np.argsort(ids[own])]
            rows.append(np.arange(len(scores)))
            places.append(own[scores[:, own].argmax(axis=1)])
        return np.concatenate(rows), np.concatenate(places)

    found = _met(vectors, queries, id_col, vector_col, group, best, True)
    found = found.groupBy("query_id", group).agg(F.max(F.struct("score", (-F.col(id_col)).alias("i"))).alias("m"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), group)
    return found.select("query_id", group, "m.score", (-F.col("m.i")).alias(id_col)).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def pairs_above(left: DataFrame, right: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", extra: str = "label") -> DataFrame:
    """left_id, right_id, score of all pairs of a score of ``least`` or more (of a table with itself, each pair once): every block against every block."""

    def above(scores: np.ndarray, ids: np.ndarray, extras: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(scores >= least)

    met = _met(right, left, id_col, vector_col, extra, above, False).select(F.col("query_id").alias("left_id"), F.col(id_col).alias("right_id"), "score")
    return met.filter("left_id < right_id") if left is right else met


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit_prefix(vector, size: int):
    head = F.slice(vector, 1, size)
    return F.transform(head, lambda x: x.cast("double") / F.sqrt(dot(head, head)))


def sign_bits(vector):
    """64 signs as a long."""
    return F.conv(F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), ""), 2, -10).cast("long")


def banded_pairs(rows: DataFrame, id_col: str, bits_col: str, most: int, agree: int = 3) -> DataFrame:
    """Pairs (left_id < right_id, hamming) of longs that differ in at most ``most`` bits; of equal longs the least id stands for all.

    Of ``most + agree`` bands ``agree`` are alike at least, so pairs meet over every choice of so many bands: C(11, 3) keys
    of 17 bits for 8 bits of difference.  More agreeing bands make more and longer keys.  Equal longs are one node; their
    other ids follow as links to it.
    """
    count = most + agree
    edges = [64 * i // count for i in range(count + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    picks = [signed(sum(masks[i] for i in c)) for c in combinations(range(count), agree)]
    # filtered once written: before that the filter has the longs computed a second time
    own = written(rows.select(F.col(id_col).alias("id"), F.col(bits_col).alias("bits"))).filter("id IS NOT NULL AND bits IS NOT NULL")
    nodes = own.groupBy("bits").agg(F.min("id").alias("id"))
    keys = nodes.select("id", "bits", F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m)) for m in picks])).alias("n", "v"))
    left, right = keys.toDF("left_id", "lb", "n", "v"), keys.toDF("right_id", "rb", "n", "v")
    differ = F.bit_count(F.col("lb").bitwiseXOR(F.col("rb"))).cast("long")
    met = left.join(right, ["n", "v"]).filter((F.col("left_id") < F.col("right_id")) & (differ <= most)).select("left_id", "right_id", differ.alias("hamming")).distinct()
    copies = own.join(nodes.withColumnRenamed("id", "left_id"), "bits").filter("id > left_id").select("left_id", F.col("id").alias("right_id"), F.lit(0).cast("long").alias("hamming")).distinct()
    return met.unionByName(copies)
