"""Hard negatives by distributed radix selection over integer scores.

Components are floored to integers (``scale`` times each), so a score, the inner
product with an anchor, is an integer, and the first k rows of a window (an
anchor, a range of scores, and whether labels must be equal) are found without
sorting them: in each round every task counts the window's rows by the next
digit of their distance from the window's upper end, the counts are added, and
the bucket that holds the kth row is refined by the digit after it.  Where more
rows than are wanted share the kth score, the digits of their ids follow.  Then
one pass gathers the rows that qualify, k for each window (more only where one
id and score repeat; those come with their number).

From a task a window needs no bucket beyond that in which the task's own rows
reach k: the kth row of all lies there or before.  So it sends k buckets at
most, with their whole counts, whatever it read.

Positives are the windows of an anchor over equal labels; each positive then
opens a window over other labels, from ``low`` to ``high`` hundredths of its
score.  Anchors are a stated query set: packed into blocks, they meet the packed
rows in the executors, and only counts and finds leave a task.

Rows whose id, label or vector is null, and those with a null or not finite
component, take no part; neither do empty vectors.  Vectors meet those of their
length only.  Components are held within 2 ** 62 and scores within 2 ** 61.
Repeated anchors are one anchor; repeated rows count as often as they occur, and
no row with an anchor's own id is its positive.  Further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, cut, drop

BLOCK, DIGIT, CELLS, TOP = 2048, 8, 1 << 22, 1 << 61
BUCKETS = 1 << DIGIT


def quantised(rows: DataFrame, id_col: str, vector_col: str, label_col: str, anchors: Column, scale: int) -> DataFrame:
    """__id, __l (label), __q (bytes of longs), __norm, __is (an anchor) of the rows that take part."""
    kind = rows.schema[label_col].dataType.typeName()
    label = F.col(label_col).cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64(label_col)
    told = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector_col) > 0)
    narrow = rows.filter(told).select(F.col(id_col).cast("long").alias("__id"), label.alias("__l"), F.coalesce(anchors, F.lit(False)).alias("__is"), F.col(vector_col).cast("array<double>").alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fit = np.flatnonzero(odd[ends[1:]] == odd[ends[:-1]])
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.nan_to_num(np.floor(scale * flat)), -(2.0**62), 2.0**62).astype(np.int64)
            squares = np.concatenate([[0.0], np.cumsum(whole.astype(float) ** 2)])
            own = [whole[ends[i] : ends[i + 1]] for i in fit.tolist()]
            norms = [math.sqrt(float((x.astype(float) ** 2).sum())) for x in own] if squares[-1] > 1e15 else np.sqrt(squares[ends[1:][fit]] - squares[ends[:-1][fit]])
            some = pa.array(fit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(norms, pa.float64()), batch.column(2).take(some)], names=["__id", "__l", "__q", "__norm", "__is"])

    return narrow.mapInArrow(run, "__id long, __l long, __q binary, __norm double, __is boolean")


class Rows(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray


def packed(rows: DataFrame, windows: bool) -> DataFrame:
    """Blocks of up to ``BLOCK`` rows of one length; with their ``__windows`` where these are asked."""
    fields = ("__w", "__hi", "__width", "__p", "__ep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def blob(own: list[tuple]) -> pa.RecordBatch:
            q = np.frombuffer(b"".join(r[2] for r in own), np.int64).reshape(len(own), -1)
            narrow = next(t for t in (np.int16, np.int32, np.int64) if np.abs(q.astype(float)).max() < np.iinfo(t).max)
            made = [Rows(np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.int64), q.astype(narrow))]
            if windows:
                at = np.repeat(np.arange(len(own)), [len(r[3]) for r in own])
                made += [at, *(np.array([w[f] for r in own for w in r[3]], np.int64) for f in fields)]
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["__blob"])

        for batch in batches:
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch, "__q")]
            columns += [batch.column(3).to_pylist()] if windows else []
            for row in zip(*columns, strict=True):
                own = held.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) == BLOCK:
                    yield blob(held.pop(len(row[2])))
        for own in held.values():
            yield blob(own)

    return rows.select("__id", "__l", "__q", *(["__windows"] if windows else [])).mapInArrow(run, "__blob binary")


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices, held within ``TOP``."""
    bound = a.shape[1] * float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max())
    if bound < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 2**62:
        return np.clip(a.astype(np.int64) @ b.astype(np.int64).T, -TOP, TOP)
    return np.clip(a.astype(object) @ b.astype(object).T, -TOP, TOP).astype(np.int64)


def matches(rows: Rows, asked: list, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, rows, scores) of every row in a window's range, by places."""
    anchors, at, _, hi, width = asked[:5]
    if not len(at) or rows.q.shape[1] != anchors.q.shape[1]:
        return
    # windows lie by anchor
    first = np.searchsorted(at, np.arange(len(anchors.ids)))
    many = np.bincount(at, minlength=len(anchors.ids))
    top, low = np.full(len(many), -TOP - 1), np.full(len(many), TOP + 1)
    np.maximum.at(top, at, hi)
    np.minimum.at(low, at, hi - width)
    tile = max(1, CELLS // len(anchors.ids))
    for t in range(0, len(rows.ids), tile):
        cols = slice(t, t + tile)
        scores = inner(anchors.q, rows.q[cols])
        fit = (scores <= top[:, None]) & (scores >= low[:, None])
        if same:
            fit &= (anchors.labels[:, None] == rows.labels[None, cols]) & (anchors.ids[:, None] != rows.ids[None, cols])
        else:
            fit &= anchors.labels[:, None] != rows.labels[None, cols]
        i, v = np.nonzero(fit)
        s = scores[i, v]
        each = many[i]
        ends = np.cumsum(each)
        k = np.repeat(np.arange(len(i)), each)
        w = first[i][k] + np.arange(len(k)) - np.repeat(ends - each, each)
        d = hi[w] - s[k]
        inside = (d >= 0) & (d <= width[w])
        yield w[inside], v[k][inside] + t, s[k][inside]


def met(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    # a stated query set against all rows, packed: not a join of rows
    return blocks.select(F.col("__blob").alias("__rows")).crossJoin(asked.select(F.col("__blob").alias("__asked")))


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Rows, list, bytes]]:
    known: dict[bytes, list] = {}
    for batch in batches:
        for rows, asked in zip(as_bytes(batch, "__rows"), as_bytes(batch, "__asked"), strict=True):
            if asked not in known:
                known = {asked: pickle.loads(asked)}
            yield pickle.loads(rows)[0], known[asked], asked


def histograms(meetings: DataFrame, same: bool, k: int, shift: int, by_id: bool, least: int) -> DataFrame:
    """__w, __bucket, __count: the digit at ``shift`` of the distances (or ids) of the rows under each window's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for names, counts in sums.values():
                # up to the bucket in which the task's own rows reach k
                upto = np.cumsum(counts, axis=1) - counts
                w, bucket = np.nonzero((counts > 0) & (upto < k))
                yield pa.RecordBatch.from_arrays([pa.array(names[w]), pa.array(bucket.astype(np.int32)), pa.array(counts[w, bucket])], names=["__w", "__bucket", "__count"])
            sums.clear()

        for rows, asked, key in pairs_of(batches):
            names, hi, prefix, below = asked[2], asked[3], asked[5], asked[6]
            if key not in sums:
                if len(sums) == 4:
                    yield from flushed()
                sums[key] = names, np.zeros((len(names), BUCKETS), np.int64)
            counts = sums[key][1]
            for w, v, s in matches(rows, asked, same):
                d = hi[w] - s
                if by_id:
                    e = (rows.ids[v] - least).view(np.uint64) >> np.uint64(shift)
                    fit = (d == prefix[w]) & ((e >> np.uint64(DIGIT)) == below[w].view(np.uint64))
                    digit = (e & np.uint64(BUCKETS - 1)).astype(np.int64)
                else:
                    d = d >> shift
                    fit = (d >> DIGIT) == prefix[w]
                    digit = d & (BUCKETS - 1)
                counts += np.bincount(w[fit] * BUCKETS + digit[fit], minlength=counts.size).reshape(counts.shape)
        yield from flushed()

    return meetings.mapInArrow(run, "__w long, __bucket int, __count long")


def gathered(meetings: DataFrame, same: bool, least: int) -> DataFrame:
    """__w, __id, __score, __count of the rows up to each window's limits (__p of the distance, __ep of the id at that distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, asked, _ in pairs_of(batches):
            names, hi, far, last = asked[2], asked[3], asked[5], asked[6]
            for w, v, s in matches(rows, asked, same):
                d = hi[w] - s
                e = (rows.ids[v] - least).view(np.uint64)
                fit = (d < far[w]) | ((d == far[w]) & (e <= last[w].view(np.uint64)))
                if fit.any():
                    found, counts = np.unique(np.stack([names[w[fit]], rows.ids[v[fit]], s[fit]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in found], pa.array(counts.astype(np.int64))], names=["__w", "__id", "__score", "__count"])

    found = meetings.mapInArrow(run, "__w long, __id long, __score long, __count long")
    return found.groupBy("__w", "__id", "__score").agg(F.sum("__count").alias("__count"))


def asked_blocks(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Packed anchors (__a, __id, __l, __q) with their windows; about a block a partition."""
    lists = windows.groupBy("__a").agg(F.sort_array(F.collect_list(F.struct("__w", "__hi", "__width", "__p", "__ep"))).alias("__windows"))
    n = max(1, math.ceil(lists.count() / BLOCK))
    return cut(packed(anchors.join(lists, "__a").repartition(n, "__a"), True))


def select_first(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, k: int, ids: tuple[int, int]) -> DataFrame:
    """__w, __id, __score, __rank of the first ``k`` rows of each window (__w, __a, __hi, __width), by score down and id."""
    least, largest = ids
    widest = windows.agg(F.max("__width")).first()[0]
    state = windows.select("__w", "__a", "__hi", "__width", F.lit(0).cast("long").alias("__p"), F.lit(0).cast("long").alias("__ep"), F.lit(0).cast("long").alias("__above"))
    if widest is None:
        return state.select("__w", F.col("__a").alias("__id"), F.col("__p").alias("__score"), F.lit(1).alias("__rank"))
    digits = lambda most: range(DIGIT * ((most.bit_length() - 1) // DIGIT if most else 0), -1, -DIGIT)
    rounds = [(s, False) for s in digits(int(widest))] + [(s, True) for s in digits(largest - least)]
    closed, open_ = [], cut(state)
    for shift, by_id in rounds:
        asked = asked_blocks(anchors, open_)
        counts = histograms(met(blocks, asked), same, k, shift, by_id, least).groupBy("__w", "__bucket").agg(F.sum("__count").alias("__count"))
        # at most a bucket for each value of a digit
        upto = F.sum("__count").over(Window.partitionBy("__w").orderBy("__bucket"))
        reach = F.struct("__bucket", "__upto", "__count")
        kth = open_.select("__w", "__above").join(counts.withColumn("__upto", upto), "__w").filter(F.col("__above") + F.col("__upto") >= k).groupBy("__w").agg(F.min(reach).alias("__kth"))
        told = open_.join(kth, "__w", "left")
        prefix = F.shiftleft("__ep" if by_id else "__p", DIGIT) + F.col("__kth.__bucket")
        end = F.shiftleft(prefix, shift) + F.lit((1 << shift) - 1)
        whole = F.col("__kth").isNull()  # fewer than k rows: all of them
        full = whole | (F.col("__above") + F.col("__kth.__upto") == k) | F.lit(by_id and shift == 0)
        every = F.lit(-1).cast("long")  # unsigned: beyond every id
        told = told.select(
            "__w", "__a", "__hi", "__width",
            (F.col("__p") if by_id else F.when(whole, F.col("__width")).when(full, end).otherwise(prefix)).alias("__p"),
            (F.when(whole, every).when(full, end).otherwise(prefix) if by_id else F.when(full, every).otherwise(F.lit(0).cast("long"))).alias("__ep"),
            (F.col("__above") + F.coalesce(F.col("__kth.__upto") - F.col("__kth.__count"), F.lit(0))).alias("__above"),
            full.alias("__full"),
        )
        last, told = open_, cut(told)
        drop(last, asked)
        closed.append(told)
        open_ = cut(told.filter("NOT __full").drop("__full"))
        if open_.isEmpty():
            break
    done = closed[0].filter("__full")
    for more in closed[1:]:
        done = done.unionByName(more.filter("__full"))
    asked = asked_blocks(anchors, done)
    found = gathered(met(blocks, asked), same, least)
    # repeated rows are told by their number; k of them are enough
    each = found.select("__w", "__id", "__score", F.explode(F.sequence(F.lit(1), F.least(F.col("__count"), F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("__w").orderBy(F.desc("__score"), "__id"))
    out = cut(each.select("__w", "__id", "__score", rank.alias("__rank")).filter(F.col("__rank") <= k))
    drop(*closed, open_, asked)
    return out


def hundredths(score: Column, by: int) -> Column:
    """``by`` hundredths of a score, exactly."""
    return score.cast("decimal(25,0)") * by / 100


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the rows; ids are whole numbers.
    """
    every = cut(quantised(rows, id_col, vector_col, label_col, anchors, scale))
    longest, least, largest = every.agg(F.max("__norm"), F.min("__id"), F.max("__id")).first()
    ids = (least or 0, largest or 0)
    own = every.filter("__is").groupBy("__id", "__l", "__q").agg(F.first("__norm").alias("__norm"))
    own = cut(own.withColumn("__a", F.monotonically_increasing_id()))
    blocks = cut(packed(every, False))
    reach = F.least(F.ceil(F.col("__norm") * (float(longest or 0) * (1 + 1e-9))).cast("double") + 1, F.lit(float(TOP))).cast("long")
    first = select_first(blocks, own, own.select(F.col("__a").alias("__w"), "__a", reach.alias("__hi"), (2 * reach).alias("__width")), True, positives, ids)
    score = F.col("__score")
    lo, hi = F.ceil(hundredths(score, low)).cast("long"), F.floor(hundredths(score, high)).cast("long")
    opened = cut(first.select((F.col("__w") * positives + F.col("__rank") - 1).alias("__w"), F.col("__w").alias("__a"), F.col("__id").alias("__positive"), score.alias("__ps"), hi.alias("__hi"), (hi - lo).alias("__width")).filter("__width >= 0"))
    found = select_first(blocks, own, opened.select("__w", "__a", "__hi", "__width"), False, negatives, ids)
    named = found.join(opened.select("__w", "__a", "__positive", "__ps"), "__w").join(own.select("__a", F.col("__id").alias("__anchor")), "__a")
    return named.select(F.col("__anchor").alias("anchor_id"), F.col("__positive").alias("positive_id"), F.col("__rank").cast("int").alias("rank"), F.col("__id").alias("negative_id"), F.col("__ps").alias("positive_score"), F.col("__score").alias("negative_score"))


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
a AS (SELECT DISTINCT * FROM r WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM a JOIN r ON len(a.q) = len(r.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same AND vec_id <> anchor_id),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.k ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
