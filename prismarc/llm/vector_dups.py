"""Near-duplicate vectors by sorted projection passes.

Vectors link if their labels are equal and their cosine is ``least`` or more.
Equal vectors of a label are one node with a count.  A node has a hash of 32
bits for each pass: the signs of random projections, one after another.  A pass
orders the nodes of a label by its hash and cuts the order into blocks; each
node meets those of its own block and of the blocks beside it, so its window is
bounded.  What a window can't hold is found by an exact way: where more than two
blocks share the first ``m`` signs (a run), every two of its blocks meet as
well, in cells of ``CELL`` x ``CELL`` blocks.  So a pass finds every link whose
ends share the run, however many share it, and others by their place.

``m`` is what leaves about a block a run in the largest label, and the number of
passes follows from it: a pair at the threshold shares a run with probability
(1 - acos(least) / pi) ** m, and must miss it in all passes with probability
``miss`` at most.  Pairs closer than that are missed more rarely still.

Pairs are counted, not listed: a pair that shares runs is counted in the first
pass in which it does, which its two nodes show (they carry all their hashes).
Only pairs that share none, but met in a window, are rows.  Links join to
components as a star for each meeting of blocks; components come from
``simhash.components``.

Rows whose id, label or vector is null, and vectors that are empty, zero or hold
a null or a number that isn't finite, link with nothing and are components of
their own.  Vectors of different lengths never link.  Every row is a vector:
repeated rows link with one another.  Further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, cut, drop, mark, sweep
from .simhash import components

LEAST, MISS, BLOCK, CELL, AT_ONCE, SALTS, BITS = 0.98, 1e-6, 256, 16, 4, 64, 32
COUNT, LINK, PAIR, HELD, SIZE = range(5)
FOUND = "__kind int, __a long, __b long, __x long, __y long, __data binary"
SALT = f"pmod(xxhash64(__id), {SALTS}) AS __salt"


def comparable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """__id, __g (label and length as a hash), __h1, __h2 and __v (bytes of doubles); all but the id null where nothing may link."""
    kind = dict(rows.dtypes)[id_col]
    v = F.col(vector_col).cast("array<double>")
    g = F.when(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull(), F.xxhash64(F.col(label_col), F.size(vector_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(float) + 0.0
            odd, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(flat), flat != 0))
            fit = (odd[ends[1:]] == odd[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
            fit &= batch.column(1).is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
            data = memoryview(flat).cast("B") if len(flat) else b""
            own = [bytes(data[8 * a : 8 * b]) if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), fit.tolist(), strict=True)]
            hashes = [pa.array([None if x is None else xxhash.xxh64_intdigest(x, seed) - (1 << 63) for x in own], pa.int64()) for seed in (1, 2)]
            gone = pa.array(~fit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(gone, pa.scalar(None, pa.int64()), batch.column(1)), *hashes, pa.array(own, pa.binary())], names=["__id", "__g", "__h1", "__h2", "__v"])

    return rows.select(F.col(id_col).alias("__id"), g.alias("__g"), v.alias("__v")).mapInArrow(run, f"__id {kind}, __g long, __h1 long, __h2 long, __v binary")


def plan(largest: int, least: float, miss: float, block: int) -> tuple[int, int]:
    """(signs of a run, passes) for so many nodes in the largest label."""
    m = min(BITS, max(0, math.ceil(math.log2(max(largest, 1) / block))))
    share = (1 - math.acos(least) / math.pi) ** m
    return m, 1 if share >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - share)))


def with_keys(nodes: DataFrame, passes: int, seed: int) -> DataFrame:
    """``nodes`` with __keys: the signs of each pass as an int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
        for batch in batches:
            raws = as_bytes(batch, "__v")
            keys = np.zeros((len(raws), passes), np.int32)
            sizes = np.array([len(x) // 8 for x in raws])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, passes * BITS))
                signs = units([raws[i] for i in at], size) @ planes[size] > 0
                keys[at] = (signs.reshape(len(at), passes, BITS) * weights).sum(axis=2).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, passes), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "__keys"])

    return nodes.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in nodes.dtypes) + ", __keys array<int>")


def units(raws: list[bytes], size: int) -> np.ndarray:
    """Unit vectors of so many doubles each, padded with zeros."""
    out = np.zeros((len(raws), size))
    for row, raw in zip(out, raws, strict=True):
        row[: len(raw) // 8] = np.frombuffer(raw)
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True), 5e-324) if size else 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 5e-324)


class Nodes(NamedTuple):
    """Nodes in the order of a pass: pass, label, number, count, run in every pass, unit vector."""

    q: np.ndarray
    g: np.ndarray
    n: np.ndarray
    c: np.ndarray
    runs: np.ndarray
    x: np.ndarray

    def part(self, a: int, b: int) -> Nodes:
        return Nodes(*(v[a:b] for v in self))

    def run_at(self, i: int) -> int:
        """The run of a node in its pass, as a number."""
        return xxhash.xxh64_intdigest(struct.pack("<qqq", int(self.q[i]), int(self.g[i]), int(self.runs[i, self.q[i]]))) - (1 << 63)

    def of_run(self, i: int) -> Nodes:
        """The nodes of the run that node ``i`` is in."""
        fit = (self.q == self.q[i]) & (self.g == self.g[i]) & (self.runs[:, self.q[i]] == self.runs[i, self.q[i]])
        return Nodes(*(v[fit] for v in self))


def joined(parts: list[Nodes]) -> Nodes:
    width = max(p.x.shape[1] for p in parts)
    wide = [np.pad(p.x, ((0, 0), (0, width - p.x.shape[1]))) for p in parts]
    return Nodes(*(np.concatenate(v) for v in list(zip(*parts, strict=True))[:-1]), np.concatenate(wide))


def nodes_of(batch: pa.RecordBatch, m: int) -> Nodes:
    column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
    keys = column["__keys"].flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(batch.num_rows, -1)
    raws = as_bytes(batch, "__v")
    runs = (keys.astype(np.uint64) >> np.uint64(BITS - m)).astype(np.uint32)
    plain = [column[c].to_numpy(zero_copy_only=False) for c in ("__q", "__g", "__n", "__c")]
    return Nodes(*plain, runs, units(raws, max(len(r) for r in raws) // 8))


class Finds:
    """Counts, stars and pairs as rows."""

    def __init__(self) -> None:
        self.rows: list[list] = [[], [], [], [], [], []]

    def add(self, kind: int, a, b, x=None, y=None, data=None) -> None:
        n = len(a)
        for column, v in zip(self.rows, (np.full(n, kind, np.int32), a, b, np.zeros(n, np.int64) if x is None else x, np.zeros(n, np.int64) if y is None else y, [None] * n if data is None else data), strict=True):
            column.append(v)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int32(), *[pa.int64()] * 4)
        arrays = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(self.rows, kinds, strict=False)]
        data = pa.array([x for part in self.rows[-1] for x in part], pa.binary())
        self.rows = [[], [], [], [], [], []]
        return pa.RecordBatch.from_arrays([*arrays, data], names=["__kind", "__a", "__b", "__x", "__y", "__data"])

    def meet(self, a: Nodes, b: Nodes | None, least: float) -> None:
        """The links between ``a`` and ``b``, or within ``a``, that belong to this pass or to none."""
        both = a if b is None else joined([a, b])
        first, last = 0, len(a.n)
        label = np.arange(len(both.n))
        counts = np.zeros(len(label), np.int64)
        for r in range(0, last, 64):
            rows = slice(r, min(r + 64, last))
            c0 = rows.start if b is None else last
            near = (both.x[rows] @ both.x[c0:].T >= least) & (both.g[rows, None] == both.g[None, c0:]) & (both.q[rows, None] == both.q[None, c0:])
            i, j = np.nonzero(near)
            i, j = i + rows.start, j + c0
            i, j = (i[i < j], j[i < j]) if b is None else (i, j)
            if not len(i):
                continue
            same = both.runs[i] == both.runs[j]
            met = np.where(same.any(axis=1), same.argmax(axis=1), -1)
            mine, rare = met == both.q[i], met < 0
            np.add.at(counts, i[mine], both.c[j[mine]])
            np.add.at(counts, j[mine], both.c[i[mine]])
            if rare.any():
                s, t = i[rare], j[rare]
                order = both.n[s] < both.n[t]
                s, t = np.where(order, s, t), np.where(order, t, s)
                self.add(PAIR, both.n[s], both.n[t], both.c[s], both.c[t])
            use = mine | rare
            i, j = i[use], j[use]
            while len(i):  # the least place of each star
                new = label.copy()
                np.minimum.at(new, i, label[j])
                np.minimum.at(new, j, label[i])
                new = new[new]
                if (new == label).all():
                    break
                label = new
        some = np.flatnonzero(counts)
        self.add(COUNT, both.n[some], counts[some])
        some = np.flatnonzero(label != np.arange(first, len(label)))
        self.add(LINK, both.n[some], both.n[label[some]])


def scanned(ordered: DataFrame, m: int, least: float, block: int) -> DataFrame:
    """What the blocks of a sorted partition find; beside it the blocks at its borders and those of long runs, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, finds = TaskContext.get().partitionId(), 0, Finds()
        last: list[tuple[int, Nodes]] = []  # two blocks at most
        given: set[int] = set()

        def give(k: int, own: Nodes) -> None:
            if k not in given:
                given.add(k)
                given.discard(k - 4)
                finds.add(HELD, [part], [k], [own.run_at(0)], [own.run_at(len(own.n) - 1)], [pickle.dumps(tuple(own))])

        def step(own: Nodes) -> None:
            nonlocal number, last
            finds.meet(own, None, least)
            if last:
                finds.meet(last[-1][1], own, least)
            if number < 2:
                give(number, own)
            if len(last) == 2 and last[0][1].run_at(-1) == own.run_at(0):
                for k, x in (*last, (number, own)):
                    give(k, x)
            last = [*last[-1:], (number, own)]
            number += 1

        held: list[Nodes] = []
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(nodes_of(batch.slice(at, block), m))
                if sum(len(h.n) for h in held) >= block:
                    every = joined(held)
                    step(every.part(0, block))
                    held = [every.part(block, len(every.n))] if len(every.n) > block else []
                    yield finds.batch()
        if held:
            step(joined(held))
        for k, own in last:
            give(k, own)
        if number:
            finds.add(SIZE, [part], [number])
        yield finds.batch()

    return ordered.mapInArrow(run, FOUND)


def between(found: DataFrame, least: float, cell: int) -> DataFrame:
    """What the blocks find that met in no task: across the borders of partitions, and within runs of more than two blocks."""
    sizes = found.filter(F.col("__kind") == SIZE).select(F.col("__a").alias("__p"), F.col("__b").alias("__blocks"))
    # a row a partition
    before = F.coalesce(F.sum("__blocks").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = found.filter(F.col("__kind") == HELD).join(sizes.withColumn("__before", before), F.col("__a") == F.col("__p"))
    held = held.select((F.col("__before") + F.col("__b")).alias("__no"), "__x", "__y", "__data", (F.col("__b") == 0).alias("__first"), (F.col("__b") == F.col("__blocks") - 1).alias("__last"))
    lone = F.lit(None).cast("long").alias("__lo")
    border = held.filter("__last").select(F.xxhash64(F.lit(0), "__no").alias("__cell"), F.lit(0).alias("__side"), "__no", lone, "__data")
    border = border.unionByName(held.filter("__first AND __no > 0").select(F.xxhash64(F.lit(0), F.col("__no") - 1).alias("__cell"), F.lit(1).alias("__side"), "__no", lone, "__data"))
    ends = held.select(F.explode(F.array("__x", "__y")).alias("__run"), "__no").groupBy("__run").agg(F.min("__no").alias("__lo"), F.max("__no").alias("__hi")).filter("__hi - __lo >= 2")
    runs = held.select(F.explode(F.array_distinct(F.array("__x", "__y"))).alias("__run"), "__no", "__data").join(ends, "__run")
    own = F.floor((F.col("__no") - F.col("__lo")) / cell)
    runs = runs.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__hi") - F.col("__lo")) / cell))))
    runs = runs.select(F.xxhash64(F.lit(1), "__run", F.least("__own", "__other"), F.greatest("__own", "__other")).alias("__cell"), (F.col("__own") > F.col("__other")).cast("int").alias("__side"), "__no", "__lo", "__data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finds, now, own = Finds(), None, []

        def meet() -> pa.RecordBatch:
            # side 0 against side 1, or against itself where the cell has no other side; neighbours in a run have met in their window
            sides = {s for s, *_ in own}
            for k, (s, no, lo, a) in enumerate(own):
                for t, other, _, b in own[k + 1 :]:
                    if (s != t or len(sides) == 1) and (lo is None or abs(no - other) > 1):
                        finds.meet(a, b, least)
            return finds.batch()

        for batch in batches:
            cells, side, numbers, lows = (batch.column(k).to_pylist() for k in range(4))
            for c, s, no, lo, data in zip(cells, side, numbers, lows, as_bytes(batch, "__data"), strict=True):
                if c != now and own:
                    yield meet()
                    own = []
                now, nodes = c, Nodes(*pickle.loads(data))
                own.append((s, no, lo, nodes if lo is None else nodes.of_run(-1 if no == lo else 0)))
        if own:
            yield meet()

    return border.unionByName(runs).repartition("__cell").sortWithinPartitions("__cell", "__side", "__no").mapInArrow(run, FOUND)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, miss: float = MISS, block: int = BLOCK, cell: int = CELL, at_once: int = AT_ONCE, seed: int = 12) -> DataFrame:
    """Per row: id, n_links, component_id, kept.  ``at_once`` passes are sorted together."""
    every = cut(comparable(rows, id_col, vector_col, label_col))
    same = ["__g", "__h1", "__h2"]
    # copies may be any share of a label, so they are counted in two levels
    some = every.filter("__g IS NOT NULL").selectExpr("*", SALT)
    level = some.groupBy(*same, "__salt").agg(F.min("__id").alias("__least"), F.count(F.lit(1)).alias("__c"), F.first("__v").alias("__v"))
    nodes = level.groupBy(*same).agg(F.min("__least").alias("__least"), F.sum("__c").alias("__c"), F.first("__v").alias("__v"))
    nodes = cut(nodes.withColumn("__n", F.monotonically_increasing_id()))
    largest = nodes.groupBy("__g").count().agg(F.max("count")).first()[0] or 0
    m, passes = plan(largest, least, miss, block)
    keyed = cut(with_keys(nodes.select("__n", "__g", "__c", "__v"), passes, seed))
    finds = []
    for at in range(0, passes, at_once):
        turn = keyed.withColumn("__q", F.explode(F.sequence(F.lit(at), F.lit(min(at + at_once, passes) - 1))))
        turn = turn.withColumn("__key", F.element_at("__keys", F.col("__q") + 1))
        order = ["__q", "__g", "__key", "__n"]
        found = cut(scanned(turn.repartitionByRange(*order).sortWithinPartitions(*order), m, least, block))
        finds += [found, cut(between(found, least, cell))]
    drop(keyed)
    met = finds[0]
    for f in finds[1:]:
        met = met.unionByName(f)
    pairs = met.filter(F.col("__kind") == PAIR).select("__a", "__b", "__x", "__y").distinct()
    counts = met.filter(F.col("__kind") == COUNT).select("__a", "__b").unionByName(pairs.select("__a", F.col("__y").alias("__b"))).unionByName(pairs.select(F.col("__b").alias("__a"), F.col("__x").alias("__b")))
    counts = counts.groupBy("__a").agg(F.sum("__b").alias("__links"))
    since = mark()
    roots = cut(components(met.filter(F.col("__kind") == LINK).select("__a", "__b")))
    sweep(rows.sparkSession, since, roots)
    rooted = nodes.join(roots, F.col("__n") == F.col("__node"), "left").select("__n", *same, "__least", "__c", F.coalesce("__root", "__n").alias("__root"))
    named = rooted.join(rooted.groupBy("__root").agg(F.min("__least").alias("__first")), "__root").join(counts, F.col("__n") == F.col("__a"), "left")
    told = named.select(*same, (F.col("__c") - 1 + F.coalesce("__links", F.lit(0))).alias("__links"), "__first")
    # back to the rows in the same two levels
    salted = told.join(some.select(*same, "__salt").distinct(), same)
    out = every.selectExpr("__id", *same, SALT).join(salted, [*same, "__salt"], "left")
    least_id = F.coalesce("__first", "__id")
    return out.select(F.col("__id").alias(id_col), F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"), least_id.alias("component_id"), least_id.eqNullSafe(F.col("__id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT a AS vec_id, b AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT e.vec_id, (SELECT CAST(count(*) AS BIGINT) FROM l WHERE l.a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce(m.first, e.vec_id)) AS component_id, e.vec_id <= coalesce(m.first, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT vec_id, min(other) AS first FROM r GROUP BY vec_id) m ON m.vec_id = e.vec_id
"""
