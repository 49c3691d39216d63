"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits, cut into 9 segments on a ring.  If two differ in at
most ``MOST`` = 4 bits, some segment starts a chain in which the differences of
the first j segments are at most floor(4 j / 9) for every j (0, 0, 1, 1, 2, 2,
3, 3, 4: the cycle lemma behind the pigeonring principle).  So the first two
segments of the chain agree; of the next two at least one agrees; of the next
four at least two agree.  Each start of a chain has five ways to do so: 45 keys
of 28 bits or more, by which fingerprints are grouped.  The pairs of a group
must keep the budgets of the chain that their key starts, for one number of
segments after another; only those that do come to the full Hamming check.  A
group emits a spanning forest of its links only, never all pairs.  Groups of
more than ``GROUP`` fingerprints are dealt out as pairs of blocks.

Equal fingerprints are one node, so copies cost nothing.  Components are found
by alternating large-star and small-star steps.  A null text has no words and
fingerprint zero, and so has an empty one.  A null id is ordered after all
others, as id of a component only if no other is there.  Repeated rows are
returned as often as they occur; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, drop, slices

MOST, SEGMENTS, GROUP = 4, 9, 20_000
WIDTHS = (8, 7, 7, 7, 7, 7, 7, 7, 7)
SHIFTS = tuple(sum(WIDTHS[:i]) for i in range(SEGMENTS))
#: Bits that may differ in the first j segments of a chain, and their masks by start once a fingerprint is turned to it.
BUDGETS = tuple(MOST * j // SEGMENTS for j in range(1, SEGMENTS + 1))
MASKS = np.array([[(1 << sum(WIDTHS[(s + i) % SEGMENTS] for i in range(j))) - 1 for j in range(1, SEGMENTS + 1)] for s in range(SEGMENTS)], np.uint64)
#: Places of the two further equal segments in a chain (0 and 1 are equal).
CHAINS = ((2, 3), (2, 4), (2, 5), (3, 4), (3, 5))
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Of the lower-cased words; 0 if there are none."""
    from xxhash import xxh64_intdigest as h

    words = raw.translate(_UPPER).split()  # bytes.split() splits at \x20 and \x09-\x0D exactly
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), 0
    for at in range(0, max(1, len(words) - shingle + 1), 100_000):
        part = words[at : at + 100_000 + shingle - 1]
        if len(part) < shingle:
            hashes = [h(b" ".join(part), seed)]
        else:
            join = b" ".join
            hashes = [h(join(g), seed) for g in zip(*[part[k:] for k in range(shingle)], strict=False)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __fp (the bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 8 << 20):
            found = np.array([fingerprint(raw or b"") for raw in as_bytes(batch, "__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["__id", "__fp"])

    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return narrow.mapInArrow(run, f"__id {narrow.schema[0].dataType.simpleString()}, __fp long")


def ring_keys(fps: np.ndarray) -> np.ndarray:
    """45 keys a fingerprint, as rows."""
    segments = [(fps >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
    out = np.empty((len(fps), SEGMENTS * len(CHAINS)), np.int64)
    for start in range(SEGMENTS):
        for c, (a, b) in enumerate(CHAINS):
            key = np.zeros(len(fps), np.uint64)
            for place in (0, 1, a, b):
                i = (start + place) % SEGMENTS
                key = (key << np.uint64(WIDTHS[i])) | segments[i]
            n = start * len(CHAINS) + c
            out[:, n] = (key | np.uint64(n << 40)).view(np.int64)
    return out


def turned(fps: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Fingerprints on the ring with the segment ``start`` in front."""
    by = np.array(SHIFTS, np.uint64)[start]
    return np.where(by == 0, fps, (fps >> by) | (fps << ((np.uint64(64) - by) & np.uint64(63))))


def chained(differ: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Places of those differences (of turned fingerprints) whose every chain prefix keeps its budget."""
    at = np.arange(len(differ))
    for j, most in list(enumerate(BUDGETS))[2:-1]:
        mask = MASKS[start, j] if np.isscalar(start) else MASKS[start[at], j]
        at = at[np.bitwise_count(differ[at] & mask) <= most]
    return at


def forest(left: np.ndarray, right: np.ndarray | None = None, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``left``, or between it and ``right``: at most a link a node."""
    nodes = left if right is None else np.concatenate([left, right])
    ring = turned(nodes, start)
    label = np.arange(len(nodes))
    tile, border = 1024, len(left)
    a: list[int] = []
    b: list[int] = []
    for r in range(0, border, tile):
        x = slice(r, min(r + tile, border))
        for c in range(r if right is None else border, len(nodes), tile):
            y = slice(c, c + tile)
            differ = (ring[x, None] ^ ring[None, y]).ravel()
            at = chained(differ, start)
            near = np.zeros(len(differ), bool)
            near[at[np.bitwise_count(differ[at]) <= MOST]] = True
            near = near.reshape(x.stop - x.start, -1)
            while True:
                fresh = near & (label[x, None] != label[None, y])
                rows = np.flatnonzero(fresh.any(axis=1))
                if not len(rows):
                    break
                for i, j in zip(rows + r, fresh[rows].argmax(axis=1) + c, strict=True):
                    if label[i] != label[j]:
                        label[label == label[j]] = label[i]
                        a.append(i)
                        b.append(j)
    return nodes[a] if a else nodes[:0], nodes[b] if b else nodes[:0]


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(cells, sides, starts of chains, fingerprints) in which no cell is cut; the input is sorted by cell."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        last = len(now[0]) - int((now[0] == now[0][-1])[::-1].argmin() or len(now[0])) if now[0][0] != now[0][-1] else 0
        if last:
            parts = [*held, tuple(x[:last] for x in now)]
            yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            held = [tuple(x[last:] for x in now)]
        elif held and held[-1][0][-1] != now[0][0]:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = [now]
        else:
            held.append(now)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cells, sides, chains, raw in runs_of(batches):
        fps = raw.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        sizes = np.diff(np.r_[starts, len(cells)])
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        pair = starts[sizes == 2]
        if len(pair):
            pair = pair[(sides[pair] == 0) | (sides[pair] != sides[pair + 1])]
            differ = turned(fps[pair] ^ fps[pair + 1], chains[pair])
            at = chained(differ, chains[pair])
            near = pair[at[np.bitwise_count(differ[at]) <= MOST]]
            a.append(fps[near])
            b.append(fps[near + 1])
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            own, side = fps[s : s + n], sides[s : s + n]
            start = int(chains[s])
            x, y = forest(own, None, start) if side[0] == 0 else forest(own[side == 1], own[side == 2], start)
            a.append(x)
            b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["__a", "__b"])


def links(nodes: DataFrame) -> DataFrame:
    """Links (__a, __b), a forest in each group, between the distinct __fp of ``nodes``."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                keys = ring_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1]))], names=["__key", "__fp"])

    keys = nodes.mapInArrow(keyed, "__key long, __fp long")
    hot = cut(keys.groupBy("__key").count().filter(F.col("count") > GROUP).withColumn("__blocks", F.ceil(F.col("count") / GROUP).cast("int")).drop("count"))
    start = F.floor(F.shiftright("__key", 40) / len(CHAINS)).cast("int").alias("__start")
    if hot.isEmpty():
        dealt = keys.select(F.col("__key").alias("__cell"), F.lit(0).alias("__side"), start, "__fp")
    else:
        # a group of many blocks: each block by itself (side 0) and against each other (sides 1 and 2)
        block = F.pmod(F.xxhash64("__fp"), F.col("__blocks")).cast("int")
        met = keys.join(hot, "__key", "left").withColumn("__own", F.when(F.col("__blocks").isNotNull(), block))
        other = F.explode(F.when(F.col("__blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        met = met.select("*", other.alias("__other"))
        side = F.when(F.col("__own").isNull() | (F.col("__own") == F.col("__other")), 0).when(F.col("__own") < F.col("__other"), 1).otherwise(2)
        cell = F.when(F.col("__own").isNull(), F.col("__key")).otherwise(F.xxhash64("__key", F.least("__own", "__other"), F.greatest("__own", "__other")))
        dealt = met.select(cell.alias("__cell"), side.alias("__side"), start, "__fp")
    return dealt.repartition("__cell").sortWithinPartitions("__cell").mapInArrow(group_links, "__a long, __b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(__node, __root): the least node of each component, by large-star and small-star steps."""
    edges = cut(edges.select(F.greatest("__a", "__b").alias("u"), F.least("__a", "__b").alias("v")).filter("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least(n: DataFrame) -> DataFrame:
        return n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.join(least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, edges = edges, cut(small.filter("u <> v").distinct())
        drop(last)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("__node"), F.col("v").alias("__root")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the least id that links reach)."""
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(prints.groupBy("__fp").agg(F.min("__id").alias("__least")))
    found = components(links(nodes.select("__fp")))
    rooted = nodes.join(found, nodes["__fp"] == found["__node"], "left").select("__fp", "__least", F.coalesce("__root", "__fp").alias("__root"))
    named = rooted.join(rooted.groupBy("__root").agg(F.min("__least").alias("component_id")), "__root").select("__fp", "component_id")
    return prints.join(named, "__fp").select(
        F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``near_copies.keep_one``: fingerprints at ``MOST`` bits are op7's contract and miss most near copies at 0.8."""
    from . import near_copies

    return near_copies.keep_one(docs, id_col, text_col, **options)
