"""Anchored windows: what the two exact substring operators share.

A text is a sequence of units (words or bytes).  A window is ``size`` units in a
row.  Among the grams of ``gram`` units in a window the one with the least hash
is its anchor (the leftmost of equals), so equal windows have equal anchors at
the same place, and neighbouring windows mostly share theirs: the windows of a
text fall into *runs*, one for about every half gram-count of units.  Only runs
move between machines.  With ``split`` a run is cut where its windows reach
further to the left of the anchor than to the right, and the anchor is extended
by what all windows of a part hold on that side: longer anchors repeat less by
chance.  A run is known by the hash of its anchor and by that of
all its units; runs with equal hashes (128 bits together) are a class.

Whatever occurs twice in the corpus occurs in two runs of one anchor, so runs
whose anchor is unique can go.  Of the rest, every run that isn't the first of
its class is covered as a whole.  What is left to compare, window by window, are
the first runs of the classes that share an anchor: the ends of repeated
passages.

Words are hashed by a chain that mixes eight bytes after eight, with two seeds
for the two halves of the 128 bits; a polynomial over letters would give long
words of Thue-Morse letters one value.  Polynomials are used over the hashes of
at most a few hundred units only, where they are no danger.

Documents are told apart by id and 23 bits of the hash of their text (the key, never negative once packed, so packed and
plain keys have one order).  Rows with
a null id are compared with nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut

U = np.uint64
PIECE = 1 << 18  # units that are worked on at once
_Q = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        n = max(n, PIECE + 4096)
        up, down = np.full(n, _Q, U), np.full(n, pow(_Q, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = _powers[0] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return have


def prefix(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the units from a to b."""
    _, down = powers(len(sums))
    return mixed((sums[b] - sums[a]) * down[a])


BYTE_1 = mixed(np.arange(1, 257, dtype=U))
BYTE_2 = mixed(np.arange(1001, 1257, dtype=U))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


#: Words of more bytes are hashed one by one.
LONG = 256
_HEADS = U((1 << 64) - 1) >> (U(64) - U(8) * np.arange(1, 9, dtype=U))


def chained(buf: bytes, a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the words buf[a:b]: eight bytes are mixed in after eight, so words of up to eight bytes and one length never collide.

    ``buf`` has eight bytes more than the last word.
    """
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    size = b - a
    out = mixed(size.astype(U) * U(_Q) + U(seed))
    who, at, left = np.arange(len(a)), a, size
    for _ in range(LONG // 8):
        out[who] = mixed(out[who] ^ (eight[at] & _HEADS[np.minimum(left, 8) - 1]))
        more = left > 8
        if not more.any():
            return out
        who, at, left = who[more], at[more] + 8, left[more] - 8
    for i in who.tolist():
        out[i] = xxhash.xxh64_intdigest(buf[a[i] : b[i]], seed)
    return out


def word_hashes(raws: list[bytes], seeds: tuple[int, ...] = (42,)) -> tuple[np.ndarray, ...]:
    """(hash of every word for each seed, ..., number of words of each text)."""
    found: list[list[np.ndarray]] = [[] for _ in seeds]
    counts = np.zeros(len(raws), np.int64)

    def work(part: bytes, starts_of: np.ndarray, first: int) -> None:
        gap = _SEPARATOR[np.frombuffer(part, np.uint8)]
        a = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        b = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
        padded = part + bytes(8)
        for own, seed in zip(found, seeds, strict=True):
            own.append(chained(padded, a, b, seed))
        np.add.at(counts, first + np.searchsorted(starts_of, a, "right") - 1, 1)

    i = 0
    while i < len(raws):
        if len(raws[i]) > PIECE:
            raw, at = raws[i], 0
            while at < len(raw):
                end = min(len(raw), at + PIECE)
                while end < len(raw) and not _SEPARATOR[raw[end]]:
                    end += 1
                work(raw[at:end], np.zeros(1, np.int64), i)
                at = end
            i += 1
            continue
        j, held = i, 0
        while j < len(raws) and (j == i or held + len(raws[j]) < PIECE) and len(raws[j]) <= PIECE:
            held += len(raws[j]) + 1
            j += 1
        if held > j - i:
            starts = np.cumsum([0] + [len(x) + 1 for x in raws[i : j - 1]])
            work(b"\n".join(raws[i:j]), starts, i)
        i = j
    return *[np.concatenate(own) if own else np.zeros(0, U) for own in found], counts


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


@dataclass(frozen=True)
class Windows:
    """``size`` units a window, ``gram`` units an anchor, units are words or bytes."""

    size: int
    gram: int
    words: bool
    split: bool = False

    def units(self, raws: list[bytes], second: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(first values, second values if wanted, number of units of each text)."""
        if self.words:
            one, *two, counts = word_hashes(raws, (42, 4242) if second else (42,))
            return one, two[0] if two else None, counts
        buf = np.frombuffer(b"".join(raws), np.uint8)
        return BYTE_1[buf], BYTE_2[buf], np.array([len(x) for x in raws], np.int64)

    def runs(self, one: np.ndarray, two: np.ndarray | None, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(a, b, anchor hash, run hash) of windows a..b within texts that end at ``ends`` (by unit); run hashes only if ``two`` is given."""
        n, size, gram = len(one), self.size, self.gram
        if n < size:
            none = np.zeros(0, np.int64)
            return none, none, none.view(U), none.view(U)
        sums = prefix(one)
        grams = mixed((sums[gram:] - sums[:-gram]) * powers(n + 1)[1][: n - gram + 1])
        low = U((1 << 22) - 1)
        anchor = (sliding_min((grams & ~low) | np.arange(n - gram + 1, dtype=U), size - gram + 1) & low).astype(np.int64)
        start = np.arange(n - size + 1)
        inside = ends[: n - size + 1] - start >= size
        new = np.ones(len(start), bool)
        new[1:] = ~inside[:-1] | (anchor[1:] != anchor[:-1])
        last = np.ones(len(start), bool)
        last[:-1] = ~inside[1:] | (anchor[1:] != anchor[:-1])
        a, b = np.flatnonzero(inside & new), np.flatnonzero(inside & last)
        at = anchor[a]
        h = grams[at]
        if self.split and len(a):
            half = (size - gram) // 2
            turn = at - half  # windows from here on the left hold the units from at - half to at + gram, the others those from at to at + gram + half
            lefts, rights = np.flatnonzero(a <= turn), np.flatnonzero(b > turn)
            h = np.concatenate([spans_hash(sums, turn[lefts], at[lefts] + gram), ~spans_hash(sums, at[rights], at[rights] + gram + half)])
            a, b, at = (
                np.concatenate([a[lefts], np.maximum(a[rights], turn[rights] + 1)]),
                np.concatenate([np.minimum(b[lefts], turn[lefts]), b[rights]]),
                np.concatenate([at[lefts], at[rights]]),
            )
        if two is None:
            return a, b, h, np.zeros(len(a), U)
        place = (at - a).astype(U) << U(16) | (b - a).astype(U)
        return a, b, h, mixed(spans_hash(prefix(two), a, b + size) + place)


def doc_pieces(counts: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, text of each unit, end of each unit's text) of pieces of all units; longer texts overlap by a window."""
    total, at = int(counts.sum()), 0
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    while at < total:
        end = min(total, at + PIECE + size - 1)
        yield at, end, text[at:end], np.minimum(ends[at:end], end) - at
        if end == total:
            break
        at = end - size + 1


def anchors(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[np.ndarray]:
    """The anchor hash of every run of the texts (__raw, the first column)."""
    for batch in batches:
        raws = [x or b"" for x in as_bytes(batch, "__raw")]
        for first, last in _bunches(raws):
            one, _, counts = windows.units(raws[first:last], second=False)
            for lo, hi, _, ends in doc_pieces(counts, windows.size):
                h = windows.runs(one[lo:hi], None, ends)[2]
                if len(h):
                    yield h


def anchor_table(docs: DataFrame, windows: Windows) -> DataFrame:
    """__h of every run of docs (__raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in anchors(batches, windows):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["__h"])

    return docs.select("__raw").mapInArrow(run, "__h long")


#: Bits of the bitmap of repeated anchors (32 MB), whatever the corpus.
BITMAP = 28
SLICES = 64
Test = Callable[[np.ndarray], np.ndarray]


def probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U(64 - BITMAP)).astype(np.int64), (h & U((1 << BITMAP) - 1)).astype(np.int64)


def bitmap(found: DataFrame) -> bytes:
    """Two bits set for each __h.  Its size is fixed; full, it prunes less and loses nothing."""
    width = (1 << BITMAP) // SLICES

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(probes(batch.column(0).to_numpy(zero_copy_only=False).view(U))))
            yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))], names=["__slice", "__at"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            which, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for k in np.unique(which).tolist():
                held.setdefault(k, np.zeros(width, bool))[at[which == k]] = True
        for k, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits).tobytes()])], names=["__slice", "__bits"])

    out = bytearray((1 << BITMAP) // 8)
    dealt = found.select("__h").mapInArrow(places, "__slice int, __at int").repartition(SLICES // 4, "__slice")
    for k, bits in dealt.mapInArrow(collect, "__slice int, __bits binary").toLocalIterator():
        out[k * width // 8 : (k + 1) * width // 8] = bits
    return bytes(out)


def bit_test(bits: bytes, at: np.ndarray) -> np.ndarray:
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def among(found: DataFrame) -> Test:
    """A test for the anchors __h of ``found``, by their bitmap."""
    sent = found.sparkSession.sparkContext.broadcast(bitmap(found))

    def test(h: np.ndarray) -> np.ndarray:
        x, y = probes(h)
        return bit_test(sent.value, x) & bit_test(sent.value, y)

    return test


def run_table(docs: DataFrame, windows: Windows, wanted: Test) -> DataFrame:
    """__h (anchor), __c (run), __id, __p (the text's key, first window, windows - 1) of docs (__id, __k, __raw), of ``wanted`` anchors."""
    id_type = dict(docs.dtypes)["__id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            raws = [x or b"" for x in as_bytes(batch, "__raw")]
            for first, last in _bunches(raws):
                one, two, counts = windows.units(raws[first:last])
                starts = np.concatenate([[0], np.cumsum(counts)])
                for lo, hi, which, ends in doc_pieces(counts, windows.size):
                    a, b, h, c = windows.runs(one[lo:hi], two[lo:hi], ends)
                    some = wanted(h)
                    a, b, h, c = a[some], b[some], h[some], c[some]
                    if not len(a):
                        continue
                    doc = which[a]
                    packed = keys[first + doc] << 40 | (a + lo - starts[doc]) << 8 | (b - a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), ids.take(pa.array(first + doc)), pa.array(packed)], names=["__h", "__c", "__id", "__p"]
                    )

    return docs.mapInArrow(run, f"__h long, __c long, __id {id_type}, __p long")


def _bunches(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    first = held = 0
    for i, raw in enumerate(raws):
        if held and held + len(raw) > PIECE:
            yield first, i
            first, held = i, 0
        held += len(raw)
    if raws:
        yield first, len(raws)


def text_key(raw: Column) -> Column:
    """23 bits of the hash of a text."""
    return F.xxhash64(raw).bitwiseAND(0x7FFFFF)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __k, __raw of all rows (null texts are empty)."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("__id"), text_key(raw).alias("__k"), raw.alias("__raw"))


@dataclass
class Classes:
    """``covered``: __id, __k, __a, __n of runs that an earlier equal run covers.  ``open``: __h, __id, __k, __a, __n, __hot of runs to compare."""

    covered: DataFrame
    open: DataFrame
    tables: tuple[DataFrame, ...]


START, COUNT = "shiftrightunsigned(shiftleft(__p, 24), 32) AS __a", "__p & 255 AS __n"
KEY = "shiftrightunsigned(__p, 40) AS __k"
#: Anchors with more kinds of run than ``HOT`` are hot.  The ``HOTTEST`` of them are told to all tasks, so their runs meet nowhere;
#: one beyond these has under 1 / HOTTEST of all runs and learns that it is hot in the join by anchor.
HOT, HOTTEST = 2_048, 65_536


def classes(runs: DataFrame, within: bool) -> Classes:
    """Of ``runs`` that are written out.  ``within``: an earlier start in the same document counts, too.

    No class and no frequent anchor ever meets in a task: the first run of a class is an aggregate, and its other runs are
    those that aren't the first, by a join on the whole row; the anchors with many kinds of run are sent to all tasks.
    Here and below joins merge, whatever the sizes, so that small inputs run as large ones do.
    """
    least = F.struct("__id", "__p") if within else F.struct("__id")
    firsts = cut(runs.groupBy("__h", "__c").agg(F.min(least).alias("__first")).select("__h", "__c", "__first.*"))
    kinds = cut(firsts.groupBy("__h").agg(F.count("*").alias("__kinds")).filter("__kinds > 1"))
    hot = F.broadcast(kinds.filter(F.col("__kinds") > HOT).orderBy(F.desc("__kinds"), "__h").limit(HOTTEST).select("__h"))
    row, told = list(firsts.columns), firsts.hint("merge")
    covered = runs.join(told, row, "left_anti").selectExpr("__id", KEY, START, COUNT)
    rest = firsts if within else runs.join(told, row, "left_semi")
    cold = rest.join(hot, "__h", "left_anti").join(kinds.select("__h", (F.col("__kinds") > HOT).alias("__hot")).hint("merge"), "__h").select(*rest.columns, "__hot")
    every = cold.unionByName(rest.join(hot, "__h", "left_semi").withColumn("__hot", F.lit(True)))
    return Classes(covered, every.selectExpr("__h", "__id", KEY, START, COUNT, "__hot"), (firsts, kinds))


def window_rows(texts: DataFrame, windows: Windows) -> DataFrame:
    """__w1, __w2 (hashes), __id, __k, __from of every window in the open runs (__runs)."""

    def hashes(raw: bytes, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums = np.cumsum(n + 1)
        start = np.repeat(a, n + 1) + np.arange(int(sums[-1])) - np.repeat(sums - (n + 1), n + 1)
        if windows.words:
            start = np.unique(start)
            one, two, _ = windows.units([raw])
            at = start
        else:  # only the bytes of the runs are looked at
            own = [raw[x : x + k + windows.size] for x, k in zip(a.tolist(), n.tolist(), strict=True)]
            one, two, sizes = windows.units(own)
            at = np.repeat(np.cumsum(sizes) - sizes, n + 1) + start - np.repeat(a, n + 1)
        w1, w2 = (spans_hash(prefix(x), at, at + windows.size) for x in (one, two))
        return start, mixed(w1 + U(1)), w2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("__runs"))
            for i, raw in enumerate(as_bytes(batch, "__raw")):
                own = lists.slice(i, 1).flatten()
                start, w1, w2 = hashes(raw, *(own.field(f).to_numpy(zero_copy_only=False) for f in ("__a", "__n")))
                same = pa.array(np.zeros(len(start), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), batch.column(0).slice(i, 1).take(same), batch.column(1).slice(i, 1).take(same), pa.array(start)],
                    names=["__w1", "__w2", "__id", "__k", "__from"],
                )

    kind = dict(texts.dtypes)["__id"]
    return texts.select("__id", "__k", "__raw", "__runs").mapInArrow(run, f"__w1 long, __w2 long, __id {kind}, __k long, __from long")


def later_windows(rows: DataFrame, within: bool) -> DataFrame:
    """The ``rows`` of window_rows with an earlier equal one; of equal windows none meet in a task."""
    least = F.struct("__id", "__k", "__from") if within else F.struct("__id")
    first = rows.groupBy("__w1", "__w2").agg(F.min(least).alias("__first")).select("__w1", "__w2", "__first.*")
    return rows.join(first.hint("merge"), first.columns, "left_anti")


def span_lists(spans: DataFrame) -> DataFrame:
    """__id, __k, __spans: the disjoint covered (__from, __to) of each text, in order, written out."""
    lists = spans.groupBy("__id", "__k").agg(F.collect_set(F.struct("__from", "__to")).alias("__spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            found = []
            for i in range(batch.num_rows):
                own = column.slice(i, 1).flatten()
                a, b = (own.field(f).to_numpy(zero_copy_only=False) for f in ("__from", "__to"))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.concatenate([[True], a[1:] > b[:-1]])
                last = np.concatenate([new[1:], [True]])
                found.append([{"__from": x, "__to": y} for x, y in zip(a[new].tolist(), b[last].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, column.type)], names=["__id", "__k", "__spans"])

    return cut(lists.mapInArrow(run, lists.schema))


def with_spans(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs (__id, __k, ...) with __spans, null where nothing is covered.  Rows without an id stay away from the join."""
    told = docs.filter(F.col("__id").isNotNull()).join(lists.hint("merge"), ["__id", "__k"], "left")
    rest = docs.filter(F.col("__id").isNull()).withColumn("__spans", F.lit(None).cast(lists.schema["__spans"].dataType))
    return told.select(*docs.columns, "__spans").unionByName(rest)


def open_texts(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """docs (__id, __k, __raw) that have open runs, with their list __runs (__h, __a, __n, __hot)."""
    lists = rest.groupBy("__id", "__k").agg(F.collect_list(F.struct("__h", "__a", "__n", "__hot")).alias("__runs"))
    return docs.join(lists.hint("merge"), ["__id", "__k"])
