"""Benchmark decontamination by greedy string tiling.

Words are maximal runs of letters and digits, lower-cased.  Documents are joined
with the benchmark on shared seeds of ``least`` words.  A pair is tiled if the
words of the item that its seeds hold could reach ``cover``: again and again the
longest match of unmarked words, of at least ``least``, is marked on both sides
(of equally long ones the first in the item, then the first in the text).  The
longest is found by running Karp-Rabin over both sides at one search length
after another, and a match is compared word by word before it is marked.  A tile
takes words of the item, so there are few, and each length costs time in
proportion to the two texts, however often their words repeat.  The share of an
item's words that tiles cover is its coverage, in whatever order the tiles lie
in the document.  Pairs with a coverage of ``cover`` or more are returned.

The benchmark is a query set: it is held against all documents in blocks of
``block_bytes``, whose size is counted before they are sent out, so any
benchmark works.  No document is grouped with another, so frequent passages
don't meet in one task.

Null texts match nothing.  An item of fewer than ``least`` words has no seed and
can't be told from chance inside a text: it matches the texts that have its
words and no others.  Items without words match nothing.  Repeated rows are
judged one by one; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, renamed, slices
from .repeats import U, mixed, prefix, spans_hash, word_hashes

LEAST, COVER, BLOCK = 5, 0.5, 16 << 20
#: ASCII that isn't a letter or digit becomes a space; other bytes are parts of words.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalised(raw: bytes) -> bytes:
    return raw.decode("utf-8", "replace").lower().encode().translate(_WORDS)


def _room(used: np.ndarray) -> np.ndarray:
    """How many unmarked words follow in a row from each place on."""
    stop = np.where(used, np.arange(len(used)), len(used))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(used))


def tile(pattern: np.ndarray | list[int], text: np.ndarray | list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, length) of the tiles; -1 in ``text`` matches nothing."""
    pattern, text = np.asarray(pattern, np.int64), np.asarray(text, np.int64)
    used_p, used_t, tiles = np.zeros(len(pattern), bool), text < 0, []
    sums_p, sums_t = (prefix(mixed(x.view(U) + U(1))) for x in (pattern, text))
    high = min(len(pattern), len(text))
    while high >= least:
        room_p, room_t = _room(used_p), _room(used_t)

        def common(length: int) -> tuple[np.ndarray, ...]:
            """Unmarked places and Karp-Rabin hashes of matches of a length, in the pattern and in the text."""
            i, j = np.flatnonzero(room_p >= length), np.flatnonzero(room_t >= length)
            own, other = spans_hash(sums_p, i, i + length), spans_hash(sums_t, j, j + length)
            in_p, in_t = np.isin(own, other), np.isin(other, own)
            return i[in_p], own[in_p], j[in_t], other[in_t]

        low, high = least - 1, min(high, int(room_p.max(initial=0)), int(room_t.max(initial=0)))
        found, length = common(high) if high >= least else (room_p[:0],), high
        if high >= least and not len(found[0]):  # matches of a length hold matches of all lesser ones
            high -= 1
            while low < high:
                length = (low + high + 1) // 2
                now = common(length)
                if len(now[0]):
                    low, found = length, now
                else:
                    high = length - 1
            length = low
        if not len(found[0]):
            return tiles
        i, own, j, other = found
        order = np.argsort(other, kind="stable")
        other, j = other[order], j[order].tolist()
        at, end = (np.searchsorted(other, own, side).tolist() for side in ("left", "right"))
        first: dict[int, int] = {}
        for k, place in enumerate(i.tolist()):
            if used_p[place : place + length].any():
                continue
            x = max(at[k], first.get(at[k], 0))
            while x < end[k] and (used_t[j[x] : j[x] + length].any() or (pattern[place : place + length] != text[j[x] : j[x] + length]).any()):
                x += 1
            first[at[k]] = x
            if x < end[k]:
                tiles.append((place, j[x], length))
                used_p[place : place + length] = used_t[j[x] : j[x] + length] = True
        high = length - 1
    return tiles


def _grams(hashes: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, text) of all grams inside a text."""
    n = len(hashes) - least + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.view(U), none, none
    at = np.arange(n)
    which = np.repeat(np.arange(len(counts)), counts)
    ok = which[:n] == which[least - 1 :]
    at = at[ok]
    return spans_hash(prefix(mixed(hashes)), at, at + least), at, which[at]


class Seeds:
    """A block of the benchmark, by the hashes of its grams."""

    def __init__(self, rows: list[tuple], least: int) -> None:
        self.ids, self.least = [r[0] for r in rows], least
        hashes, counts = word_hashes([normalised(r[1]) for r in rows])
        starts = np.concatenate([[0], np.cumsum(counts)])
        self.items = [hashes[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        gram, _, item = _grams(hashes, counts, least)
        self.gram, number = np.unique(gram, return_inverse=True)
        cuts = np.searchsorted(item, np.arange(len(rows) + 1))
        self.grams = [number[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # by place in the item
        held = np.unique(number.astype(np.int64) << 32 | item)
        self.item, self.cuts = held & 0xFFFFFFFF, np.searchsorted(held >> 32, np.arange(len(self.gram) + 1))
        self.some = np.zeros(1 << 20, bool)
        self.some[self.gram >> U(44)] = True
        self.short: dict[bytes, list[int]] = defaultdict(list)
        for k, words in enumerate(self.items):
            if 0 < len(words) < least:
                self.short[words.tobytes()].append(k)

    def candidates(self, number: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The pairs (text << 32 | item) that share a gram; a gram counts once a text."""
        seen = np.unique(which << 32 | number)
        text, number = seen >> 32, seen & 0xFFFFFFFF
        many = self.cuts[number + 1] - self.cuts[number]
        at = np.repeat(self.cuts[number] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.unique(np.repeat(text, many) << 32 | self.item[at])

    def matches(self, raws: list[bytes], cover: float) -> Iterator[tuple]:
        """(text, item, coverage, covered words, item words, tiles)."""
        hashes, counts = word_hashes(raws)
        starts = np.concatenate([[0], np.cumsum(counts)])
        if self.short:
            for k in np.flatnonzero((counts > 0) & (counts < self.least)).tolist():
                for item in self.short.get(hashes[starts[k] : starts[k + 1]].tobytes(), ()):
                    yield k, item, 1.0, int(counts[k]), int(counts[k]), 1
        if not len(self.gram):
            return
        gram, at, which = _grams(hashes, counts, self.least)
        hit = self.some[gram >> U(44)]
        gram, at, which = gram[hit], at[hit], which[hit]
        number = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        hit = self.gram[number] == gram
        number, at, which = number[hit], at[hit], which[hit]
        cuts = np.searchsorted(which, np.arange(len(raws) + 1))
        span = np.arange(self.least)
        for pair in self.candidates(number, which).tolist():
            text, item = pair >> 32, pair & 0xFFFFFFFF
            own = slice(cuts[text], cuts[text + 1])
            shared = np.isin(number[own], self.grams[item])
            inside = np.flatnonzero(np.isin(self.grams[item], number[own][shared]))
            words = self.items[item]
            if len(np.unique(inside[:, None] + span)) < cover * len(words):
                continue  # tiles lie where the seeds do
            place = np.unique(at[own][shared][:, None] + span)  # only here can matches of ``least`` words lie
            names, pattern = np.unique(words, return_inverse=True)
            stretch = np.searchsorted(names, hashes[place])
            stretch = np.insert(stretch, np.flatnonzero(np.diff(place) > 1) + 1, -1)
            tiles = tile(pattern, stretch, self.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= cover * len(words):
                yield text, item, covered / len(words), covered, len(words), len(tiles)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of about ``block_bytes``, one at a time on the driver."""
    rows = benchmark.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__raw")).filter(F.col("__raw").isNotNull())
    total = rows.agg(F.sum(F.octet_length("__raw") + 64)).first()[0] or 0
    count = -(-int(total) // block_bytes)
    for k in range(count):
        part = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("__id", "__raw"), F.lit(count)) == k)
        yield [tuple(r) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, cover: float = COVER, block_bytes: int = BLOCK) -> DataFrame:
    """A row for each document and item: id, item, coverage, covered_words, item_words, tiles."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull())
    id_type, item_type = dict(narrow.dtypes)["__id"], dict(benchmark.dtypes)[item_col]
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, coverage double, covered_words int, item_words int, tiles int"
    out = spark.createDataFrame([], schema)
    for rows in blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(sent.value, least)
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32())
            for batch in slices(batches, "__text", 2 << 20):
                found = list(seeds.matches([normalised(x) for x in as_bytes(batch, "__text")], cover))
                if found:
                    text, item, *rest = zip(*found, strict=True)
                    items = pa.array([seeds.ids[i] for i in item])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), items, *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]], names=[id_col, item_col, "coverage", "covered_words", "item_words", "tiles"])

        out = out.unionByName(narrow.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text no item covers.  Rows with a null id stay.

    Texts are judged, not ids: where an id repeats with different texts, only those that hold an item go.  Repeated rows
    all stay or all go.
    """
    plain, at = renamed(docs)
    text = F.sha2(F.col(at[text_col]).cast("binary"), 256)
    known = plain.filter(F.col(at[id_col]).isNotNull()).select(text.alias("__hash"), F.col(at[text_col]).alias("__words"))
    gone = contaminated(known, benchmark, "__hash", "__words", **options).select(F.col("__hash").alias("__gone")).distinct()
    return plain.join(gone, F.col(at[id_col]).isNotNull() & (text == F.col("__gone")), "left_anti").toDF(*docs.columns)
