"""Suffix-array deduplication over bytes: common-prefix interval trees.

The corpus' repeats are found by an enhanced suffix array that is distributed by
anchor (see ``repeats``): all places where a string of ``size`` bytes occurs lie
in the open runs of one anchor.  For the runs of an anchor the suffixes at the
windows' starts are sorted, the lengths of common prefixes of neighbours taken,
and a scan with a stack builds the tree of prefix intervals.  An interval of at
least ``size`` bytes whose members aren't all preceded by the same byte is a
maximal repeat; it is output with all its occurrences.  Whatever isn't the
first occurrence of its repeat is covered.

Earlier means: a smaller id, or the same document and an earlier start.  Null
texts are empty; texts shorter than ``size`` lose nothing.  Two rows with one id
and the same text are one document, with different texts they are ordered by a
hash of the text.  Rows with a null id are neither cut nor held against others.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, drop, renamed
from .repeats import U, Windows, among, anchor_table, classes, keyed, later_windows, open_texts, run_table, span_lists, text_key, window_rows, with_spans

GRAM, SUFFIXES = 32, 200_000


def suffix_array(texts: list[bytes], group: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(text, offset, common prefix with the one before) of the suffixes of ``texts`` that begin at offsets 0 to ``starts``, in order.

    Suffixes of different groups have no common prefix.
    """
    lengths = np.array([len(x) for x in texts], np.int64)
    words = -(-int(lengths.max()) // 8)
    stride = 8 * words + 8
    buf = np.frombuffer(b"".join(x.ljust(2 * stride, b"\0") for x in texts), np.uint8)
    text = np.repeat(np.arange(len(texts)), starts + 1)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(starts + 1) - (starts + 1), starts + 1)
    place = text * 2 * stride + offset
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
    keys = [eight[place + 8 * w].copy().view(">u8").ravel().astype(U) for w in range(words)]
    rest = lengths[text] - offset
    order = np.lexsort((rest, *reversed(keys), group[text]))
    text, offset, rest = text[order], offset[order], rest[order]
    table = np.stack([k[order] for k in keys])
    differ = table[:, 1:] != table[:, :-1]
    first = differ.argmax(axis=0)
    pick = np.arange(len(order) - 1)
    x = table[first, pick + 1] ^ table[first, pick]
    equal = np.zeros(len(x), np.int64)
    for k in range(8):
        equal += (x >> U(56 - 8 * k)) == 0
    common = np.where(differ.any(axis=0), first * 8 + equal, 8 * words)
    common = np.minimum(common, np.minimum(rest[1:], rest[:-1]))
    common[group[text[1:]] != group[text[:-1]]] = 0
    return text, offset, np.concatenate([[0], common])


def maximal_repeats(texts: list[bytes], group: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, texts, offsets) of each maximal repeat of at least ``size`` bytes."""
    text, offset, common = suffix_array(texts, group, starts, size)
    before = np.array([texts[t][o - 1] if o else -1 for t, o in zip(text, offset, strict=True)], np.int64)
    enough = common >= size
    edges = np.flatnonzero(np.diff(np.concatenate([[False], enough, [False]]).astype(np.int8)))
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):  # common[lo:hi] reach size: suffixes lo-1 to hi-1
        values = common[lo:hi].tolist()
        stack: list[tuple[int, int]] = []
        for i, value in enumerate([*values, 0]):
            left = lo - 1 + i
            while stack and stack[-1][0] > value:
                length, left = stack.pop()
                span = slice(left, lo + i)
                lefts = before[span]
                if lefts[0] < 0 or (lefts != lefts[0]).any():
                    yield length, text[span], offset[span]
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, left))


def repeat_rows(contexts: DataFrame, size: int) -> DataFrame:
    """__group, __length, __id, __k, __from, __first of every occurrence of every maximal repeat.  contexts: __h, __id, __k, __a, __n, __bytes."""
    id_type = dict(contexts.dtypes)["__id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []

        def found() -> Iterator[pa.RecordBatch]:
            nonlocal number
            h, ids, k, a, n, texts = zip(*held, strict=True)
            k, a = np.array(k, np.int64), np.array(a, np.int64)
            _, group = np.unique(np.array(h, np.int64), return_inverse=True)
            rows: list[list] = [[], [], [], [], [], []]
            for length, text, offset in maximal_repeats(list(texts), group, np.array(n, np.int64), size):
                places = [(ids[t], int(k[t]), int(a[t] + o)) for t, o in zip(text, offset, strict=True)]
                least = min(places)
                for p in places:
                    for column, value in zip(rows, (task + number, length, *p, p == least), strict=True):
                        column.append(value)
                number += 1
                if len(rows[0]) > 50_000:
                    yield batch_of(rows)
                    rows = [[], [], [], [], [], []]
            if rows[0]:
                yield batch_of(rows)

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), id_kind, pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["__group", "__length", "__id", "__k", "__from", "__first"])

        weight = 0
        for batch in batches:
            id_kind = batch.schema.field("__id").type
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__h", "__id", "__k", "__a", "__n")]
            for row in zip(*columns, as_bytes(batch, "__bytes"), strict=True):
                if held and weight > SUFFIXES and row[0] != held[-1][0]:
                    yield from found()
                    held, weight = [], 0
                held.append(row)
                weight += row[4] + 1
        if held:
            yield from found()

    ordered = contexts.select("__h", "__id", "__k", "__a", "__n", "__bytes").repartition("__h").sortWithinPartitions("__h")
    return ordered.mapInArrow(run, f"__group long, __length long, __id {id_type}, __k long, __from long, __first boolean")


def run_bytes(texts: DataFrame, size: int) -> DataFrame:
    """A row for each open run, with its bytes."""
    one = texts.select("__id", "__k", "__raw", F.explode("__runs").alias("__r")).select("__r.__h", "__id", "__k", "__r.__a", "__r.__n", "__raw")
    return one.select("__h", "__id", "__k", "__a", "__n", F.substring("__raw", (F.col("__a") + 1).cast("int"), (F.col("__n") + size).cast("int")).alias("__bytes"))


def repeated_anchors(anchors: DataFrame) -> DataFrame:
    """The anchors (__h) that occur twice or more."""
    return cut(anchors.groupBy("__h").agg(F.count("*").alias("__n")).filter("__n > 1").select("__h"))


def of_runs(texts: DataFrame, hot: bool) -> DataFrame:
    """``texts`` with those of their runs whose anchors are hot, or aren't."""
    fit = F.filter("__runs", lambda r: r["__hot"] if hot else ~r["__hot"])
    return texts.withColumn("__runs", fit).filter(F.size("__runs") > 0)


def covered_spans(docs: DataFrame, windows: Windows) -> DataFrame:
    """__id, __k, __spans in bytes, as a table.

    The suffixes of a hot anchor's runs are dealt by their first ``size`` bytes, and of such a prefix interval the least
    occurrence is found by an aggregate: no task holds them all.
    """
    comparable = docs.filter(F.col("__id").isNotNull())
    twice = repeated_anchors(anchor_table(comparable, windows))
    runs = cut(run_table(comparable, windows, among(twice)).join(twice, "__h", "left_semi"))
    drop(twice)
    found = classes(runs, within=True)
    # written out, so that the runs' exchanges are gone before the texts move
    whole = cut(found.covered.selectExpr("__id", "__k", "__a AS __from", f"__a + __n + {windows.size} AS __to"))
    drop(runs)
    texts = open_texts(comparable, found.open)
    repeats = repeat_rows(run_bytes(of_runs(texts, False), windows.size), windows.size)
    late = repeats.filter(~F.col("__first")).selectExpr("__id", "__k", "__from", "__from + __length AS __to")
    frequent = later_windows(window_rows(of_runs(texts, True), windows), within=True).selectExpr("__id", "__k", "__from", f"__from + {windows.size} AS __to")
    spans = span_lists(whole.unionByName(late).unionByName(frequent))
    drop(whole, *found.tables)
    return spans


def apart(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """``raw`` without the spans (disjoint and in order), and their number."""
    parts, at = [], 0
    for s in spans or ():
        parts.append(raw[at : s["__from"]])
        at = s["__to"]
    parts.append(raw[at:])
    return b"".join(parts), len(spans or ())


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, keep_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes and removed spans."""
    every = keyed(docs, id_col, text_col)
    joined = with_spans(every, covered_spans(every, Windows(size, min(GRAM, size), False, True))).select("__id", "__raw", "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            spans = batch.column(2)
            for i, raw in enumerate(as_bytes(batch, "__raw")):
                kept, gone = apart(raw, spans[i].as_py())
                for column, value in zip(out, (len(raw), len(raw) - len(kept), gone, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(out[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = dict(joined.dtypes)["__id"]
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))


def whole_characters(raw: bytes, spans: list[dict]) -> list[dict]:
    """Spans shrunk to whole UTF-8 characters."""
    out = []
    for s in spans:
        a, b = s["__from"], s["__to"]
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append({"__from": a, "__to": b})
    return out


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without the repeats in its texts; rows that lose a whole text go, empty and null texts stay.

    Spans shrink to whole characters, so the texts stay valid UTF-8.  ``chars_col``, if there is such a column, is counted
    anew where a text changes.  The text moves once, with the other columns, to its spans.
    """
    own_names = docs.columns
    docs, at_place = renamed(docs)
    id_col, text_col, chars_col = (at_place.get(c, c) for c in (id_col, text_col, chars_col))
    spans = covered_spans(keyed(docs, id_col, text_col), Windows(size, min(GRAM, size), False, True))
    raw = F.col(text_col).cast("binary")
    every = docs.withColumns({"__id": F.col(id_col), "__k": text_key(F.coalesce(raw, F.lit(b"")))})
    joined = with_spans(every, spans).drop("__id", "__k").withColumn(text_col, raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            spans = column.pop("__spans")
            texts, changed = as_bytes(batch, text_col), spans.is_valid()
            for i in np.flatnonzero(changed.to_numpy(zero_copy_only=False)).tolist():
                texts[i], _ = apart(texts[i], whole_characters(texts[i], spans[i].as_py()))
            column |= {text_col: pa.array(texts, pa.binary()), "__cut": changed}
            yield pa.RecordBatch.from_arrays(list(column.values()), names=list(column))

    made = joined.drop("__spans").withColumn("__cut", F.lit(True)).schema
    cleaned = joined.mapInArrow(run, made).filter(~F.col("__cut") | (F.octet_length(text_col) > 0)).withColumn(text_col, F.col(text_col).cast(docs.schema[text_col].dataType))
    if chars_col in docs.columns:
        cleaned = cleaned.withColumn(chars_col, F.when(F.col("__cut"), F.char_length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return cleaned.select(*docs.columns).toDF(*own_names)
