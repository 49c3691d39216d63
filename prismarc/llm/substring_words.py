"""Exact substring deduplication over words, behind a count-min sketch.

First pass: the windows of all documents are counted in a count-min sketch, by
their anchors (see ``repeats``): equal windows have equal anchors, so an
anchor's count is never below the count of a window that it anchors, and one
update serves all windows of a run.  Each partition fills a dense sketch of
``DEPTH`` rows of ``2**WIDTH`` cells that stop at two; the partitions' sketches
are merged slice by slice, and of the merged one a bit a cell (estimated twice
or more) goes to every task: 8 MB, whatever the corpus.  An estimate is the
least of an anchor's cells, never below the true count.  Second pass: only runs
of windows that are estimated to occur twice are kept, and windows are grouped
exactly, by 128 bits of hash, first run by run and then window by window.  A
full sketch prunes less, and nothing is ever lost.

A word is removed if a window of ``size`` words that covers it also starts in a
document with a smaller id.  Null texts have no words; texts shorter than a
window lose none; repeated rows (one id) don't remove each other; rows with a
null id are neither cut nor held against others; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, drop
from .repeats import SLICES, Test, U, Windows, anchors, bit_test, classes, keyed, later_windows, mixed, open_texts, run_table, span_lists, window_rows, with_spans

GRAM, DEPTH, WIDTH = 12, 2, 25


def cell(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return (mixed(h ^ U(0xA0761D6478BD642F * (row + 1) % (1 << 64))) >> U(64 - width)).astype(np.int64) + (row << width)


def add(sketch: np.ndarray, h: np.ndarray, depth: int, width: int) -> None:
    """Counts hashes in a sketch of cells that stop at two."""
    for row in range(depth):
        at, often = np.unique(cell(h, row, width), return_counts=True)
        sketch[at] = np.minimum(sketch[at] + np.minimum(often, 2), 2)


def merged_sketch(docs: DataFrame, windows: Windows, depth: int, width: int) -> bytes:
    """A bit for each cell of the merged sketch: counted twice or more.  ``width`` is 8 at least."""
    cells = (depth << width) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(depth << width, np.uint8)
        for h in anchors(batches, windows):
            add(sketch, h, depth, width)
        for k in range(SLICES):
            part = sketch[k * cells : (k + 1) * cells]
            at = np.flatnonzero(part)
            if 16 * len(at) < cells:  # few: their places and counts; many: two bits a cell
                places, counts = at.astype(np.int32).tobytes(), part[at].tobytes()
            else:
                places, counts = b"", np.packbits(part > 0).tobytes() + np.packbits(part > 1).tobytes()
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([places]), pa.array([counts])], names=["__slice", "__at", "__n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                own = held.setdefault(k, np.zeros(cells, np.uint8))
                if at:
                    own[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.uint8)
                else:
                    own += sum(np.unpackbits(x, count=cells) for x in np.frombuffer(n, np.uint8).reshape(2, -1))
                np.minimum(own, 2, out=own)
        for k, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own > 1).tobytes()])], names=["__slice", "__bits"])

    out = bytearray((depth << width) // 8)
    parts = docs.select("__raw").mapInArrow(count, "__slice int, __at binary, __n binary").repartition(SLICES // 4, "__slice")
    for k, bits in parts.mapInArrow(merge, "__slice int, __bits binary").toLocalIterator():
        out[k * cells // 8 : (k + 1) * cells // 8] = bits
    return bytes(out)


def estimated_twice(docs: DataFrame, windows: Windows, depth: int = DEPTH, width: int = WIDTH) -> Test:
    """A test for anchors that the sketch of ``docs`` counts twice or more."""
    sent = docs.sparkSession.sparkContext.broadcast(merged_sketch(docs, windows, depth, width))

    def test(h: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([bit_test(sent.value, cell(h, row, width)) for row in range(depth)])

    return test


def covered_spans(docs: DataFrame, windows: Windows) -> DataFrame:
    """__id, __k, __spans in words, as a table."""
    comparable = docs.filter(F.col("__id").isNotNull())
    runs = cut(run_table(comparable, windows, estimated_twice(comparable, windows)))
    found = classes(runs, within=False)
    # written out, so that these exchanges are gone before the texts move
    whole = cut(found.covered.selectExpr("__id", "__k", "__a AS __from", f"__a + __n + {windows.size} AS __to"))
    rows = window_rows(open_texts(comparable, found.open), windows)
    late = later_windows(rows, within=False).selectExpr("__id", "__k", "__from", f"__from + {windows.size} AS __to")
    spans = span_lists(whole.unionByName(late))
    drop(runs, whole, *found.tables)
    return spans


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, keep_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    windows = Windows(size, min(GRAM, size), True)
    every = keyed(docs, id_col, text_col)
    joined = with_spans(every, covered_spans(every, windows)).select("__id", "__raw", "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            spans = batch.column(2)
            for i, raw in enumerate(as_bytes(batch, "__raw")):
                words = raw.split()
                total, kept = len(words), words
                if spans[i].is_valid:
                    kept, at = [], 0
                    for s in spans[i].as_py():
                        kept += words[at : s["__from"]]
                        at = s["__to"]
                    kept += words[at:]
                text = b" ".join(kept)
                for column, value in zip(out, (total, total - len(kept), hashlib.sha256(text).hexdigest(), text), strict=True):
                    column.append(value)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(out[3], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = dict(joined.dtypes)["__id"]
    made = joined.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept binary" if keep_text else ""))
    return made.withColumn("kept", F.col("kept").cast("string")) if keep_text else made
