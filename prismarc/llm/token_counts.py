"""Token counts with overlap resynchronisation.

A text of up to ``chunk_chars`` characters is encoded as a whole.  A longer one
is cut into chunks that overlap; each chunk is encoded with offsets and two
neighbours are spliced at a boundary that both encodings have, behind white
space, with ``stable`` equal tokens (id and place) on either side.  White space
is a hard boundary of the tokenizer (its pre-tokenizer drops it, merges never
cross it), so what stands left of such a boundary can't change what stands
right of it.  If no such boundary lies in the overlap, the overlap is doubled,
at last up to the whole text.

Whole texts are counted word by word through a table of words already encoded;
the splits are at spaces and line feeds only, which are such boundaries too.

Null and empty texts count 0 bytes and 0 tokens.  Repeated rows are counted one
by one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

#: Entries of the word table; it starts anew beyond that.  It only saves time.
WORD_TABLE = 400_000
Encode = Callable[[str], tuple[list[int], list[tuple[int, int]]]]


class WordTable:
    """Token counts by word, for words that stand between spaces or line feeds."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.known = tokenizer, {"": 0}

    def count(self, text: str) -> int:
        words = text.replace("\n", " ").split(" ")
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > WORD_TABLE:
            self.known = {"": 0}
            new = list(dict.fromkeys(words))
        encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.known.update((w, len(e)) for w, e in zip(new, encoded, strict=True))
        self.known[""] = 0
        return sum(map(self.known.__getitem__, words))


def splice_point(text: str, left: tuple, right: tuple, least: int, stable: int) -> tuple[int, int, int] | None:
    """(place, tokens of left before it, tokens of right before it) or None.

    ``left`` and ``right`` are (ids, absolute spans) of overlapping chunks.
    """
    index = {span: i for i, span in enumerate(left[1])}
    run = 0
    best = None
    before = None
    for j, span in enumerate(right[1]):
        i = index.get(span)
        run = run + 1 if i is not None and left[0][i] == right[0][j] and (run == 0 or i == before + 1) else int(
            i is not None and left[0][i] == right[0][j]
        )
        before = i
        if run >= 2 * stable:
            k = j - stable + 1
            place = right[1][k][0]
            if place > least and text[place - 1] in " \n" and right[1][k - 1][1] < place:
                best = (place, index[right[1][k]], k)
                break
    return best


def spliced_count(text: str, encode: Encode, chunk: int, overlap: int, stable: int) -> tuple[int, int, int]:
    """(tokens, chunks encoded, times an overlap was widened) of a huge text.

    Where no boundary can be proven the stretch held grows by four each time, so
    a text without any is encoded a bounded number of times in all.
    """

    def at(a: int, b: int) -> tuple[list[int], list[tuple[int, int]]]:
        ids, spans = encode(text[a:b])
        return ids, [(s + a, e + a) for s, e in spans]

    total, chunks, widened, n = 0, 1, 0, len(text)
    begin, skip, end = 0, 0, min(chunk, n)  # skip: tokens of the held chunk that are counted already
    step = chunk
    held = at(begin, end)
    least = 0
    while end < n:
        wide = overlap
        while True:
            start = max(end - wide, least)
            stop = min(n, end + step)
            following = at(start, stop)
            chunks += 1
            found = splice_point(text, held, following, least, stable)
            if found:
                place, i, j = found
                total += i - skip
                held, skip, least, begin, end = following, j, place, start, stop
                step = chunk
                break
            widened += 1
            if start == least:  # the overlap reaches the last proven boundary: this chunk alone replaces the held one
                if skip and begin != least:
                    held = at(least, end)
                held, skip, begin, end = following, 0, start, stop
                step *= 4
                break
            wide *= 8
    return total + len(held[0]) - skip, chunks, widened


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    chunk_chars: int = 65_536,
    overlap_chars: int = 1_024,
    stable: int = 4,
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        words = WordTable(tokenizer)

        def encode(text: str):
            e = tokenizer.encode(text, add_special_tokens=False)
            return e.ids, e.offsets

        for batch in batches:
            sizes, counts, parts = [], [], []
            for raw in as_bytes(batch, "__text"):
                raw = raw or b""
                text = raw.decode("utf-8", "replace")
                if len(text) > chunk_chars:
                    n, chunks, _ = spliced_count(text, encode, chunk_chars, overlap_chars, stable)
                else:
                    n, chunks = words.count(text), 1
                sizes.append(len(raw))
                counts.append(n)
                parts.append(chunks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(parts, pa.int32())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_chunks"],
            )

    narrow = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks int")
