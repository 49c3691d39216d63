"""Frequent anchors, classes and windows, long words that polynomials confuse, and full sketches, against brute force."""

import random

import numpy as np
import pytest
from test_operators import WORDS, brute_bytes, brute_words, collected, frame

from prismarc.llm import repeats, substring_words, suffixes


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_long_words_differ(spark):
    one, two = ("".join("ab"[b ^ flip] for b in thue_morse(1024)) for flip in (0, 1))
    h = repeats.word_hashes([f"{one} {two}".encode()], (42, 4242))
    assert h[0][0] != h[0][1] and h[1][0] != h[1][1]
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:25] + [one] + w[25:]), "x"), (2, " ".join(w[:25] + [two] + w[25:]), "x")]
    assert [r.n_removed for r in substring_words.dedup_words(frame(spark, rows)).orderBy("doc_id").collect()] == [0, 0] == [r[2] for r in brute_words(rows)]


def test_word_hashes_are_those_of_the_words():
    r = random.Random(3)
    words = [bytes(r.choices(b"abc\xc3\xa9.", k=r.choice((1, 3, 7, 8, 9, 16, 17, 40, 255, 256, 257, 700)))) for _ in range(400)]
    raws = [b" ".join(words[:150]), b"", b"\n\t ", b"\x0b".join(words[150:])]
    h, counts = repeats.word_hashes(raws)
    assert counts.tolist() == [150, 0, 0, 250]
    for x, y in zip(words, h, strict=True):
        assert y == repeats.word_hashes([b" " + x])[0][0]
    assert len(set(words)) == len(set(h.tolist()))


def frequent(seed):
    """A line in most documents, between ever other words; a passage in a third of them; copies."""
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(k))
    line, passage, copy = say(14), say(70), say(160)
    rows = []
    for i in range(60):
        rows.append((i, " ".join([say(r.randint(20, 60)), line, say(r.randint(20, 60)), passage if i % 3 == 0 else "", line if i % 7 == 0 else "", say(5)]), "x"))
    rows += [(1000 + i, copy, "x") for i in range(40)] + [(5, copy + " " + copy, "y"), (None, copy, "x"), (70, passage + " " + passage, "x"), (71, line + " " + line, "x")]
    return rows


@pytest.mark.parametrize("hot,hottest", [(2, 65_536), (2, 3), (10**9, 65_536)])
def test_frequent_anchors(spark, monkeypatch, hot, hottest):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "HOTTEST", hottest)
    rows = frequent(hottest)
    assert collected(substring_words.dedup_words(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows)
    assert collected(suffixes.dedup_bytes(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_words, "estimated_twice", lambda docs, windows, given=substring_words.estimated_twice: given(docs, windows, 2, 8))
    rows = frequent(9)
    assert collected(substring_words.dedup_words(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows)


def test_sketch_never_counts_too_little(spark):
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    sketch = np.zeros(2 << 10, np.uint8)
    for part in np.array_split(np.concatenate([h, h[:700]]), 7):
        substring_words.add(sketch, part, 2, 10)
    at = [substring_words.cell(h[:700], row, 10) for row in range(2)]
    assert (np.minimum(sketch[at[0]], sketch[at[1]]) == 2).all()


def test_passages_are_cut_as_by_brute_force(spark):
    rows = frequent(4) + [(300, None, "x"), (301, "", "x"), (302, "é" * 260, "x"), (303, "é" * 260, "x"), (304, "x" + "é" * 120, "x")]
    docs = frame(spark, rows).withColumn("n_chars", __import__("pyspark").sql.functions.char_length("text").cast("long"))
    seen, want = set(), []
    for i, t, s in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if i is not None:
                if raw[k : k + 100] in seen:
                    gone[k : k + 100] = b"\1" * 100
                seen.add(raw[k : k + 100])
        if any(gone):
            starts = [0]
            for c in t:
                starts.append(starts[-1] + len(c.encode()))
            left = "".join(c for c, a, b in zip(t, starts, starts[1:]) if not all(gone[a:b]))
            if left:
                want.append((i, left, len(left)))
        else:
            want.append((i, t, None if t is None else len(t)))
    assert collected(suffixes.cut_repeats(docs), "doc_id", "text", "n_chars") == sorted(want, key=repr)
