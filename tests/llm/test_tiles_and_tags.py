"""Greedy tilings against the definition, on repetitive and long texts; payloads that look like tags."""

import random
import time
import zlib

import numpy as np
import pytest
from test_operators import collected, frame

from prismarc.llm import decontaminate, mpeg


def by_definition(p, t, least):
    used_p, used_t, tiles = [False] * len(p), [x < 0 for x in t], []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not used_p[i + n] and not used_t[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = n, i, j
        if not best:
            return tiles
        n, i, j = best
        tiles.append((i, j, n))
        used_p[i : i + n] = used_t[j : j + n] = [True] * n


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_tiles_by_definition(letters):
    r = random.Random(letters)
    for _ in range(60):
        p = [r.randrange(letters) for _ in range(r.randint(0, 24))]
        t = [r.choice([*range(letters), *([-1] if r.random() < 0.2 else [])]) for _ in range(r.randint(0, 40))]
        if r.random() < 0.5 and len(p) > 8:
            t = t[:5] + p[6:] + t[5:9] + p[:6]
        assert decontaminate.tile(p, t, 3) == by_definition(p, t, 3)


def test_repetitive_texts_take_no_product_of_places():
    began = time.time()
    assert decontaminate.tile([0] * 300, [0] * 100_000) == [(0, 0, 300)]
    assert sum(n for _, _, n in decontaminate.tile([0, 1] * 150 + [2], ([0, 1] * 4 + [3]) * 5_000)) == 296
    seeds = decontaminate.Seeds([(1, b"spam " * 300), (2, b"spam " * 60), (3, b"spam ham " * 40)], 5)
    found = {m[1]: m[2:5] for m in seeds.matches([b"spam " * 100_000], 0.5)}
    assert found == {0: (1.0, 300, 300), 1: (1.0, 60, 60)}
    assert time.time() - began < 20


def brute(docs, items, least=5, cover=0.5):
    cut = lambda t: decontaminate.normalised((t or "").encode()).split()
    out = []
    for name, text, _ in docs:
        for item, said in items:
            p, t = cut(said), cut(text)
            if text is None or said is None or not p:
                continue
            if len(p) < least:
                if p == t:
                    out.append((name, item, len(p), 1))
                continue
            number = {w: k for k, w in enumerate(dict.fromkeys(p + t))}
            tiles = by_definition([number[w] for w in p], [number[w] for w in t], least)
            if sum(n for _, _, n in tiles) >= cover * len(p):
                out.append((name, item, sum(n for _, _, n in tiles), len(tiles)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_pairs_by_brute_force(spark, block):
    r = random.Random(7)
    say = lambda k: [f"w{r.randrange(40)}" for _ in range(k)]
    items = [(k, " ".join(say(r.randint(6, 30)))) for k in range(12)] + [(20, "a b"), (21, None), (22, ""), (23, "to be or not to be " * 4), (24, "?!")]
    docs = []
    for i in range(40):
        own = items[i % 12][1].split()
        at = r.randrange(len(own))
        docs.append((i, " ".join(say(20) + own[at:] + say(r.randint(0, 9)) + own[: r.randint(0, at)] + say(9)), "x"))
    docs += [(90, "A, b!", "x"), (91, "a b c", "x"), (92, None, "x"), (93, "", None), (94, "to be or not to be " * 60, "x"), (95, docs[3][1], "x"), (95, docs[3][1], "x"), (None, docs[4][1], "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collected(decontaminate.contaminated(frame(spark, docs), bench, block_bytes=block), "doc_id", "item_id", "covered_words", "tiles")
    want = brute(docs, items)
    assert got == want and len({w[0] for w in want}) > 20


@pytest.mark.parametrize("size", [64, 100, 128, 640, 960, 1900])
def test_a_payload_may_hold_the_tag_mark(size):
    payload = bytearray(b"x" * size)
    whole = mpeg.encode(bytes(payload))
    for at in range(size - 2):
        text = bytes(payload[:at]) + b"TAG" + bytes(payload[at + 3 :])
        back = mpeg.parse(mpeg.encode(text))
        assert back.payload == text and back.whole and not back.skipped and "id3v1" not in back.tags, at
    tagged = mpeg.parse(whole + b"TAG" + b"A title".ljust(125, b"\0"))
    assert tagged.payload == payload and tagged.tags["id3v1"] == "A title" and tagged.whole and not tagged.skipped
    last = mpeg.parse(whole).seek[0] if size < 900 else whole.rindex(b"\xff\xfa")
    hurt = mpeg.parse(whole[:last] + b"\0" + whole[last + 1 :] + b"TAG" + b"A title".ljust(125, b"\0"))
    assert hurt.tags["id3v1"] == "A title" and (not hurt.whole or hurt.table == "none")


def test_media_digests_by_hand(spark):
    import hashlib

    texts = [None, "", "TAG" * 50, "y" * 17 + "TAG" + "z" * 80, "é" * 900]
    for r in mpeg.media_digests(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = mpeg.encode(padded)
        s = mpeg.parse(media)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), mpeg.feature(s))
        assert s.samples == 1152 * s.frames and float(s.duration) == s.samples / 48_000 == r.seconds and f"frames={s.frames};" in r.feature
        assert np.all([mpeg.header(media[x : x + 4]) for x in r.seek_offsets])
