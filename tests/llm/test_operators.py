"""The operators against brute force, the library or exact round trips, with nulls, empty and long texts, ties and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prismarc.llm import chat, decontaminate, mixing, mpeg, quality, simhash, substring_words, suffixes, token_counts, warc

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in "abcdefg" for b in ("on", "ti", "ér", "sh")]


def corpus(seed=1, n=40):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    passage = say(120)
    rows = [(i, say(r.randint(0, 150)), "x") for i in range(n)]
    rows += [(100, say(30) + " " + passage + " " + say(30), "x"), (101, passage + "\t" + say(70), "y"), (102, say(10) + "\n" + passage, None), (7_000, rows[3][1], "y")]
    rows += [(200, None, "x"), (201, "", "x"), (202, "aon " * 400, "y"), (203, "   ", None), (None, passage, "x"), (101, passage + "\t" + rows[1][1], "y")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", F.lit(1)).withColumn("__h", F.lit("clash"))


def brute_words(rows):
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t, _ in rows]
    first = {}
    for i, w in split:
        for s in range(len(w) - 49):
            if i is not None:
                k = tuple(w[s : s + 50])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s : s + 50])] < i:
                gone |= set(range(s, s + 50))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows):
    """Texts of one id in the order of their keys, as the operator states it."""
    seen, out = set(), []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) & 0x7FFFFF)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            k = b[s : s + 100]
            if i is not None:
                if k in seen:
                    gone[s : s + 100] = b"\1" * 100
                seen.add(k)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out, key=repr)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_words(spark, seed):
    rows = corpus(seed)
    assert collected(substring_words.dedup_words(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_arrays(spark, seed):
    rows = corpus(seed)
    assert collected(suffixes.dedup_bytes(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows)


def test_two_texts_of_one_id_keep_one_copy(spark):
    r = random.Random(11)
    say = lambda k: "".join(r.choices("abcdefghij klmnop", k=k))
    rows = []
    for i in range(12):
        shared = say(1500)
        rows += [(i, say(300) + shared + say(200), "x"), (i, say(250) + shared + say(350), "y")]
    got = collected(suffixes.dedup_bytes(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_bytes(rows)
    removed = {}
    for i, _, gone, *_ in got:
        removed.setdefault(i, []).append(gone)
    assert all(sorted(x) == [0, max(x)] and max(x) >= 1500 for x in removed.values())
    texts = suffixes.cut_repeats(frame(spark, rows).withColumn("n_chars", F.length("text"))).groupBy("doc_id").agg(F.sum(F.length("text"))).collect()
    assert {i: n for i, n in texts} == {i: 4100 - max(removed[i]) for i in range(12)}


def test_long_text_in_pieces(spark, monkeypatch):
    from prismarc.llm import repeats

    rows = [(i, " ".join(random.Random(i % 3).choices(WORDS, k=3000)), "x") for i in range(4)]
    monkeypatch.setattr(repeats, "PIECE", 1 << 12)
    w = repeats.Windows(100, 32, False, True)
    one, two, counts = w.units([rows[0][1].encode()])
    covered = set()
    for lo, hi, _, ends in repeats.doc_pieces(counts, 100):
        a, b, _, _ = w.runs(one[lo:hi], two[lo:hi], ends)
        for x, y in zip(a, b):
            covered |= set(range(lo + x, lo + y + 1))
    assert covered == set(range(int(counts[0]) - 99))


def test_maximal_repeats():
    texts = [b"xx" + b"a" * 5 + b"bcdefgh", b"yy" + b"a" * 5 + b"bcdefzz"]
    found = list(suffixes.maximal_repeats(texts, np.zeros(2, np.int64), np.array([4, 4]), 8))
    assert [(n, sorted(zip(t.tolist(), o.tolist()))) for n, t, o in found] == [(10, [(0, 2), (1, 2)])]


def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts(spark):
    path, tok = tokenizer()
    r = random.Random(4)
    texts = [None, "", "  ", "Hello<|endoftext|>world it's 12,5 l’été É́ x y\ty", " ".join(r.choices(WORDS, k=4000)), "a" * 9000, ("é́ don't stop" * 700)]
    df = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {x[0]: x for x in token_counts.count_tokens(df, path, chunk_chars=2000, overlap_chars=64).collect()}
    for i, t in enumerate(texts):
        count = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert tuple(got[i])[1:4] == (len((t or "").encode()), count, count > 2048)
    assert got[4].n_chunks > 1


def test_mixing_and_chats_as_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).drop("rate")
    assert collected(got, *sorted(got.columns)) == sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({mixing.ORACLE})").fetchall()), key=repr)
    got = chat.chat_digests(chat.with_probe(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert collected(got, *sorted(got.columns)) == sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({chat.ORACLE})").fetchall()), key=repr)


def test_mixing_edges(spark):
    rows = mixing.mix(frame(spark, corpus())).collect()
    assert len(rows) == len(corpus()) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(frame(spark, corpus()).limit(0)).count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a<b>\\l"), (1, 1, "user", "</turn>"), (1, 2, None, None), (None, 0, "assistant", "é<part>"), (2, None, "assistant", "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "a<b>\\l"), ("user", "</turn>"), ("", "")]
    assert (back[2].loss_text, back[None].loss_text, back[1].loss_text) == ("xyy", "é<part>", "")
    assert back[1].formatted.count("<turn:") == 2


def test_warc(spark):
    big = "payload é " * 70_000
    pages = [(5, "http://a/1", big), (3, None, big), (9, "http://a/2", None), (8, "http://a/3", ""), (None, "http://a/4", big), (4, "http://a/5", "x\r\n\r\ny"), (3, None, big)]
    got = collected(warc.warc_roundtrip(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")
    want = []
    for page, _, html in pages:
        raw = (html or "").encode()
        first = min(p for p, _, h in pages if (h or "") == (html or "") and p is not None)
        again = page is not None and page != first
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None, True))
    assert got == sorted(want, key=repr)


def test_mpeg_roundtrip_and_damage(spark):
    texts = [None, "", "abc", "é" * 5000, "ID3\xff\xfb" * 300]
    got = {r.doc_id: r for r in mpeg.media_digests(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.crc_broken) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), 0)
    media = bytearray(mpeg.encode(bytes(range(256)) * 20))
    whole = mpeg.parse(bytes(media))
    assert whole.table_frames == whole.frames and whole.seek[0] > 0
    assert mpeg.parse(b"junk\xff\xfb junk" + bytes(media)).frames == whole.frames
    media[whole.seek[0] + 8] ^= 1
    assert mpeg.parse(bytes(media)).broken == 1
    assert mpeg.parse(b"").frames == 0


def test_string_tiling(spark):
    item = [f"w{i}" for i in range(20)]
    docs = [(1, "zz " + " ".join(item[10:] + ["q"] + item[:10]).upper(), None), (2, " ".join(item[:8]), None), (3, None, None), (4, "", None), (5, "nothing here", None)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "a b"), (9, None)], "item_id long, text string")
    got = collected(decontaminate.contaminated(frame(spark, docs), bench), "doc_id", "item_id", "covered_words", "tiles")
    assert got == [(1, 7, 20, 2)]
    assert {r.doc_id for r in decontaminate.drop_contaminated(frame(spark, docs), bench).collect()} == {2, 3, 4, 5}
    assert decontaminate.tile([1, 2, 3, 4, 5, 6], [4, 5, 6, 9, 1, 2, 3], 3) in ([(0, 4, 3), (3, 0, 3)], [(3, 0, 3), (0, 4, 3)])


def test_simhash(spark):
    from xxhash import xxh64_intdigest

    rows = corpus(3)[:-2]
    rows += [(300 + i, rows[5][1] + " extra" * i, "x") for i in range(6)]

    def bits(t):
        w = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        h = [xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {r[0]: bits(r[1]) for r in rows}
    least = {i: i for i in prints}
    for _ in prints:
        for i, a in prints.items():
            least[i] = min(least[j] for j, b in prints.items() if (a ^ b).bit_count() <= 4)
    got = collected(simhash.simhash_components(frame(spark, rows)), "doc_id", "fingerprint", "component_id")
    assert got == sorted(((i, f"{p:016x}", least[i]) for i, p in prints.items()), key=repr)


def test_pigeonring_keys_lose_nothing():
    r = random.Random(0)
    base = [r.getrandbits(64) for _ in range(300)]
    near = [b ^ sum(1 << i for i in r.sample(range(64), 4)) for b in base]
    a, b = (simhash.ring_keys(np.array(x, np.uint64)) for x in (base, near))
    assert (a == b).any(axis=1).all()


def test_blocks_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 3)
    rows = spark.createDataFrame([(i,) for i in (0, 1, 3, 7, 15, 31, 63, 127, 255)], "__fp long")
    roots = {tuple(r) for r in simhash.components(simhash.links(rows)).collect()}
    assert roots == {(i, 0) for i in (1, 3, 7, 15, 31, 63, 127, 255)}


def test_quality(spark):
    r = random.Random(9)
    say = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        docs.append((i, say(60) + (" scum moron trash" if bad else ""), "x"))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    docs += [(900, None, None), (901, "", None), (None, say(5), None)]
    kept = {x.doc_id for x in quality.resample(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert not kept & set(range(0, 400, 5)) and {900, 901, None} <= kept and len(kept) >= 315
    assert quality.resample(frame(spark, docs), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == len(docs)


@pytest.mark.parametrize("work", [substring_words.dedup_words, suffixes.dedup_bytes, simhash.simhash_components, mpeg.media_digests, suffixes.cut_repeats, simhash.keep_one])
def test_empty_tables(spark, work):
    assert work(frame(spark, corpus()).limit(0)).count() == 0


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= before, name
