"""The quality model against one of exact words; the pipeline's rows on planted documents."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prismarc.llm import quality

VOCABULARY = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "rt", "sch", "l", "ko")]


def by_words(docs, labels, noise, temperature):
    """The kept ids by the documented rule, with words in place of hashes."""

    def grams(text):
        w = (text or "").lower().split()
        repeats = sum(w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2))
        return Counter(w) + Counter(k for k in range(16) if repeats >= 1 << k)

    own = {i: grams(t) for i, t in docs}
    grade = {}
    for i, q, toxic in labels:
        if i is not None and q is not None:
            grade[i] = grade.get(i, True) and q == 1 and not toxic
    good = [own[i] for i, g in grade.items() if g and i in own]
    bad = [own[i] for i, g in grade.items() if not g and i in own]
    target, raw = sum(good, Counter()), sum(own.values(), Counter())
    words, total = sum(target.values()), sum(raw.values())
    expected = {b: raw[b] * words / total for b in raw}
    sure = sorted((target[b] / expected[b], expected[b]) for b in target if target[b] >= 50)
    half, held, scale = sum(e for _, e in sure) / 2, 0.0, 1.0
    for ratio, e in sure:
        held += e
        if held >= half:
            scale = max(1.0, ratio)
            break
    weight = {}
    for b in raw:
        in_good, in_bad = sum(b in g for g in good), sum(b in g for g in bad)
        enough = max(2 if isinstance(b, int) else 5, len(bad) / 500)
        e = expected[b] * scale
        if in_bad >= enough and (in_bad + 0.5) / (len(bad) + 1) >= 10 * (in_good + 0.5) / (len(good) + 1) and e > target[b]:
            weight[b] = math.log((target[b] + 1) / (target[b] + e + 2))
    score = {i: sum(n * weight.get(b, 0.0) for b, n in g.items()) for i, g in own.items()}
    lost = lambda t, side: sum(score[i] < t for i, g in grade.items() if g == side and i in score) / max(1, sum(g == side for i, g in grade.items() if i in score))
    best = max(quality.THRESHOLDS, key=lambda t: lost(t, False) - 4 * lost(t, True))
    k = sum(s >= best for s in score.values())
    keys = {i: s / temperature + noise[i] for i, s in score.items()}
    bound = sorted(keys.values(), reverse=True)[k - 1] if k < len(keys) else -math.inf
    return {i for i, key in keys.items() if key >= bound - 1e-9}


@pytest.mark.parametrize("temperature", [0.1, 1.0, 8.0])
def test_quality_by_exact_words(spark, temperature):
    r = random.Random(11)
    docs, labels = [], []
    for i in range(500):
        text = r.choices(VOCABULARY, k=r.randint(20, 90))
        if i % 6 == 0:
            text[r.randrange(len(text))] = r.choice(["Scum", "moron"])
        elif i % 25 == 1:
            text = text[:5] + [r.choice(VOCABULARY)] * r.randint(10, 60)
        docs.append((i, " ".join(text)))
        if i % 5 < 3:
            labels.append((i, int(i % 25 != 1), int(i % 6 == 0)))
    docs += [(1000, None), (1001, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    noise = {x[0]: x[1] for x in frame.select("doc_id", quality.gumbel(F.col("doc_id"), quality.SEED)).collect()}
    got = {x.doc_id for x in quality.resample(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), temperature=temperature).collect()}
    assert got == by_words(docs, labels, noise, temperature)
    assert {1000, 1001} <= got or temperature > 1
    assert temperature > 0.1 or len(set(range(0, 500, 6)) - got) > 75


def test_the_pipeline_on_planted_documents(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    say = lambda k: [r.choice(VOCABULARY) + r.choice(VOCABULARY) for _ in range(k)]
    passage, item = " ".join(say(40)), say(24)
    docs, labels = {}, []
    for i in range(150):
        text = say(r.randint(60, 140))
        if i % 10 == 3:
            text[r.randrange(len(text))] = "scum moron trash"
        elif i in (20, 40, 60):
            text.insert(30, passage)
        elif i == 71:
            text[20:20] = item[12:] + ["and"] + item[:12]  # in another order
        elif i == 91:  # no 100 bytes of it are those of the other, which the passage stage would cut
            text[20:20] = item[18:] + item[6:12] + item[12:18] + item[:6]
        docs[i] = " ".join(text)
        if i % 2 or i % 4 == 0:
            labels.append((i, 1, int(i % 10 == 3)))
    for i in range(0, 30, 2):
        words = docs[i].split()
        words[-1] = "changed"
        docs[1000 + i] = " ".join(words) if i % 4 else docs[i].upper()
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in docs.items()] + [(2000, None, "en", None, None), (2001, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = set(range(3, 150, 10)) | {71, 91} | set(range(1000, 1030, 2)) | {2001}  # null and empty text are copies of each other
    assert got.keys() == (docs.keys() | {2000, 2001}) - gone
    sizes = {i: len((docs.get(i) or "").split()) for i in got}
    for i, x in got.items():
        if i in (40, 60):  # the passage's later copies go, to the byte
            assert 0 <= sizes[i] - 40 - x.size + 2 <= 4
        else:
            assert x.size == sizes[i]
        assert x.taken == x.copies * x.size <= 3 * x.size
    for source in "abc":
        own = [x for i, x in got.items() if i < 2000 and "abc"[i % 3] == source]
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own)
        assert own[0].source_size == sum(x.size for x in own)


def test_mixing_by_hand(spark):
    """Targets, ties and the cap, against a plain computation."""
    import hashlib

    from prismarc.llm import mixing

    rows = [(1, "a " * 10, "x"), (2, "b " * 10, "x"), (2, "b " * 10, "x"), (3, "c " * 200, "y"), (4, None, "y"), (None, "d d", "z"), (6, "e " * 7, None), (7, "", "w"), (8, " \t\n", "w")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("w", "x", "y", "z", None)}
    weights = dict(zip(sizes, (1, 2, 3, 1, 2), strict=True))
    everything, capped = sum(sizes.values()), set()
    while True:
        left = everything - sum(3 * sizes[s] for s in capped)
        level = left / max(1, sum(w for s, w in weights.items() if s not in capped))
        more = {s for s in sizes if s not in capped and weights[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * sizes[s] if s in capped else weights[s] * level for s in sizes}
    assert len(got) == len(rows)
    for x in got:
        source = next(s for i, t, s in rows if i == x.doc_id and len((t or "").split()) == x.size)
        assert x.source_size == sizes[source] and abs(x.target - target[source]) < 1e-6 * everything and 0 <= x.taken <= 3 * x.size
    for s in sizes:
        mine = [x for x in got if x.doc_id in [i for i, _, y in rows if y == s]]
        assert abs(sum(x.taken for x in mine) - target[s]) <= max(x.size for x in mine)
    assert hashlib.md5(repr(sorted(map(tuple, got), key=repr)).encode()).digest() == hashlib.md5(repr(sorted(map(tuple, mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()), key=repr)).encode()).digest()
