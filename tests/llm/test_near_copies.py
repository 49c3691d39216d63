"""Near copies at similarities around 0.8 against all pairs, whatever the ids."""

import random

import pytest

from prismarc.llm import near_copies


def words(r, k):
    return [f"w{r.randrange(5000)}" for _ in range(k)]


def planted(seed=1):
    r = random.Random(seed)
    rows = []
    for base in range(40):
        text = words(r, r.randint(30, 300))
        rows.append((base * 10, " ".join(text)))
        for k in range(1, 4):  # edits in a stretch, so the similarity is about 1 - 2 * share
            cut = int(len(text) * r.uniform(0.0, 0.14))
            at = r.randrange(len(text) - cut)
            rows.append((base * 10 + k, " ".join(text[:at] + words(r, cut) + text[at + cut :]).upper().replace(" ", "\n", 1)))
    rows += [(500, "a b"), (501, "A  B"), (502, "b a"), (503, ""), (504, None), (505, " "), (None, rows[0][1]), (None, "a b")]
    rows += [(0, "an unrelated text with the id of another"), (1, "one more text with the id of another"), (600, "twice the same"), (600, "twice the same")]
    return rows


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    out = []
    for i, (name, text) in enumerate(rows):
        if name is None or name == min(n for k, (n, _) in enumerate(rows) if root[k] == root[i] and n is not None):
            out.append((name, text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [near_copies.BLOCK, 4000])
def test_keep_one_against_all_pairs(spark, block):
    rows = planted()
    want = brute(rows)
    assert 60 < len(want) < len(rows) - 40  # some pairs on either side of 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_copies.keep_one(docs, block=block).collect()), key=repr) == want


def test_stage_is_the_rule_of_five_words(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(planted(2), "doc_id long, text string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(planted(2))


def test_rings_find_what_bands_do_not(spark):
    """Fingerprints that op7 links, at one band that no two texts share."""
    from prismarc.llm import simhash

    r = random.Random(3)
    rows = []
    for base in range(60):
        text = words(r, 400)
        rows += [(base * 10, " ".join(text)), (base * 10 + 1, " ".join([*text[:200], "x", *text[201:]]))]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    near = {rows[i + 1][0] for i in range(0, len(rows), 2) if (prints[i] ^ prints[i + 1]).bit_count() <= simhash.MOST}
    assert 10 < len(near) < 60
    kept = {x.doc_id for x in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=500).collect()}
    assert {i for i, _ in rows} - kept == near
