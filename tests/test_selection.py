"""Capped pairs against the walk; candidate sets against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from prismarc.operators import selection


def walk(pairs, cap, most=None):
    best = {}
    for a, b, score in pairs:
        if a is not None and b is not None:
            best[a, b] = min(best.get((a, b), (9e9, 0)), (-score, score))
    used, out = {}, []
    for a, b in sorted(best, key=lambda p: (best[p][0], *p)):
        if all(used.get(x, 0) < cap for x in {a, b}):
            out.append((a, b, best[a, b][1]))
            for x in {a, b}:
                used[x] = used.get(x, 0) + 1
    return out[:most]


@pytest.mark.parametrize("seed,cap,most", [(1, 1, None), (2, 2, None), (3, 6, 40), (4, 3, 7)])
def test_capped_pairs(spark, seed, cap, most):
    r = random.Random(seed)
    # member 0 has a third of all pairs; scores tie; pairs repeat; some are of one member
    pairs = [(r.choice([0, r.randrange(30), r.randrange(30)]), r.randrange(30), r.randrange(12)) for _ in range(250)]
    pairs += [(None, 3, 99), (4, None, 99), (7, 7, 50), pairs[5], (pairs[6][0], pairs[6][1], 11)]
    df = spark.createDataFrame(pairs, "a long, b long, score long").withColumn("l", F.lit(1)).repartition(4)
    got = selection.capped_pairs(df, "a", "b", [-F.col("score")], cap, most)
    assert got.columns == df.columns and sorted((x.a, x.b, x.score) for x in got.collect()) == sorted(walk(pairs, cap, most))


def test_a_long_chain_of_decisions(spark):
    pairs = [(i, i + 1, 100 - i) for i in range(12)]
    df = spark.createDataFrame(pairs, "a long, b long, score long")
    assert sorted((x.a, x.b, x.score) for x in selection.capped_pairs(df, "a", "b", [-F.col("score")], 1).collect()) == sorted(walk(pairs, 1)) == [(i, i + 1, 100 - i) for i in range(0, 12, 2)]
    assert selection.capped_pairs(df.limit(0), "a", "b", [-F.col("score")], 1).collect() == []


def test_candidate_sets(spark):
    families = [("f", x) for x in "abc"] + [("g", x) for x in "cba"] + [("h", "d"), ("h", "gone"), ("k", "d"), ("k", "e"), ("k", None), ("m", "p"), ("m", "q")]
    labels = [("a", "b", 1), ("b", "a", 1), ("b", "c", 0), ("x", "y", 1), ("y", "z", 1), ("x", "z", 0), ("x", "z", 1), ("p", "q", 1), ("d", "gone", 1), ("e", "e", 1), (None, "a", 1), ("d", "e", None)]
    active = [(x,) for x in "abcdexyzpq"]
    sets, members = selection.candidate_sets(spark.createDataFrame(families, "s string, i string"), spark.createDataFrame(labels, "l string, r string, v int"), spark.createDataFrame(active, "i string"), "s", "i", "l", "r", "v")
    held = {}
    for name, member in members.collect():
        held.setdefault(name, set()).add(member)
    got = sorted((r.kind, "".join(sorted(held[r["name"]])), r.size, r.least, r.positives, r.conflicts) for r in sets.collect())
    assert got == [("family", "abc", 3, "a", 1, 1), ("family", "de", 2, "d", 0, 0), ("family", "pq", 2, "p", 1, 0), ("positive", "ab", 2, "a", 1, 0), ("positive", "xyz", 3, "x", 2, 1)]
    assert len(held) == 5
