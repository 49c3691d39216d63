"""Graph, ranking and diversity operators against brute force."""

import random

import numpy as np
import pytest

from prismarc.operators import graph, ranking
from prismarc.plans import links


def test_aliases_with_cycles(spark):
    rows = [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (10, 11), (11, 12), (12, 10), (13, 10), (20, 20)]
    got = {r.node: (r.root, r.hops, r.cyclic) for r in graph.resolve_aliases(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {i: (0, i, False) for i in range(1, 6)} | {i: (None, None, True) for i in (10, 11, 12, 13, 20)}
    assert graph.resolve_aliases(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_greedy_keeping(spark, seed):
    pick = random.Random(seed)
    rows = [(i, pick.choice([None, "a", "b", "c", "d"]), pick.randrange(12)) for i in range(60)]
    want, active = {}, []
    for i, a, b in rows:
        want[i] = not any((a is not None and a == x) or b == y for x, y in active)
        if want[i]:
            active.append((a, b))
    got = graph.keep_unmatched(spark.createDataFrame(rows, "id long, a string, b int"), "id", ["a", "b"]).collect()
    assert len(got) == 60 and {r.id: r.kept for r in got} == want


def test_greedy_keeping_does_not_chain(spark):
    rows = [(1, "x", "p"), (2, "x", "q"), (3, "z", "q"), (4, None, None)]
    got = graph.keep_unmatched(spark.createDataFrame(rows, "id long, a string, b string"), "id", ["a", "b"]).collect()
    assert {r.id: r.kept for r in got} == {1: True, 2: False, 3: True, 4: True}


def test_absorption(spark):
    sets = {i: {random.Random(i).randrange(7) for _ in range(1 + i % 5)} for i in range(40)}
    want = {}
    for i, s in sets.items():
        over = [(-len(z), min(k for k in sets if sets[k] == z)) for z in sets.values() if s < z]
        first = min(k for k in sets if sets[k] == s)
        if over or first != i:
            want[i] = min(over)[1] if over else first
    rows = [(i, x) for i, s in sets.items() for x in s] + [(None, 1), (99, None)]
    got = graph.absorb_sets(spark.createDataFrame(rows, "g long, x long"), "g", "x").collect()
    assert {r.g: r.by for r in got} == want


def test_absorption_moves_rows_in_proportion_to_the_items(spark, request):
    """Sets that meet over an item but can't hold each other are told without counting their items."""
    pick = random.Random(5)
    sets = {f"s{i:04}": frozenset(f"x{x}" for x in pick.sample(range(50), 1 + i % 7)) for i in range(3000)}
    rows = [(i, x) for i, s in sets.items() for x in s]
    df = spark.createDataFrame(rows, "g string, x string")
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held))
    got = {r.g: r.by for r in graph.absorb_sets(df, "g", "x").collect()}
    moved = sum(n for k, n in stages().items() if k not in before)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {}
    for i, s in sets.items():
        over = [(-len(z), k) for z, k in first.items() if s < z]
        if over or first[s] != i:
            want[i] = min(over)[1] if over else first[s]
    assert got == want and len(want) > 300
    assert 0 < moved < 20 * len(rows), moved


def test_ranks_of_hot_and_null_groups(spark):
    rows = [(g, v) for g, many in (("hot", 300), ("b", 5), (None, 20)) for v in random.Random(1).sample(range(1000), many)]
    got = ranking.ranks(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"], "r").collect()
    for g in ("hot", "b", None):
        assert [(r.v, r.r) for r in sorted((r for r in got if r.g == g), key=lambda r: r.v)] == [(v, i + 1) for i, v in enumerate(sorted(v for k, v in rows if k == g))]


def test_marginal_relevance(spark):
    sf = "/root/testdata/sf0.001"
    unit = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    got = {}
    for r in links.marginal_relevance(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.pick] = r.vec_id
    for q, picks in got.items():
        score = {k: round(float(unit[q] @ v), 6) for k, v in unit.items() if k != q}
        left, chosen = sorted(score, key=lambda k: (-score[k], k))[:50], []
        for _ in range(10):
            gain = {k: round(0.7 * score[k] - 0.3 * max([float(unit[k] @ unit[c]) for c in chosen], default=0.0), 9) for k in left}
            best = min(gain, key=lambda k: (-gain[k], k))
            chosen.append(best)
            left.remove(best)
        assert [picks[i] for i in range(1, 11)] == chosen


def test_greedy_retention_query(spark):
    sf = "/root/testdata/sf0.001"
    got = links.greedy_retention(spark, sf).collect()
    assert len(got) == len({r.doc_id for r in got}) == spark.read.parquet(f"{sf}/documents.parquet").count()
