"""Radix selection against sorted lists: ties, copies, huge components, odd rows; and the SQL."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from prismarc.llm import hard_negatives, registry

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=10, k=5, m=5, low=80, high=100):
    fit = [(i, tuple(min(max(math.floor(256 * x), -(2**62)), 2**62) for x in v), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, l in sorted(set(r for r in fit if r[0] % every == 0)):
        scored = [(-max(-(2**61), min(2**61, sum(x * y for x, y in zip(q, o)))), i, t) for i, o, t in fit if len(o) == len(q)]
        for s, p, _ in sorted(x for x in scored if x[2] == l and x[1] != a)[:k]:
            near = sorted(x for x in scored if x[2] != l and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(near[:m])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def vectors(seed, n=240, d=6, span=1.0):
    r = random.Random(seed)
    center = [[r.gauss(0, 1) for _ in range(d)] for _ in range(3)]
    rows = []
    for i in range(n):
        v = [span * (x + 0.3 * r.gauss(0, 1)) for x in r.choice(center)]
        rows.append((i * r.choice([1, 1, 3]) + 1000 * i, v, r.randrange(4)))
    same = [span * x for x in center[0]]
    rows += [(50_000_000 + 7 * i, same, i % 2) for i in range(60)]  # ties far beyond k
    rows += [(10, same, 1), (20, [0.0] * d, 1), (30, [-x for x in same], 2), (40, same[:3], 0), (50, same[:3], 0), (51, same[:3], 1)]
    odd = [(None, same, 1), (60, None, 1), (61, [], 1), (62, [*same[:-1], None], 1), (63, [*same[:-1], math.nan], 1), (64, [*same[:-1], -math.inf], 0), (70, same, None)]
    return rows + odd + [rows[4], rows[4], rows[9], (10, same, 1), (-(2**63), same, 0), (2**63 - 1, same, 0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "2 AS __w", "3 AS __p").repartition(5)


@pytest.mark.parametrize("seed,span", [(1, 1.0), (2, 0.004), (3, 3e5), (4, 1e18)])
def test_against_sorted_lists(spark, monkeypatch, seed, span):
    if seed > 1:
        monkeypatch.setattr(hard_negatives, "CELLS", 1 << 10)
    rows = vectors(seed, span=span)
    want = brute(rows)
    got = found(hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0))
    assert len(want) > 100 and got == want


def test_other_numbers(spark):
    rows = vectors(5, 120)
    got = found(hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=2, negatives=90, low=-50, high=120))
    assert got == brute(rows, k=2, m=90, low=-50, high=120)


def test_repeated_rows_beyond_the_wanted(spark):
    rows = [(0, [1.0, 0.0], 1)] + [(7, [0.9, 0.1], 1)] * 30 + [(3, [0.8, 0.0], 2)] * 50 + [(4, [0.8, 0.0], 2), (2, [0.7999, 0.0], 3)]
    assert found(hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows)


def test_tables_without_rows(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 1)]):
        assert found(hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == []


def test_query_and_its_sql(spark):
    got = found(registry.queries()["op11_radix_selection"](spark, SF))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
        sql = db.sql(registry.oracle_sql()["op11_radix_selection"]).select(", ".join(COLUMNS)).fetchall()
    assert got == sorted(sql)
