"""Sorted projection passes against all pairs: clusters, copies, long runs, borders, and what may not link."""

import math

import duckdb
import numpy as np
import pytest

from prismarc.llm import registry, vector_dups

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.98):
    fit = [k for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    groups = {}
    for k in fit:
        groups.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for own in groups.values():
        x = np.array([rows[k][1] for k in own], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a != b:
                near[own[a]].add(own[b])
    first, out = {}, []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        if k not in first:
            queue, first[k] = [k], rows[k][0]
            while queue:
                for o in near[queue.pop()]:
                    if o not in first:
                        first[o] = rows[k][0]
                        queue.append(o)
    for k, (i, *_) in enumerate(rows):
        out.append((i, len(near[k]), first[k], first[k] == i))
    return sorted(out, key=repr)


def vectors(seed, n=300, d=24):
    r = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 1, 2):
        for _ in range(n // 6):
            rows.append((r.standard_normal(d), label))
    for size, spread in ((60, 0.02), (25, 0.03), (9, 0.05), (2, 0.04), (2, 0.0)):
        center = r.standard_normal(d)
        rows += [(center + spread * r.standard_normal(d), int(size % 3)) for _ in range(size)]
    copy = r.standard_normal(d)
    rows += [(copy * s, 1) for s in (1.0, 1.0, 1.0, 2.0, 1e200, 1e-200)] + [(-copy, 1), (copy, 2)]
    r.shuffle(rows)
    out = [(int(i), [float(x) for x in v], l) for i, (v, l) in zip(r.permutation(len(rows)), rows)]
    v = out[5][1]
    odd = [(None, v, 1), (9000, None, 1), (9001, [], 1), (9002, [0.0] * d, 1), (9003, [*v[:-1], None], 1), (9004, [*v[:-1], math.nan], 1), (9005, [*v[:-1], math.inf], 1), (9006, v, None), (9007, v[: d // 2], out[5][2]), (9008, v[: d // 2], out[5][2]), (9009, [-0.0] * d, 1)]
    return out + odd + [out[5], out[5], out[9]]


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"block": 8, "cell": 2}), (3, {"block": 16, "cell": 1, "at_once": 3}), (4, {"block": 4, "cell": 3})])
def test_against_all_pairs(spark, seed, options):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_links", "2 AS __n", "3 AS __g").repartition(5)
    want = brute(rows)
    assert max(w[1] for w in want) > 20 and sum(not w[3] for w in want) > 50
    assert found(vector_dups.near_vectors(df, **options)) == want


def test_chains_are_one_component_and_thresholds_hold(spark):
    step = math.acos(0.98) * 0.999
    rows = [(100 - k, [math.cos(k * step), math.sin(k * step)], 7) for k in range(15)] + [(500, [math.cos(-1.002 * math.acos(0.98)), math.sin(-1.002 * math.acos(0.98))], 7)]
    got = found(vector_dups.near_vectors(spark.createDataFrame(rows, SCHEMA), block=4, cell=2))
    assert got == brute(rows) and {g[2] for g in got if g[0] < 500} == {86} and [g for g in got if g[0] == 500] == [(500, 0, 500, True)]


def test_number_of_passes():
    assert vector_dups.plan(0, 0.98, 1e-6, 256) == (0, 1) and vector_dups.plan(256, 0.98, 1e-6, 256) == (0, 1)
    for n in (10**3, 10**5, 10**9):
        m, passes = vector_dups.plan(n, 0.98, 1e-6, 256)
        assert n / 2**m <= 256 and (1 - (1 - math.acos(0.98) / math.pi) ** m) ** passes <= 1e-6


def test_empty_tables(spark):
    assert found(vector_dups.near_vectors(spark.createDataFrame([], SCHEMA))) == []
    assert found(vector_dups.near_vectors(spark.createDataFrame([(1, None, None), (2, [1.0], None)], SCHEMA))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_query_and_its_sql(spark, tmp_path):
    got = found(registry.queries()["op12_sorted_projections"](spark, SF))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
        sql = db.sql(registry.oracle_sql()["op12_sorted_projections"]).select("vec_id, n_links, component_id, kept").fetchall()
        # squares of the SQL stay within doubles, and an id is one row
        rows = [r for r in vectors(6, 120)[:-3] if r[0] is not None and r[0] < 9000 and 1e-99 < max(map(abs, r[1])) < 1e99]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/e.parquet")
        db.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e.parquet/*.parquet')")
        planted = db.sql(registry.oracle_sql()["op12_sorted_projections"]).select("vec_id, n_links, component_id, kept").fetchall()
    assert got == sorted(sql, key=repr)
    assert sorted(planted, key=repr) == brute(rows)
