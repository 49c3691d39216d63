"""Vectors met in blocks: what a task holds, and ties."""

import numpy as np

from prismarc.operators import vectors


def of(spark, parts=3, many=300):
    rows = [(i, [float(i % 5 + 1), float(i % 3), 1.0], i % 4) for i in range(many)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(parts)


def test_a_meeting_does_not_pack_its_vectors_again(spark):
    v = of(spark)
    for met in (vectors.pairs_above(v, v, 0.9), vectors.nearest(v, v, 3), vectors.nearest_groups(v, v.filter("vec_id < 9"), 2)):
        assert met._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_nearest_among_many_ties_and_more_than_there_are(spark):
    v = of(spark)
    ids = np.arange(300)
    unit = np.array([[i % 5 + 1, i % 3, 1] for i in ids], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    for k in (1, 7, 299, 400):
        want = {(int(q), int(o), r + 1) for q in ids[::50] for r, o in enumerate([o for o in np.lexsort((ids, -scores[q])) if o != q][:k])}
        got = {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.nearest(v, v.filter("vec_id % 50 = 0"), k).collect()}
        assert got == want
