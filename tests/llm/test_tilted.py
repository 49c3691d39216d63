"""Tilted rates against the conditions of the optimum, and plain bisection where there are no traits."""

import math
import random

import pytest

from prismarc.llm import mixing


def corpus(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, " w" * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "a", "b", None]), rng.random() if rng.random() < 0.95 else None, rng.gauss(0, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, x double, y double")


def test_conditions_of_the_optimum(spark):
    rows, docs = corpus(spark)
    words = {s: sum(len(t.split()) for _, t, o, *_ in rows if o == s) for s in ("a", "b", None)}
    targets = {"a": 0.5 * words["a"], "b": 2.2 * words["b"], None: 1.0 * words[None]}
    traits = {"x": 0.62, "y": -0.4}
    got = {r.doc_id: r for r in mixing.tilted(docs, spark.createDataFrame(list(targets.items()), "source string, target double"), traits).collect()}
    assert len(got) == len(rows)
    rate = {i: got[i].rate for i, *_ in rows}
    size = {i: len(t.split()) for i, t, *_ in rows}
    # primal: words of the sources, means of the traits, bounds
    for s, aim in targets.items():
        assert sum(size[i] * rate[i] for i, _, o, *_ in rows if o == s) == pytest.approx(aim, rel=1e-5)
    total = sum(targets.values())
    for k, name in ((3, "x"), (4, "y")):
        assert sum(size[r[0]] * rate[r[0]] * ((traits[name] if r[k] is None else r[k]) - traits[name]) for r in rows) / total == pytest.approx(0, abs=1e-4)
    assert all(0 <= r <= 3 for r in rate.values()) and max(rate.values()) == 3
    # dual: log rates below the bound are one linear function of the traits, apart by source
    inner = [r for r in rows if 0 < rate[r[0]] < 3 - 1e-9]
    base = {s: [r for r in inner if r[2] == s] for s in targets}
    f = lambda r: (traits["x"] if r[3] is None else r[3], r[4], math.log(rate[r[0]]))
    (x0, y0, l0), (x1, y1, l1), (x2, y2, l2) = map(f, base["a"][:3])
    det = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
    mx, my = ((l1 - l0) * (y2 - y0) - (l2 - l0) * (y1 - y0)) / det, ((x1 - x0) * (l2 - l0) - (x2 - x0) * (l1 - l0)) / det
    for own in base.values():
        lead = f(own[0])
        assert all(f(r)[2] - lead[2] == pytest.approx(mx * (f(r)[0] - lead[0]) + my * (f(r)[1] - lead[1]), abs=1e-6) for r in own)
    for r in rows:  # at the bound only where the tilt asks for it
        if rate[r[0]] >= 3 - 1e-9 and base[r[2]]:
            lead = f(base[r[2]][0])
            x = traits["x"] if r[3] is None else r[3]
            assert lead[2] + mx * (x - lead[0]) + my * (r[4] - lead[1]) >= math.log(3) - 1e-6
    # copies: whole numbers beside the rate, words near the targets
    assert all(g.copies in (math.floor(g.rate), math.floor(g.rate) + 1) and g.taken == g.copies * g.size for g in got.values())
    for s, aim in targets.items():
        assert sum(got[i].taken for i, _, o, *_ in rows if o == s) == pytest.approx(aim, rel=0.05)


def test_without_traits_and_edges(spark):
    rows, docs = corpus(spark, 300, 2)
    words = sum(len(t.split()) for _, t, o, *_ in rows if o == "a")
    targets = spark.createDataFrame([("a", 1.7 * words), ("gone", 5.0)], "source string, target double")
    got = {r.doc_id: r.rate for r in mixing.tilted(docs, targets, {}).collect()}
    assert all(got[i] == pytest.approx(1.7 if o == "a" and t.strip() else 0, abs=1e-5) for i, t, o, *_ in rows)
    assert mixing.tilted(docs.limit(0), targets, {"x": 1.0}).count() == 0
    with pytest.raises(ValueError, match="above what its source may give"):
        mixing.tilted(docs, spark.createDataFrame([("a", 3.5 * words)], "source string, target double"), {})
    with pytest.raises(ValueError, match="no rates meet"):
        mixing.tilted(docs, targets, {"x": 2.0}, steps=8)
