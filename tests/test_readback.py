"""Stores compared by digests: few ranges read, every difference found, flips only if equal."""

import pytest
from pyspark.sql import functions as F

from prismarc.operators import readback


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, day string, body string")


ROWS = [(i, "d", f"b{i}") for i in range(3000)] + [(None, None, "none"), (5, "e", None), (6, "e", "twice"), (6, "e", "twice")]


def states(spark, tmp_path, left, right):
    for name, rows in (("l", left), ("r", right)):
        readback.stage(frame(spark, rows), f"file://{tmp_path}/{name}", ["k", "day"])
    found, compared = readback.differences(spark, f"file://{tmp_path}/l", f"file://{tmp_path}/r", frame(spark, []).schema, ["k", "day"])
    return sorted(((r.k, r.day, r.state) for r in found.collect()), key=repr), compared, found


def test_only_differing_ranges_are_read(spark, tmp_path):
    right = [r for r in ROWS if r[0] != 17] + [(9999, "d", "more")]
    right[2000] = (right[2000][0], "d", "other")
    right.remove((6, "e", "twice"))
    got, compared, found = states(spark, tmp_path, ROWS, right)
    assert got == sorted([(17, "d", "missing"), (9999, "d", "extra"), (right[2000][0], "d", "changed"), (6, "e", "changed")], key=repr)
    assert [c["level"] for c in compared] == [0, 1, 2] and compared[0] == {"level": 0, "compared": 1, "differ": 1}
    assert compared[2]["compared"] == 16 * compared[1]["differ"] <= 64 and compared[2]["differ"] <= 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_leaf" in plan


def test_equal_stores_read_no_rows(spark, tmp_path):
    got, compared, _ = states(spark, tmp_path, ROWS, list(reversed(ROWS)))
    assert got == [] and compared == [{"level": 0, "compared": 1, "differ": 0}]


def test_empty_stores(spark, tmp_path):
    got, compared, _ = states(spark, tmp_path, [], ROWS[:3])
    assert [g[2] for g in got] == ["extra"] * 3 and compared[-1]["differ"] == len({r for r in got})


def test_flips_only_what_is_equal(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/root"
    assert readback.current(spark, root) is None
    first = readback.publish(frame(spark, ROWS), root, ["k", "day"])
    assert readback.current(spark, root) == first
    stage = readback.stage
    monkeypatch.setattr(readback, "stage", lambda rows, path, key: stage(rows.filter(F.coalesce(F.col("k"), F.lit(0)) != 4), path, key))
    with pytest.raises(readback.NotEqual, match="1 ranges"):
        readback.publish(frame(spark, ROWS), root, ["k", "day"])
    assert readback.current(spark, root) == first
    monkeypatch.setattr(readback, "stage", stage)
    assert readback.current(spark, root) != readback.publish(frame(spark, ROWS[:9]), root, ["k", "day"]) == readback.current(spark, root)
