"""File sources over small fixtures, and release gates that raise."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prismarc.functions import releases as R
from prismarc.operators import reviews
from prismarc.sources import files


def test_line_scan_states(spark, tmp_path):
    lines = ['\ufeff{"k": 2, "v": "é"}', "", "   ", '{"k": 1, "v": null}\r', "[1]", '{"k": 3', '{"v": "x"}', '{"k": 1, "v": "again"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8", newline="")
    got = files.scan_jsonl(spark, str(tmp_path), "k long, v string", "k", strict=False).collect()
    assert sorted(r.state for r in got) == ["bad json", "no key", "not an object", "sound", "sound", "sound"]
    assert sorted((r.k, r.v or "") for r in got if r.state == "sound") == [(1, ""), (1, "again"), (2, "é")]
    assert {r.bytes: r.sha256 for r in got if r.v == "é"} == {len(lines[0].encode()) - 3: hashlib.sha256(lines[0].encode()[3:]).hexdigest()}
    assert [r.k for r in files.scan_jsonl(spark, str(tmp_path), "k long, v string", "k", strict=False, limit=2).collect()] == [1, 1]
    with pytest.raises(PySparkException):
        files.scan_jsonl(spark, str(tmp_path), "k long, v string", "k").collect()


def test_other_file_sources(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps({"note": "x", "rows": [{"a": 1}, {"a": 2}]}, indent=1))
    assert sorted(r.a for r in files.read_json_rows(spark, str(tmp_path / "rows.json"), "rows", "a long").collect()) == [1, 2]
    (tmp_path / "data.js").write_text('window.ARCHIVE = [{"a": 1}, {"a": 5}];\n')
    assert sorted(r.a for r in files.read_js_assignment(spark, str(tmp_path / "data.js"), "array<struct<a:long>>").collect()) == [1, 5]
    digest = files.file_digests(spark, str(tmp_path / "data.js")).first()
    assert digest.length == len('window.ARCHIVE = [{"a": 1}, {"a": 5}];\n') and len(digest.sha256) == 64
    lanes = files.union_lanes(spark.sql("SELECT 1 AS a"), spark.sql("SELECT 2 AS a, 'x' AS b"))
    assert sorted((r.a, r.b) for r in lanes.collect()) == [(1, None), (2, "x")]
    files.write_versioned(lanes, str(tmp_path / "v"), 3)
    assert spark.read.json(str(tmp_path / "v/manifests/version=3")).first().rows == 2
    with pytest.raises(PySparkException):
        files.write_versioned(lanes, str(tmp_path / "v"), 3)


def test_release_gate_raises(spark):
    rated = spark.sql("SELECT 7 AS k, 'cleared' AS status, true AS gate UNION ALL SELECT 8, NULL, true UNION ALL SELECT 9, 'CLEARED', NULL")
    rights = R.rights_record(F.col("status"), F.col("gate"), F.lit(True), F.lit(None).cast("boolean"), ("cleared",), ("link",), ("blocked",))
    rows = rated.withColumn("r", rights)
    assert {r.k: (r.r.tier, r.r.text_eligible, r.r.media_eligible, r.r.status) for r in rows.collect()} == {7: ("P1", True, False, "cleared"), 8: ("P3", False, False, "not_verified"), 9: ("P3", False, False, "CLEARED")}
    assert rows.filter("k = 7").filter(R.releasable(F.col("k"), F.col("r"))).count() == 1
    with pytest.raises(PySparkException, match="not for public export: 8"):
        rows.filter("k = 8").filter(R.releasable(F.col("k"), F.col("r"))).collect()


def test_hydration_states(spark):
    items = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'a'), (3, 'b') AS t(i, g)")
    hits = spark.sql("SELECT * FROM VALUES ('a', 2, 1), ('a', 3, 1), ('a', 2, 3), ('b', 4, 3), ('b', 3, NULL) AS t(g, m, r)")
    got = reviews.hydrated(hits, items, "i", "g", "m", "r").collect()
    assert sorted((r.g, r.m, r.r or 0, r.state) for r in got) == [("a", 2, 1, "sound"), ("a", 2, 3, "represented_elsewhere"), ("a", 3, 1, "matched_elsewhere"), ("b", 3, 0, "missing"), ("b", 4, 3, "missing")]
    assert reviews.audited(items.limit(0), {"x": F.col("i") > 1}, ("i",)).collect() == [("x", 0), ("repeated i", 0)]


@pytest.mark.parametrize("name", ["collapsed_search", "indexed_collapsed"])
def test_no_text_goes_into_the_joins_of_collapsed_results(spark, name):
    from prismarc.plans import catalogue

    nodes, joins = [catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()], 0
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            joins += 1
            assert not any(x.output().apply(i).name() == "text" for x in below for i in range(x.output().size()))
        nodes += below
    assert joins
