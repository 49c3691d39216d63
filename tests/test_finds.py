"""Table functions: finds in texts, their columns by kind, partitions of a table argument."""

import pytest

from prismarc.functions import finds, normalise

Q = '\\"'


@pytest.mark.parametrize("text,found", [
    ('{argument name="a" default="b"}', [("a", "b")]), ('{argument name="a"}', [("a", None)]), ("{argument name='a' default='it is'}", [("a", "it is")]),
    (r'{argument name="a \"x\" y" default="b\\"}', [(r"a \"x\" y", "b\\\\")]), ('{argument name="a"\n\tdefault="" }', [("a", "")]),
    (f"{{argument name={Q}a{Q} default={Q}b\\n c{Q}}}", [("a", "b\\n c")]), (f'{{argument name="a" default={Q}b{Q}}}', [("a", "b")]),
    ('{argument name="a" default="{argument name="}', [("a", "{argument name=")]), ("{argument nothing} [[b|c]] [[d]] [[", [(None, None), ("b", "c"), ("d", None), (None, None)]),
    ('{argument name="open', [(None, None)]), ('{argument name="a" default="b" more}', [(None, None)]), ("", []), (None, []), ('{argument default="b" name="a"}', [(None, None)]),
])
def test_arguments(text, found):
    got = normalise.arguments(text)
    assert [(a["name"], a["default"]) for a in got] == found and all(text[a["begin"]] in "{[" for a in got)


def test_lateral_finds(spark):
    finds.register(spark)
    rows = spark.createDataFrame([(1, '[[a|b]] {argument name="c"}'), (2, None), (3, "none"), (4, '<a id="x"></a>\n```md\nq\n```\n')], "i int, text string")
    got = spark.sql("SELECT r.i, f.* FROM {rows} r, LATERAL finds(r.text, 'arguments') f", rows=rows)
    assert got.columns == ["i", "ordinal", "begin", "end", "name", "default"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, 7, "a", "b"), (1, 1, 8, 27, "c", None)]
    got = spark.sql("SELECT r.i, f.* FROM {rows} r, LATERAL finds(r.text, 'fences') f", rows=rows)
    assert [tuple(r) for r in got.collect()] == [(4, 0, "x", "md", "q\n")]
    with pytest.raises(Exception, match="finds are of arguments, fences"):
        spark.sql("SELECT * FROM finds('x', 'colours')").collect()


def test_sessions_of_partitions(spark):
    finds.register(spark)
    rows = spark.createDataFrame([("a", 0), ("a", 10), ("a", 45), ("b", 5), ("a", 46), ("c", None), ("b", 5)], "k string, m int").selectExpr("k", "timestamp_seconds(m * 60) AS ts")
    got = spark.sql("SELECT k, session, rows, unix_seconds(first) div 60 AS f, unix_seconds(last) div 60 AS l FROM sessions_of(TABLE(SELECT k, ts FROM {rows}) PARTITION BY k ORDER BY (ts), 30)", rows=rows)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, 2, 0, 10), ("a", 1, 2, 45, 46), ("b", 0, 2, 5, 5)]
    with pytest.raises(Exception, match="a key and ts"):
        spark.sql("SELECT * FROM sessions_of(TABLE(SELECT k FROM {rows}) PARTITION BY (k), 30)", rows=rows).collect()
