"""Data sources and sinks over small fixtures, and folded drafts, schemas and clients against plain loops."""

import hashlib
import json
import os
import random
import sqlite3
import sys

import pytest
from pyspark.sql import functions as F

from prismarc.operators import extensions
from prismarc.plans import ledgers
from prismarc.sources import feeds, trees

sys.path.insert(0, os.path.dirname(__file__))
os.environ["PYTHONPATH"] = os.path.dirname(__file__) + os.pathsep + os.environ.get("PYTHONPATH", "")


def test_spans():
    assert [(s.first, s.last) for s in feeds.spans(1, 10, 4)] == [(1, 3), (4, 6), (7, 9), (10, 10)]
    assert [(s.first, s.last) for s in feeds.spans(5, 5, 4)] == [(5, 5)]


def test_paged_lists():
    reader = feeds.PagedReader(type("S", (), {"fields": [type("F", (), {"name": n}) for n in ("id", "body")]}), {"transport": "page_transport:fetch", "last": "5", "per_second": "500", "partitions": "1"})
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(p * 10 + i, json.dumps({"n": i})) for p in (1, 2, 3) for i in range(2)]
    broken = feeds.PagedReader(type("S", (), {"fields": []}), {"transport": "page_transport:nothing", "last": "1"})
    with pytest.raises(AttributeError):
        list(broken.read(feeds.Span(1, 1)))


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "x.sqlite")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "odd ""name" (a INTEGER, b TEXT, c REAL, d BLOB)')
        db.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?, ?)', [(i, None if i % 3 else f"t{i}", i / 2, bytes([i])) for i in range(50)])
        db.execute("CREATE TABLE empty (a INTEGER)")
    db.close()
    before = (tmp_path / "x.sqlite").read_bytes()
    feeds.register(spark)
    got = spark.read.format("prismarc_sqlite").option("path", path).option("table", 'odd "name').load()
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "double", "binary"]
    assert sorted((r.a, r.b, r.c, bytes(r.d)) for r in got.collect()) == [(i, None if i % 3 else f"t{i}", i / 2, bytes([i])) for i in range(50)]
    assert spark.read.format("prismarc_sqlite").option("path", path).option("table", "empty").load().count() == 0
    assert (tmp_path / "x.sqlite").read_bytes() == before


def test_trees_and_pinned_blobs(spark, tmp_path):
    body = b"hello"
    sha = hashlib.sha1(b"blob 5\0" + body).hexdigest()
    tree = [("b/two.png", sha), ("a/one.png", sha), ("notes.md", "f" * 40), ("src/x.py", "e" * 40)]
    (tmp_path / "tree.json").write_text(json.dumps({"commit_sha": "c" * 40, "tree": [{"path": p, "mode": "100644", "type": "blob", "sha": s, "size": 5} for p, s in tree] + [{"path": "a", "type": "tree", "sha": "0"}]}))
    rows = trees.read_tree(spark, str(tmp_path / "tree.json"))
    assert {(r.sha, r.path, r.aliases) for r in trees.blob_candidates(rows).collect()} == {(sha, "a/one.png", 1), ("f" * 40, "notes.md", 0), ("e" * 40, "src/x.py", 0)}
    kinds = rows.select("path", trees.classified(F.col("path"), {"a/*": "first", "*.png": "image", "*.md": "text"}).alias("k"))
    assert {r.path: r.k for r in kinds.collect()} == {"b/two.png": "image", "a/one.png": "first", "notes.md": "text", "src/x.py": "other", "a": "other"}
    files = spark.createDataFrame([(bytearray(body), sha)], "content binary, sha string")
    assert bytes(trees.pinned(files, "content", "sha").first().content) == body
    with pytest.raises(Exception, match="not the pinned blob"):
        trees.pinned(files.withColumn("sha", F.lit("0" * 40)), "content", "sha").collect()


def test_content_shards_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(i, bytearray(b"x" * (i % 3)) if i else None) for i in range(9)], "i int, content binary")
    folder = str(tmp_path / "store")
    first = trees.write_content(rows.coalesce(1), "content", folder).collect()
    assert len(first) == 8 and sum(r.fresh for r in first) == 3
    assert not any(r.fresh for r in trees.write_content(rows, "content", folder).collect())
    for r in first:
        with open(os.path.join(folder, r.sha256[:2], r.sha256), "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == r.sha256
    shards = trees.write_sqlite(rows.select("i", F.hex("content").alias("h")).repartition(2), str(tmp_path / "index"), "i").collect()
    found = [row for s in shards for row in sqlite3.connect(s.file).execute("SELECT i, h FROM rows").fetchall()]
    assert sorted(found, key=repr) == sorted([(i, ("78" * (i % 3)) if i else None) for i in range(9)], key=repr)
    assert [r.value for r in trees.html_rows(spark.createDataFrame([("<a&\"b>", None)], "x string, y int")).collect()] == ["<tr><td>&lt;a&amp;&quot;b&gt;</td><td></td></tr>"]


def test_folded_drafts(spark):
    r = random.Random(4)
    ops = [(k, i, r.randrange(6), f"q{r.randrange(8)}") for k in range(12) for i in range(r.randint(1, 25))]
    want = {}
    for k, _, expected, request in ops:
        rev, refused, repeated, seen = want.get(k, (0, 0, 0, ()))
        if request in seen:
            repeated += 1
        elif expected == rev:
            rev, seen = rev + 1, (*seen, request)
        else:
            refused += 1
        want[k] = rev, refused, repeated, seen
    got = ledgers.folded_drafts(spark.createDataFrame(ops, "k int, i int, e int, q string"), "k", "i", "e", "q").collect()
    assert {x.k: (x.revision, x.refused, x.repeated) for x in got} == {k: v[:3] for k, v in want.items()}


def test_schemas():
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": ["integer", "null"], "maximum": 3}, "maxItems": 3}, "b": {"type": "string", "pattern": "^x", "minLength": 2}}}
    assert ledgers.schema_errors({"a": [1, None, 4], "b": "y"}, schema) == ["$.a[2]: maximum", "$.b: minLength", "$.b: pattern"]
    assert ledgers.schema_errors({"a": [True]}, schema) == ["$.a[0]: type"] and ledgers.schema_errors([], schema) == ["$: type"]
    with pytest.raises(ValueError, match="unsupported"):
        ledgers.schema_errors({}, {"oneOf": []})


def test_clients_are_closed(spark, tmp_path):
    place = str(tmp_path)

    def factory():
        class Client:
            def close(self):
                import uuid

                open(os.path.join(place, uuid.uuid4().hex), "w").close()

        return Client()

    rows = spark.range(10).coalesce(1)
    assert extensions.with_client(rows, factory, lambda client, batch: batch, "id long").count() == 10
    assert len(os.listdir(place)) == 1
    counts = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(extensions.counted(F.col("t"), str.split).alias("n")).collect()
    assert [x.n for x in counts] == [2, None, 0]


def test_merged_keeps_the_newest(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 5)], "k int, v string, at int")
    b = spark.createDataFrame([(1, "z", 1), (2, "w", 4), (3, "n", 0)], "k int, v string, at int")
    assert {tuple(r) for r in ledgers.merged(a, b, ["k"], "at").collect()} == {(1, "z", 1), (2, "y", 5), (3, "n", 0)}
