"""Stored tables: upserts on change, replays, stale writers, buckets that stay, guards, deletes, nulls."""

import os

import pytest
from pyspark.sql import functions as F

from prismarc.operators import tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, day string, body string, n long")


def start(spark, tmp_path, rows, buckets=8):
    path = f"file://{tmp_path}/t"
    tables.create(spark, path, frame(spark, []).schema, ["k", "day"], buckets)
    if rows:
        tables.merge(spark, path, frame(spark, rows), batch="first")
    return path


def found(spark, path, number=None):
    return sorted((tuple(r) for r in tables.read(spark, path, number).collect()), key=repr)


ROWS = [(i, "a", f"body {i}", i) for i in range(30)] + [(None, "a", "no key", 0), (3, None, "no day", 0)]


def test_upsert_on_change_and_replay(spark, tmp_path):
    path = start(spark, tmp_path, ROWS)
    assert found(spark, path) == sorted(ROWS, key=repr)
    before = tables.version(spark, path)
    batch = [(4, "a", "new", 4), (5, "a", "body 5", 5), (77, "a", "come", None), (None, "a", "null is a key", 0)]
    told = tables.merge(spark, path, frame(spark, batch), when="t.body <> s.body", batch="second")
    assert told == {"version": 2, "replayed": False, "inserted": 1, "updated": 2, "deleted": 0, "unchanged": 1}
    want = {(r[0], r[1]): r for r in ROWS} | {(r[0], r[1]): r for r in batch}
    assert found(spark, path) == sorted(want.values(), key=repr)
    # only buckets with a change have new folders
    after = tables.version(spark, path)
    moved = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert moved == {str(r[0]) for r in frame(spark, [batch[0], batch[2], batch[3]]).select(tables.bucket(["k", "day"], 8)).collect()}
    assert tables.merge(spark, path, frame(spark, batch), batch="second") == {"version": 2, "replayed": True, "inserted": 0, "updated": 0, "deleted": 0, "unchanged": 0}
    # nothing changes: no version
    assert tables.merge(spark, path, frame(spark, batch))["unchanged"] == 4 and tables.versions(spark, path) == [0, 1, 2]
    tables.merge(spark, path, frame(spark, [(88, "b", "x", 1)]), batch="third")
    assert tables.merge(spark, path, frame(spark, [(99, "b", "x", 1)]), batch="second")["replayed"]
    assert found(spark, path, 1) == sorted(ROWS, key=repr)
    with pytest.raises(ValueError, match="no such version"):
        tables.read(spark, path, 9)


def test_stale_writers_fail(spark, tmp_path, monkeypatch):
    path = start(spark, tmp_path, ROWS)
    with pytest.raises(tables.StaleWriter, match="decided upon version 0"):
        tables.merge(spark, path, frame(spark, [(1, "a", "x", 1)]), read_at=0)
    # another writer commits between the read and the claim
    claim = tables.Files.claim

    def slow(self, text, *names):
        if names[0] == tables.VERSIONS and not slow.done:
            slow.done = True
            tables.merge(spark, path, frame(spark, [(2, "a", "other writer", 2)]))
        return claim(self, text, *names)

    slow.done = False
    monkeypatch.setattr(tables.Files, "claim", slow)
    with pytest.raises(tables.StaleWriter, match="came meanwhile"):
        tables.merge(spark, path, frame(spark, [(1, "a", "lost", 1)]))
    got = {r[0]: r[2] for r in found(spark, path) if r[1] == "a"}
    assert got[2] == "other writer" and got[1] == "body 1"
    named = {f.split("/")[0] for v in tables.versions(spark, path) for f in tables.version(spark, path, v).folders.values()}
    assert set(os.listdir(tmp_path / "t" / "rows")) == named  # the loser's rows and all working folders are gone


def test_guarded_sums(spark, tmp_path):
    path = start(spark, tmp_path, [(1, "d", "", 70), (2, "d", "", 95)])
    add = frame(spark, [(1, "d", None, 20), (2, "d", None, 20), (3, "d", None, 20), (4, "d", None, 200)])
    told = tables.merge(spark, path, add, when="t.n + s.n <= 100", values={"n": "t.n + s.n"}, insert="s.n <= 100")
    assert told == {"version": 2, "replayed": False, "inserted": 1, "updated": 1, "deleted": 0, "unchanged": 2}
    assert found(spark, path) == [(1, "d", "", 90), (2, "d", "", 95), (3, "d", None, 20)]


def test_last_row_of_a_key_deletes_and_columns(spark, tmp_path):
    path = start(spark, tmp_path, ROWS)
    twice = frame(spark, [(1, "a", "early", 1), (1, "a", "late", 2), (6, "a", "gone", 3)])
    with pytest.raises(ValueError, match="keys repeat"):
        tables.merge(spark, path, twice)
    told = tables.merge(spark, path, twice, order="n", delete="s.body = 'gone'")
    assert (told["updated"], told["deleted"]) == (1, 1)
    got = {(r[0], r[1]): r for r in found(spark, path)}
    assert got[(1, "a")] == (1, "a", "late", 2) and (6, "a") not in got and len(got) == len(ROWS) - 1
    with pytest.raises(ValueError, match="no such columns"):
        tables.merge(spark, path, twice.withColumn("more", F.lit(1)), order="n")
    tables.merge(spark, path, frame(spark, [(500, "z", "x", 1)]).drop("n"))
    assert (500, "z", "x", None) in found(spark, path)
    assert not [f for f in os.listdir(tmp_path / "t" / "rows") if f.startswith(".")]


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    path = start(spark, tmp_path, ROWS)
    for i in range(3):
        tables.merge(spark, path, frame(spark, [(i, "a", f"again {i}", 0)]))
    want = found(spark, path)
    assert tables.vacuum(spark, path) > 0 and found(spark, path) == want and len(tables.versions(spark, path)) == 1
    tables.merge(spark, path, frame(spark, [(0, "a", "on", 0)]))
    assert len(found(spark, path)) == len(ROWS)


def test_empty_tables(spark, tmp_path):
    path = start(spark, tmp_path, [])
    assert found(spark, path) == []
    assert tables.merge(spark, path, frame(spark, []))["version"] == 0
    with pytest.raises(ValueError, match="there already"):
        tables.create(spark, path, frame(spark, []).schema, ["k"])
