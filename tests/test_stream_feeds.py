"""Streams with offsets: failing batches keep the old version, restarts go on, replays do nothing."""

import pytest
from pyspark.sql import functions as F

from prismarc.operators import tables
from prismarc.streaming import feeds
from tests import page_feed_transport



def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, body string")


def found(spark, path, number=None):
    return sorted(tuple(r) for r in tables.read(spark, path, number).collect())


@pytest.fixture
def pair(spark, tmp_path):
    source, target = f"file://{tmp_path}/source", f"file://{tmp_path}/target"
    for p in (source, target):
        tables.create(spark, p, frame(spark, []).schema, ["k"], 4)
    tables.merge(spark, source, frame(spark, [(i, f"b{i}") for i in range(10)]))
    return source, target, f"file://{tmp_path}/checkpoint"


def test_changes_say_what_happened(spark, pair):
    source, *_ = pair
    tables.merge(spark, source, frame(spark, [(1, "new"), (2, "b2"), (3, "x"), (50, "come")]), delete="s.body = 'x'")
    assert sorted(tuple(r) for r in tables.changes(spark, source, 2).collect()) == [(1, "new", "updated"), (3, "b3", "deleted"), (50, "come", "inserted")]
    assert tables.changes(spark, source, 1).count() == 10 and tables.changes(spark, source, 0).count() == 0


def test_a_mirror_follows(spark, pair):
    source, target, checkpoint = pair
    feeds.mirrored(spark, source, target, checkpoint)
    assert found(spark, target) == found(spark, source)
    tables.merge(spark, source, frame(spark, [(1, "new"), (60, "come"), (2, "x")]), delete="s.body = 'x'")
    tables.merge(spark, source, frame(spark, [(1, "newer"), (2, "back")]))
    tables.merge(spark, source, frame(spark, [(60, "x")]), delete="s.body = 'x'")
    feeds.mirrored(spark, source, target, checkpoint)
    assert found(spark, target) == found(spark, source) and (1, "newer") in found(spark, target)
    before = tables.versions(spark, target)
    feeds.mirrored(spark, source, target, checkpoint)
    assert tables.versions(spark, target) == before


def test_a_failing_second_batch_keeps_the_version(spark, pair):
    source, target, checkpoint = pair
    feeds.mirrored(spark, source, target, checkpoint)
    kept = found(spark, target)
    tables.merge(spark, source, frame(spark, [(4, "bad"), (70, "come")]))

    def broken(df):
        return df.withColumn("body", F.when(F.col("body") == "bad", F.raise_error(F.lit("cannot be normalised"))).otherwise(F.col("body")))

    with pytest.raises(Exception, match="cannot be normalised"):
        feeds.mirrored(spark, source, target, checkpoint, broken)
    assert found(spark, target) == kept and tables.versions(spark, target) == [0, 1]
    # the source moves on; the run after the failure begins with the failed batch
    tables.merge(spark, source, frame(spark, [(4, "mended")]))
    feeds.mirrored(spark, source, target, checkpoint)
    feeds.mirrored(spark, source, target, checkpoint)
    assert found(spark, target) == found(spark, source) and (4, "mended") in found(spark, target)


def test_a_batch_run_again_after_its_merge_does_nothing(spark, pair, monkeypatch):
    source, target, checkpoint = pair
    merge = tables.merge

    def dies_after(*args, **options):
        merge(*args, **options)
        raise RuntimeError("lost after the merge")

    monkeypatch.setattr(tables, "merge", dies_after)
    with pytest.raises(Exception, match="lost after the merge"):
        feeds.mirrored(spark, source, target, checkpoint)
    monkeypatch.setattr(tables, "merge", merge)
    feeds.mirrored(spark, source, target, checkpoint)
    assert tables.versions(spark, target) == [0, 1] and found(spark, target) == found(spark, source)


def test_versions_that_are_gone_stop_the_stream(spark, pair):
    source, target, checkpoint = pair
    for i in range(3):
        tables.merge(spark, source, frame(spark, [(i, "again")]))
    tables.vacuum(spark, source)
    with pytest.raises(Exception, match="is gone; start anew"):
        feeds.mirrored(spark, source, target, checkpoint)


def test_pages_that_grow(spark, tmp_path):
    got, options = [], {"transport": "tests.page_feed_transport:page", "count": "tests.page_feed_transport:count", "partitions": 2}
    for pages in (3, 3, 5):
        with open(page_feed_transport.FILE, "w") as f:
            f.write(str(pages))
        batch = lambda df, n: got.append(sorted(r.id for r in df.collect()))
        feeds.drained(feeds.pages_of(spark, **options), batch, f"file://{tmp_path}/checkpoint")
    assert [g for g in got if g] == [[10 * p + k for p in (1, 2, 3) for k in range(3)], [10 * p + k for p in (4, 5) for k in range(3)]]
