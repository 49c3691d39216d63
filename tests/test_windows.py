"""The stream's windows against a batch over the same events."""

from pyspark.sql import functions as F

from prismarc.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_windows_to_the_end_of_the_input(spark):
    got = {(r.start, r.event_type): r.n for r in catalogue.queries()["watermark_windows"](spark, SF).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")
    assert got == {(r.start, r.event_type): r.n for r in want.collect()}
    assert sum(got.values()) == events.count()


def test_append_streams_sources_and_sinks(spark, tmp_path):
    from pyspark.sql import types as T

    from prismarc.sources import files
    from prismarc.streaming import windows

    schema = "k long, ts timestamp"
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")]
    frame = spark.createDataFrame(rows, "k long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), frame.schema)
    assert sorted(r.k for r in windows.run_to_files(windows.first_writer(stream, ["k"])).collect()) == [1, 2]
    done = []
    both = windows.commit_then_advance(lambda df, n: done.append(("sink", n)), lambda df, n: done.append(("state", n)))
    both(frame, 3)
    assert done == [("sink", 3), ("state", 3)]

    def broken(df, n):
        raise ValueError("sink")

    try:
        windows.commit_then_advance(broken, lambda df, n: done.append("moved"))(frame, 4)
    except ValueError:
        assert "moved" not in done

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbad\n')
    (tmp_path / "b.json").write_text('{"rows": [{"x": 1}, {"x": 2}]}')
    (tmp_path / "c.js").write_text('window.DATA = [{"x": 5}];\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a long", strict=False).collect()) == [1, 2]
    try:
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a long").collect()
        raise AssertionError("a bad line passed")
    except Exception as e:
        assert "bad line" not in str(e)
    assert sorted(r.x for r in files.read_json_rows(spark, str(tmp_path / "b.json"), "rows", "x long").collect()) == [1, 2]
    assert [r.x for r in files.read_js_assignment(spark, str(tmp_path / "c.js"), "array<struct<x:long>>").collect()] == [5]
    import hashlib

    assert files.file_digests(spark, str(tmp_path / "b.json")).first().sha256 == hashlib.sha256((tmp_path / "b.json").read_bytes()).hexdigest()
    target = files.write_versioned(frame, str(tmp_path / "v"), 1)
    assert spark.read.parquet(target).count() == 3 and spark.read.json(str(tmp_path / "v/manifests/version=1")).first().rows == 3
    try:
        files.write_versioned(frame, str(tmp_path / "v"), 1)
        raise AssertionError("a version was written twice")
    except Exception as e:
        assert "exists" in str(e).lower()
    wide = files.union_lanes(frame, frame.select("k", F.lit("x").alias("extra")))
    assert wide.count() == 6 and isinstance(wide.schema["extra"].dataType, T.StringType)


def test_hot_groups_sums_and_bands(spark):
    import random

    from prismarc.operators import ranking, vectors

    r = random.Random(3)
    rows = [(g, i, r.randrange(100)) for g, many in (("hot", 400), ("b", 3), (None, 9)) for i in r.sample(range(5000), many)]
    got = ranking.running_sums(spark.createDataFrame(rows, "g string, i int, v long"), ["g"], ["i"], "v", "s").collect()
    for g in ("hot", "b", None):
        total = 0
        for x in sorted((x for x in got if x.g == g), key=lambda x: x.i):
            total += x.v
            assert x.s == total
    assert len(got) == len(rows)
    base = [r.getrandbits(63) for _ in range(30)]
    bits = [b ^ sum(1 << k for k in r.sample(range(63), r.randint(0, 9))) for b in base for _ in range(5)] + base[:5] + base[:2]
    own = list(enumerate(bits))
    least = {}
    for i, b in own:
        least.setdefault(b, i)
    want = {(min(i, j), max(i, j), (a ^ b).bit_count()) for a, i in least.items() for b, j in least.items() if i < j and (a ^ b).bit_count() <= 8} | {(least[b], i, 0) for i, b in own if least[b] != i}
    got = vectors.banded_pairs(spark.createDataFrame(own + [(None, 1), (999, None)], "i long, b long"), "i", "b", 8)
    assert {tuple(x) for x in got.collect()} == want
