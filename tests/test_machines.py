"""State machines on streams, batch by batch and after restarts."""

import datetime

import pytest

from prismarc.streaming import machines

DAY = datetime.datetime(2024, 5, 1, 12)


def op(key, seq, kind, request=None, expected=0, stage=1, target=None, token=None, body=None, after=0):
    return (key, seq, kind, request or f"r{key}{seq}", expected, stage, target, token, body, DAY + datetime.timedelta(minutes=after or seq))


class Feed:
    """Batches as files, each run to its end and restarted from the checkpoint."""

    def __init__(self, spark, folder, machine, schema):
        self.spark, self.folder, self.machine, self.schema, self.n = spark, folder, machine, schema, 0

    def run(self, *batches):
        for rows in batches:
            self.n += 1
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"file://{self.folder}/in/b{self.n}")
            stream = self.spark.readStream.schema(self.schema).parquet(f"file://{self.folder}/in/*")
            q = self.machine(stream).writeStream.format("parquet").option("path", f"file://{self.folder}/out").option("checkpointLocation", f"file://{self.folder}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
        return sorted(tuple(r) for r in self.spark.read.parquet(f"file://{self.folder}/out").collect())


def test_reviews_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, machines.reviews, machines.OPERATIONS)
    first = [
        op("a", 1, "draft", body="x"), op("a", 2, "draft", body="y"),  # the second names revision 0: stale
        op("a", 3, "advance", expected=1), op("a", 4, "advance", expected=2, stage=3), op("a", 5, "burn"),
        op("b", 1, "advance"), op("b", 2, "advance", expected=1, stage=2), op("b", 3, "advance", expected=2, stage=3),
        op("b", 4, "preview", expected=3, stage=4), op("b", 5, "commit", expected=3, stage=4, token="no"),
    ]
    got = feed.run(first)
    assert [g[2:] for g in got if g[0] == "a"] == [("saved", 1, 1), ("stale revision", 1, 1), ("advanced", 2, 2), ("wrong stage", 2, 2), ("unknown kind", 2, 2)]
    token = machines.token_of("b", 3, "")
    assert [g[2] for g in got if g[0] == "b"] == ["advanced"] * 3 + ["granted", "wrong token"]
    second = [
        op("a", 1, "draft", body="x"),  # the same request: answered as before
        op("a", 6, "draft", request="ra1", expected=2, stage=2, body="z"),  # its id with other content
        op("a", 2, "draft", request="new", expected=2, stage=2),  # behind what the key has taken
        op("a", 7, "rewind", expected=2, stage=2, target=3), op("a", 8, "rewind", expected=2, stage=2, target=1),
        op("b", 6, "commit", expected=3, stage=4, token=token),  # stage 4 isn't acknowledged
        op("b", 7, "advance", expected=3, stage=4), op("b", 8, "commit", expected=4, stage=4, token=token),
        op("b", 9, "preview", expected=4, stage=4), op("b", 10, "commit", expected=4, stage=4, token=machines.token_of("b", 4, ""), after=9 + 16),
    ]
    got = feed.run(second)
    told = lambda key, *seqs: [g[2] for g in got if g[0] == key and g[1] in seqs]
    assert sorted(told("a", 1)) == ["repeated: saved", "saved"] and told("a", 6, 7, 8) == ["request conflict", "wrong target", "rewound"] and "late" in told("a", 2)
    assert told("b", 6, 7, 8, 9, 10) == ["stage gate", "advanced", "no preview", "granted", "token expired"]
    third = [
        op("b", 11, "preview", expected=4, stage=4, after=30), op("b", 12, "commit", expected=4, stage=4, token=machines.token_of("b", 4, ""), after=31),
        op("b", 13, "commit", expected=4, stage=4, token="any", after=32), op("b", 14, "draft", expected=4, stage=4, body="late change", after=33),
        op("b", 15, "commit", expected=5, stage=4, token=machines.token_of("b", 4, ""), after=34),
    ]
    got = feed.run(third)
    assert told("b", 11, 12, 13, 14, 15) == ["granted", "committed", "committed before", "saved", "no preview"]


def test_request_ids_are_forgotten(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: machines.reviews(s, ttl="2 hours"), machines.OPERATIONS)
    feed.run([op("a", 1, "draft", request="one", body="x")], [op("z", 1, "draft", after=60 * 24)], [op("z", 2, "draft", expected=1, after=60 * 48)])
    got = feed.run([op("a", 9, "draft", request="one", expected=1, body="y", after=60 * 49)])
    assert ("a", 9, "saved", 2, 1) in got


def test_one_batch_or_many(spark, tmp_path):
    rows = [op(k, s, kind, expected=e, stage=st) for k in "abc" for s, (kind, e, st) in enumerate([("draft", 0, 1), ("advance", 1, 1), ("draft", 9, 2), ("advance", 2, 2), ("rewind", 3, 2)])]
    for folder in ("one", "many"):
        (tmp_path / folder).mkdir()
    one = Feed(spark, tmp_path / "one", machines.reviews, machines.OPERATIONS).run(rows)
    many = Feed(spark, tmp_path / "many", machines.reviews, machines.OPERATIONS).run(*[[r for r in rows if r[1] == s] for s in range(5)])
    assert one == many and len(one) == 15


def test_snapshots_are_ready_once_whole(spark, tmp_path):
    schema = "key string, seq long, kind string, parts long, part long, digest long"
    feed = Feed(spark, tmp_path, machines.snapshots, schema)
    feed.run([("s", 1, "plan", 3, None, 60), ("s", 2, "part", None, 0, 10), ("s", 3, "part", None, 1, 20), ("s", 4, "part", None, 1, 21)])
    got = feed.run([("s", 5, "part", None, 1, 20), ("s", 6, "part", None, 2, 30), ("s", 7, "part", None, 3, 1), ("s", 8, "plan", 4, None, 60), ("t", 1, "plan", 1, None, 5), ("t", 2, "part", None, 0, 6)])
    assert [g[2] for g in got if g[0] == "s"] == ["planned", "staged", "staged", "other content", "staged", "ready", "closed", "other plan"]
    assert [g[2] for g in got if g[0] == "t"] == ["planned", "digests differ"]


class Cell:
    """A value or a map of the state that counts what it is asked."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def exists(self):
        return self.containsKey(None)

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def iterator(self):
        self.calls += 1 + len(self.held)
        return iter(list(self.held.items()))

    def clear(self):
        self.calls += 1
        self.held = {}


class Cells(dict):
    def getValueState(self, name, schema):
        return self.setdefault(name, Cell())

    getMapState = lambda self, name, *schemas: self.getValueState(name, None)


def test_snapshots_ask_the_state_once_a_batch():
    from pyspark.sql import Row

    def batches(many, size):
        ops = [Row(seq=0, kind="plan", parts=many, part=None, digest=sum(range(many)))] + [Row(seq=i + 1, kind="part", parts=None, part=i, digest=i) for i in range(many)]
        machine, cells, out = machines.Snapshots(), Cells(), []
        machine.init(cells)
        for at in range(0, len(ops), size):
            out += machine.handleInputRows(("k",), iter(ops[at : at + size]), None)
        assert [r[2] for r in out] == ["planned"] + ["staged"] * (many - 1) + ["ready"]
        late = list(machine.handleInputRows(("k",), iter([Row(seq=many + 1, kind="part", parts=None, part=0, digest=5)]), None))
        assert late[0][2] == "closed"
        return sum(c.calls for c in cells.values())

    assert batches(20, 7) <= 8
    # beyond what one value keeps a part is looked up by its key: two calls a row and two a batch at most
    assert batches(1000, 50) <= 2 * 1001 + 2 * 22 + 1


def test_snapshots_beyond_one_value_over_restarts(spark, tmp_path):
    many = machines.INLINE + 44
    part = lambda i, digest=None: ("k", i + 1, "part", None, i, i if digest is None else digest)
    feed = Feed(spark, tmp_path, machines.snapshots, "key string, seq long, kind string, parts long, part long, digest long")
    feed.run([("k", 0, "plan", many, None, sum(range(many)))] + [part(i) for i in range(10)])
    feed.run([part(i) for i in range(10, many - 2)])
    got = feed.run([part(3, 9), part(4), *[part(i) for i in range(many - 2, many)]], [part(7)])
    assert [r[2] for r in got if r[1] == 4] == ["other content", "staged"] and [r[2] for r in got if r[1] == 5] == ["staged"] * 2
    assert [r[2] for r in got if r[1] == many] == ["ready"] and sorted(r[2] for r in got if r[1] == 8) == ["closed", "staged"]
