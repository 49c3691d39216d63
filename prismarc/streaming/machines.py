"""Keyed state machines on streams: reviewed drafts with revisions, request ids, previews and commits; staged snapshots.

State is Spark's (``transformWithState`` over RocksDB): it is part of the
checkpoint, so a restart goes on with it, and a batch that is run again sees the
state from before it.  Operations of a key are taken in their order (``seq``)
within a batch; an operation whose place is behind one that the key has taken in
an earlier batch is refused as late.

``reviews``: an operation names the revision that it was decided upon.

- ``draft`` keeps a body, ``advance`` acknowledges the stage and opens the next
  (stages 1 to ``STAGES``), ``rewind`` goes back to ``target``: each raises the
  revision by one; stages are gone through in order.
- ``preview`` binds a token to the revision and the body's digest; ``commit`` is
  taken only with that token, while the revision is the same and before the token
  expires, at the last stage, with the stages before it acknowledged.
- a request id that was used before with the same content is answered as it was
  then and does nothing; with other content it is a conflict.

Request ids are forgotten ``ttl`` after their use, by a timer of event time.
A null body is an empty one; null or unknown kinds are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

STAGES = 4
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPERATIONS = "key string, seq long, kind string, request string, expected long, stage long, target long, token string, body string, at timestamp"
OUTCOMES = StructType([StructField("key", StringType()), StructField("seq", LongType()), StructField("outcome", StringType()), StructField("revision", LongType()), StructField("stage", LongType())])
#: The parts that a snapshot keeps in its one value.
INLINE = 256
OUTCOMES_ROW = Row(*OUTCOMES.names)
OUTCOME = Row("key", "seq", "outcome")
NOTHING = {"revision": 0, "stage": 1, "done": [], "body": "", "token": None, "granted": None, "expires": None, "committed": None, "last": -1}


def token_of(key: str, revision: int, body: str) -> str:
    """What a preview hands out; the same words in SQL: sha2(key || '|' || revision || '|' || body)."""
    return hashlib.sha256(f"{key}|{revision}|{body}".encode()).hexdigest()


class Reviews(StatefulProcessor):
    def __init__(self, ttl_ms: int, token_ms: int) -> None:
        self.ttl_ms, self.token_ms = ttl_ms, token_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.seen = handle.getMapState("seen", "request string", "digest string, outcome string, revision long, stage long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        ops = sorted((r.asDict() for r in rows), key=lambda r: (r["seq"], r["request"] or ""))
        told = self.state.get()
        s, due = json.loads(told[0]) if told else dict(NOTHING), set()
        for op in ops:
            digest = hashlib.sha256(json.dumps([op[c] for c in ("kind", "expected", "stage", "target", "token", "body")]).encode()).hexdigest()
            at = int(op["at"].timestamp() * 1000)
            before = None if op["request"] is None else self.seen.getValue((op["request"],))
            if before is not None:
                same = before[0] == digest
                yield OUTCOMES_ROW(key[0], op["seq"], f"repeated: {before[1]}" if same else "request conflict", before[2] if same else s["revision"], before[3] if same else s["stage"])
                continue
            outcome = self.step(key[0], s, op, at)
            yield OUTCOMES_ROW(key[0], op["seq"], outcome, s["revision"], s["stage"])
            if op["request"] is not None and outcome in ("saved", "advanced", "rewound", "granted", "committed"):
                self.seen.updateValue((op["request"],), (digest, outcome, s["revision"], s["stage"], at))
                due.add(at + self.ttl_ms)
        for expiry in sorted(due):
            self.handle.registerTimer(expiry)
        s["last"] = max(s["last"], *(op["seq"] for op in ops))
        self.state.update((json.dumps(s),))

    def step(self, key: str, s: dict, op: dict, at: int) -> str:
        """What an operation comes to; ``s`` is changed only where it is taken."""
        kind, expected, stage, target = (op[c] for c in ("kind", "expected", "stage", "target"))
        if op["seq"] <= s["last"]:
            return "late"
        if kind not in ("draft", "advance", "rewind", "preview", "commit"):
            return "unknown kind"
        if kind == "commit" and s["committed"] == s["revision"]:
            return "committed before"
        if expected != s["revision"]:
            return "stale revision"
        if kind == "preview":
            s |= {"token": token_of(key, s["revision"], s["body"]), "granted": s["revision"], "expires": at + self.token_ms}
            return "granted"
        if kind == "commit":
            if s["token"] is None or s["granted"] != s["revision"]:
                return "no preview"
            if op["token"] != s["token"]:
                return "wrong token"
            if at > s["expires"]:
                return "token expired"
            if s["done"] != list(range(1, STAGES + 1)):
                return "stage gate"
            s |= {"committed": s["revision"], "token": None}
            return "committed"
        if stage != s["stage"]:
            return "wrong stage"
        if kind == "rewind":
            if target is None or not 1 <= target <= s["stage"]:
                return "wrong target"
            s |= {"stage": target, "done": [x for x in s["done"] if x < target], "revision": s["revision"] + 1}
            return "rewound"
        if kind == "draft":
            body = op["body"] or ""
            done = [x for x in s["done"] if x < s["stage"]] if body != s["body"] else s["done"]
            s |= {"body": body, "done": done, "revision": s["revision"] + 1}
            return "saved"
        s |= {"done": list(range(1, s["stage"] + 1)), "stage": min(STAGES, s["stage"] + 1), "revision": s["revision"] + 1}
        return "advanced"

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs() - self.ttl_ms
        for (request,), told in list(self.seen.iterator()):
            if told[4] <= due:
                self.seen.removeKey((request,))
        yield from ()


class Snapshots(StatefulProcessor):
    """A snapshot is ready once all its parts have come with the digests that its plan names, and not before.

    Each call to the state is a trip to the JVM, so what a key has come to (plan, number and sum of its parts) is read and
    written once a batch, with the parts themselves while they are up to ``INLINE``; of larger snapshots a part is
    looked up by its own key, so that a batch costs by its rows, not by the parts held before.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "parts long, digest long, held long, total long, ready boolean, inline array<long>")
        self.parts = handle.getMapState("parts", "part long", "digest long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        ops = sorted(((r["seq"], r["kind"], r["parts"], r["part"], r["digest"]) for r in rows), key=lambda r: (r[0] is not None, r[0]))
        many, digest, held, total, ready, inline = before = tuple(self.state.get() or (None, None, 0, 0, False, []))
        known = dict(zip(inline[::2], inline[1::2], strict=True))
        stored, fresh = held > len(known), {}
        for seq, kind, parts, part, told in ops:
            if kind == "plan":
                if many is not None and (many, digest) != (parts, told):
                    outcome = "other plan"
                else:
                    many, digest, outcome = int(parts), int(told), "planned"
            elif ready:
                outcome = "closed"
            else:
                part, told = int(part), int(told)
                if part not in known and stored and (has := self.parts.getValue((part,))):
                    known[part] = has[0]
                outcome = "staged" if known.get(part, told) == told else "other content"
                if part not in known:
                    known[part] = fresh[part] = told
                    held, total = held + 1, (total + told) % (1 << 61)
            if outcome in ("planned", "staged") and many is not None and not ready and held == many:
                ready = total == digest
                outcome = "ready" if ready else "digests differ"
            yield OUTCOME(key[0], seq, outcome)
        if ready:  # its parts are asked for no more
            inline = []
            if stored:
                self.parts.clear()
        elif stored or held > INLINE:
            for part, told in (fresh if stored else known).items():
                self.parts.updateValue((part,), (told,))
            inline = []
        else:
            inline = [x for pair in known.items() for x in pair]
        now = (many, digest, held, total, ready, inline)
        if now != before:
            self.state.update(now)


def with_rocks(spark) -> None:
    """The state store that keyed state needs; a session that has chosen one keeps it."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)


def reviews(operations: DataFrame, ttl: str = "7 days", token: str = "15 minutes") -> DataFrame:
    """key, seq, outcome, revision, stage of every operation (columns as in ``OPERATIONS``; a stream)."""
    with_rocks(operations.sparkSession)
    spans = [int(pd.Timedelta(x).total_seconds() * 1000) for x in (ttl, token)]
    own = operations.filter(F.col("key").isNotNull() & F.col("seq").isNotNull() & F.col("at").isNotNull()).withWatermark("at", "1 hour")
    return own.groupBy("key").transformWithState(Reviews(*spans), OUTCOMES, "append", "eventTime")


def snapshots(operations: DataFrame) -> DataFrame:
    """key, seq, outcome of plans and parts (key, seq, kind, parts, part, digest; a stream)."""
    with_rocks(operations.sparkSession)
    return operations.groupBy("key").transformWithState(Snapshots(), "key string, seq long, outcome string", "append", "none")
