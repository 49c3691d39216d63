"""Sinks and fetches that talk to a store or a host: checked copies, polite fetches, bounded intakes, shards found by an index."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import ranks


class Folder:
    """A store on a folder that all machines see; an object comes by a rename, so it is whole or not there."""

    def __init__(self, path: str) -> None:
        self.path = path

    def get(self, key: str) -> bytes | None:
        try:
            with open(os.path.join(self.path, key), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, key: str, body: bytes) -> None:
        place = os.path.join(self.path, key)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        draft = f"{place}.{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            f.write(body)
        os.replace(draft, place)


def copied(rows: DataFrame, content: str, factory: Callable[[], object], prefix: str = "", suffix: str = "") -> DataFrame:
    """key, status, bytes, sha256 of every distinct content, put under its digest and read back.

    An object that is there and sound is ``reused_verified``, else it is put and must read back alike (``uploaded_verified``);
    another object under the key, or another readback, fails the job.  ``factory`` gives a task its store (get and put).
    A task that runs again finds its own objects and says reused.
    """
    once = rows.filter(F.col(content).isNotNull()).select(F.col(content).cast("binary").alias("body"))
    once = once.withColumn("sha256", F.sha2("body", 256)).dropDuplicates(["sha256"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = factory()
        for batch in batches:
            out = []
            for body, digest in zip(batch["body"], batch["sha256"], strict=True):
                key = f"{prefix}{digest}{suffix}"
                held, status = store.get(key), "reused_verified"
                if held is None:
                    store.put(key, bytes(body))
                    held, status = store.get(key), "uploaded_verified"
                if held is None or hashlib.sha256(held).hexdigest() != digest:
                    raise RuntimeError(f"{'conflict' if status[0] == 'r' else 'readback mismatch'}: {key}")
                out.append((key, status, len(held), digest))
            yield pd.DataFrame(out, columns=["key", "status", "bytes", "sha256"])

    return once.mapInPandas(run, "key string, status string, bytes long, sha256 string")


def fetched(urls: DataFrame, factory: Callable[[], object], keep: Callable[[], object] | None = None, per_second: float = 1000.0, tries: int = 3, least_free: int = 0, room: str = "/", done: DataFrame | None = None) -> DataFrame:
    """url, host, state, bytes, sha256: receipts of one call for every distinct url.

    All urls of a host are in one task, one after the other and ``per_second`` at most, so a host never has two requests at once;
    that politeness, not the engine, bounds the largest host.  An OSError is tried again, then ``failed``; a PermissionError (403, 429)
    stops its host (``stopped``).  Below ``least_free`` bytes on ``room`` the rest is ``no room``.  Bodies go to the store ``keep``
    under their digest, receipts are the result: write them and pass them as ``done`` to leave out what was fetched before.
    """
    asked = urls.select("url").filter("url IS NOT NULL").distinct()
    if done is not None:
        asked = asked.join(done.filter("state = 'fetched'").select("url"), "url", "left_anti")
    hosts = asked.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, store = factory(), keep() if keep else None
        host, last, refused = None, 0.0, False
        for batch in batches:
            out = []
            for url, at in zip(batch["url"], batch["host"], strict=True):
                if at != host:
                    host, last, refused = at, 0.0, False
                body, state = None, "stopped"
                if shutil.disk_usage(room).free < least_free:
                    state = "no room"
                elif not refused:
                    for _ in range(tries):
                        time.sleep(max(0.0, last + 1 / per_second - time.monotonic()))
                        last = time.monotonic()
                        try:
                            body, state = client.get(url), "fetched"
                            break
                        except PermissionError:
                            refused, state = True, "stopped"
                            break
                        except OSError:
                            state = "failed"
                digest = hashlib.sha256(body).hexdigest() if body is not None else None
                if store and body is not None:
                    store.put(digest, body)
                out.append((url, at, state, None if body is None else len(body), digest))
            frame = pd.DataFrame(out, columns=["url", "host", "state", "bytes", "sha256"])
            frame["bytes"] = frame["bytes"].astype("Int64")
            yield frame

    return hosts.repartition("host").sortWithinPartitions("host", "url").mapInPandas(run, "url string, host string, state string, bytes long, sha256 string")


def intake(containers: DataFrame, checkpoint: DataFrame, parse: Callable[[str], tuple[list[str], bool]], now: str, most: int = 20, days: int = 7) -> DataFrame:
    """source, path, sha, state, sha256, items of the containers that one run takes, source by source in order.

    ``containers`` has source, path, sha, body; ``checkpoint`` source, path, sha, sealed_at.  Those sealed with the same sha within ``days`` are
    unchanged and left out.  ``most`` containers are read in a run, the rest waits for the next: that bound is the feature.
    ``parse`` gives the items and whether it got all: ``completed`` or ``incomplete``; where it raises a ValueError the container is
    ``failed`` and the rest of its source waits, without holding up other sources.  Only completed ones may enter the checkpoint (``sealed``).

    Every source with waiting containers has one read, so the first ``most`` sources and ``most`` containers of each suffice: one task of bounded size.
    """
    fresh = checkpoint.filter((F.col("sealed_at") > F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("sealed_at") <= F.to_timestamp(F.lit(now))))
    waiting = containers.filter("source IS NOT NULL AND path IS NOT NULL").join(fresh.select("source", "path", "sha").distinct(), ["source", "path", "sha"], "left_anti")
    sources = waiting.select("source").distinct().orderBy("source").limit(most)
    # the rank filter is taken before the shuffle, too, so a hot source costs ``most`` rows a partition
    nth = F.row_number().over(Window.partitionBy("source").orderBy("path", "sha"))
    chosen = waiting.select("source", "path", "sha", "body").join(F.broadcast(sources), "source").withColumn("__n", nth).filter(F.col("__n") <= most).drop("__n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, failed, out = 0, set(), []
        for batch in batches:
            for source, path, sha, body in zip(*(batch[c] for c in ("source", "path", "sha", "body")), strict=True):
                if source in failed or read == most:
                    continue
                read += 1
                try:
                    items, whole = parse(body or "")
                    state = "completed" if whole else "incomplete"
                except ValueError:
                    failed.add(source)
                    items, state = [], "failed"
                out.append((source, path, sha, state, hashlib.sha256((body or "").encode()).hexdigest(), items))
        yield pd.DataFrame(out, columns=["source", "path", "sha", "state", "sha256", "items"])

    return chosen.coalesce(1).sortWithinPartitions("source", "path", "sha").mapInPandas(run, "source string, path string, sha string, state string, sha256 string, items array<string>")


def sealed(checkpoint: DataFrame, taken: DataFrame, now: str) -> DataFrame:
    """The checkpoint after a run: what it completed, and the rest as it was."""
    fresh = taken.filter("state = 'completed'").select("source", "path", "sha", F.to_timestamp(F.lit(now)).alias("sealed_at"))
    return checkpoint.select("source", "path", "sha", "sealed_at").join(fresh, ["source", "path"], "left_anti").unionByName(fresh)


def write_shards(rows: DataFrame, path: str, key: str, size: int = 500) -> None:
    """Rows in the order of ``key`` (unique) in shards of ``size``, one folder each, and an index of key and shard beside them."""
    placed = ranks(rows, [], [key], "__n").withColumn("shard", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")
    placed.repartition("shard").write.partitionBy("shard").parquet(f"{path}/shards")
    spark = rows.sparkSession
    spark.read.parquet(f"{path}/shards").select(key, "shard").write.parquet(f"{path}/index")


def from_shards(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``keys``: the index names their shards, and no other shard is read where the names prune the scan."""
    found = spark.read.parquet(f"{path}/index").join(keys.select(key).distinct(), key)
    shards = spark.read.parquet(f"{path}/shards")
    return shards.join(found, [key, "shard"], "left_semi")
