"""Queries that run as streams: keyed state over restarts, and tables that follow one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import finds
from ..operators import tables
from ..streaming import feeds, machines
from .register import n, query, t
from .stored import place


def in_batches(machine: Callable[[DataFrame], DataFrame], *batches: DataFrame) -> DataFrame:
    """What a stream gives for one batch after another; for each the query is started anew from its checkpoint."""
    spark = batches[0].sparkSession
    path = place(spark, "stream")
    for i, rows in enumerate(batches):
        rows.write.parquet(f"{path}/in/b{i}")
        stream = machine(spark.readStream.schema(rows.schema).parquet(f"{path}/in/*"))
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("""WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
p AS (SELECT conv_id, i, i % 3 AS k, CASE WHEN i % 5 = 0 THEN -1 ELSE i - 1 - (i - 1) // 5 END AS expected, CASE WHEN i % 3 = 0 THEN 2 ELSE 1 END AS own FROM o),
f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS rev, CAST(1 AS BIGINT) AS st, '' AS outcome FROM p
UNION ALL SELECT f.conv_id, p.i, CASE WHEN ok THEN rev + 1 ELSE rev END, CASE WHEN ok AND p.k = 2 THEN least(4, st + 1) WHEN ok AND p.k = 0 THEN 1 ELSE st END,
  CASE WHEN expected <> rev THEN 'stale revision' WHEN own <> st THEN 'wrong stage' ELSE ['rewound', 'saved', 'advanced'][p.k + 1] END
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.i = f.i + 1, LATERAL (SELECT expected = rev AND own = st AS ok))
SELECT CAST(conv_id AS VARCHAR) AS key, i AS seq, outcome, rev AS revision, st AS stage FROM f WHERE i > 0""")
def reviewed_drafts(spark, d):
    """Turns as operations on drafts, in two batches with a restart between them."""
    c = t(spark, d, "conversations").withColumn("i", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    i, k = F.col("i"), F.col("i") % 3
    ops = c.select(
        F.col("conv_id").cast("string").alias("key"), i.alias("seq"), F.when(k == 0, "rewind").when(k == 1, "draft").otherwise("advance").alias("kind"), F.concat(F.lit("r"), i.cast("string")).alias("request"),
        F.when(i % 5 == 0, -1).otherwise(i - 1 - F.floor((i - 1) / 5)).cast("long").alias("expected"), F.when(k == 0, 2).otherwise(1).cast("long").alias("stage"), F.lit(1).cast("long").alias("target"),
        F.lit(None).cast("string").alias("token"), F.col("text").alias("body"), F.timestamp_seconds(F.lit(1_700_000_000) + i * 60).alias("at"),
    )
    return in_batches(machines.reviews, ops.filter("seq <= 3"), ops.filter("seq > 3"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS many FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS key, i AS seq, CASE WHEN i < many THEN 'staged' WHEN o_custkey % 4 = 0 THEN 'digests differ' ELSE 'ready' END AS outcome FROM o
UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 0, 'planned' FROM o""")
def staged_snapshots(spark, d):
    """A customer's orders as the parts of a snapshot: plans and some parts first, the rest after a restart."""
    o = t(spark, d, "orders")
    digest = F.pmod(F.col("o_orderkey") * 7919, F.lit(1 << 40))
    parts = o.withColumn("i", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
    none = F.lit(None).cast("long")
    own = parts.select(F.col("o_custkey").cast("string").alias("key"), F.col("i").alias("seq"), F.lit("part").alias("kind"), none.alias("parts"), F.col("o_orderkey").cast("long").alias("part"), digest.cast("long").alias("digest"))
    told = o.groupBy(F.col("o_custkey").cast("string").alias("key")).agg(n().alias("parts"), (F.sum(digest) + F.when(F.max("o_custkey") % 4 == 0, 1).otherwise(0)).cast("long").alias("digest"))
    plans = told.select("key", F.lit(0).cast("long").alias("seq"), F.lit("plan").alias("kind"), "parts", none.alias("part"), "digest")
    return in_batches(machines.snapshots, plans.unionByName(own.filter("seq <= 2")), own.filter("seq > 2"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 10 <> 9
UNION ALL SELECT doc_id, 'last', n_chars FROM documents WHERE doc_id % 10 = 9""")
def followed_table(spark, d):
    """A table that follows another through a stream of its changes: an import, then updates, deletions and rows that come back."""
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    source, target = place(spark, "source"), place(spark, "target")
    for p in (source, target):
        tables.create(spark, p, docs.schema, ["doc_id"], 16)
    tables.merge(spark, source, docs)
    feeds.mirrored(spark, source, target, f"{target}-offsets")
    tables.merge(spark, source, docs.filter("doc_id % 3 = 0").withColumn("lang", F.lit("again")))
    tables.merge(spark, source, docs.filter("doc_id % 7 = 0 OR doc_id % 10 = 9").withColumn("gone", F.lit(True)), delete_by="gone")
    tables.merge(spark, source, docs.filter("doc_id % 10 = 9").withColumn("lang", F.lit("last")))
    feeds.mirrored(spark, source, target, f"{target}-offsets")
    return tables.read(spark, target)


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS g FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS session FROM e)
SELECT user_id, CAST(session AS INTEGER) AS session, count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM s GROUP BY user_id, session""")
def table_sessions(spark, d):
    """Sessions by a table function over ordered partitions."""
    finds.register(spark)
    rows = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = spark.sql("SELECT * FROM sessions_of(TABLE(SELECT * FROM {rows}) PARTITION BY user_id ORDER BY (ts), 360)", rows=rows)
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("user_id", "session", "rows", day("first"), day("last"))
