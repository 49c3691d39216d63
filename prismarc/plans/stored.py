"""Queries that write to sealed targets and stored tables and read back what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import postings, readback, reviews, tables
from ..operators.graph import shared_dir
from ..sources import sinks
from . import releases
from .register import n, query, t


def place(spark, name: str) -> str:
    """A new folder that all machines see."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""SELECT doc_id, lang, source, CAST(n_chars AS BIGINT) AS n_chars, sha256(text) AS sha256 FROM documents""")
def sealed_archive(spark, d):
    """Documents sealed as lines, sealed again in other files (adopted), and read back."""
    docs, path = t(spark, d, "documents"), place(spark, "archive")
    told = sinks.seal(docs, path)
    if sinks.seal(docs.repartition(5, "doc_id"), path) != told or not sinks.broken_files(spark, path).isEmpty():
        raise sinks.SealError("the archive isn't what was sealed")
    return sinks.read_sealed(spark, path).select("doc_id", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query("""SELECT sha256(html) AS sha256, CAST(max(octet_length(encode(html))) AS BIGINT) AS bytes, count(*) AS pages, min(page_id) AS first_page FROM pages WHERE html IS NOT NULL GROUP BY 1""")
def stored_payloads(spark, d):
    """Payloads kept once under their digests in two commits, and the pages that refer to each."""
    pages, path = t(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content")), place(spark, "objects")
    sinks.store_objects(pages.filter("page_id % 3 > 0"), "content", path)
    sinks.store_objects(pages, "content", path)
    uses = pages.filter("content IS NOT NULL").groupBy(F.sha2("content", 256).alias("sha256")).agg(n().alias("pages"), F.min("page_id").alias("first_page"))
    return sinks.stored_objects(spark, path).join(uses, "sha256").select("sha256", "bytes", "pages", "first_page")


@query("""SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer""")
def sqlite_shards(spark, d):
    """Customers in databases by key range, read back."""
    path = place(spark, "index")
    rows = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    sinks.seal(rows.repartitionByRange("c_custkey"), path, "sealed_sqlite", key="c_custkey")
    return spark.read.format("sealed_sqlite").load(path)


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(lang) ELSE lang END AS lang, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS sha256, CAST(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS batch FROM documents
UNION ALL SELECT doc_id + 1000000000, lang, sha256(coalesce(text, '')), 2 FROM documents WHERE doc_id % 11 = 0""")
def merged_table(spark, d):
    """A stored table after an import, an upsert of changed contents that brings new keys, and a replay of the first batch."""
    docs, path = t(spark, d, "documents"), place(spark, "table")
    first = docs.select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.lit(1).cast("long").alias("batch"))
    fifth = F.col("doc_id") % 5 == 0
    later = docs.filter("doc_id % 5 < 2").select("doc_id", F.when(fifth, F.upper("lang")).otherwise(F.col("lang")).alias("lang"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(fifth, "!").otherwise("")), 256).alias("sha256"), F.lit(2).cast("long").alias("batch"))
    fresh = first.filter("doc_id % 11 = 0").withColumns({"doc_id": F.col("doc_id") + 1_000_000_000, "batch": F.lit(2).cast("long")})
    tables.create(spark, path, first.schema, ["doc_id"])
    tables.merge(spark, path, first, batch="one")
    tables.merge(spark, path, later.unionByName(fresh), when="t.sha256 IS DISTINCT FROM s.sha256", batch="two")
    tables.merge(spark, path, first, batch="one")
    return tables.read(spark, path)


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), c AS (SELECT count(*) FILTER (k % 2 = 0) AS even, count(*) FILTER (k % 2 = 1) AS odd, count(*) FILTER (k % 2 = 0 AND k % 3 = 0) AS third FROM o)
SELECT 1 AS step, 'even' AS batch, CAST(1 AS BIGINT) AS version, false AS replayed, even AS inserted, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS unchanged FROM c
UNION ALL SELECT 2, 'every', 2, false, odd, third, even - third FROM c UNION ALL SELECT 3, 'even', 2, true, 0, 0, 0 FROM c UNION ALL SELECT 4, 'same', 2, false, 0, 0, even + odd FROM c""")
def import_batches(spark, d):
    """What four imports did: a new one, one that changes and adds rows, a replay, and one that changes nothing."""
    orders, path = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), place(spark, "imports")
    later = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderstatus", F.lit("*"))).otherwise(F.col("o_orderstatus")))
    tables.create(spark, path, orders.schema, ["o_orderkey"])
    even = orders.filter("o_orderkey % 2 = 0")
    steps = [("even", even), ("every", later), ("even", even), ("same", later)]
    told = [(i + 1, batch, tables.merge(spark, path, rows, batch=batch)) for i, (batch, rows) in enumerate(steps)]
    rows = [(i, batch, r["version"], r["replayed"], r["inserted"], r["updated"], r["unchanged"]) for i, batch, r in told]
    return spark.createDataFrame(rows, "step int, batch string, version long, replayed boolean, inserted long, updated long, unchanged long")


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (user_id % 3 = 0) AS a, count(*) FILTER (user_id % 3 = 1) AS b, count(*) FILTER (user_id % 3 = 2) AS c, quantile_disc(1, 0.5) AS x FROM events GROUP BY 1),
cap AS (SELECT CAST(max(a + b) AS BIGINT) AS top FROM c),
x AS (SELECT day, b, c, top, CASE WHEN a BETWEEN 1 AND top THEN a ELSE 0 END AS n FROM c, cap),
y AS (SELECT day, c, top, CASE WHEN b > 0 AND n + b <= top THEN n + b ELSE n END AS n FROM x)
SELECT day, CAST(CASE WHEN c > 0 AND n + c <= top THEN n + c ELSE n END AS BIGINT) AS n FROM y WHERE CASE WHEN c > 0 AND n + c <= top THEN n + c ELSE n END > 0""".replace(", quantile_disc(1, 0.5) AS x", ""))
def guarded_days(spark, d):
    """Daily sums in a stored table, raised in three batches as long as the day stays within the cap (the most that the first two take)."""
    e, path = t(spark, d, "events"), place(spark, "days")
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    cap = e.filter("user_id % 3 < 2").groupBy(day).agg(n().alias("n")).agg(F.max("n")).first()[0] or 0
    tables.create(spark, path, e.select(day, F.lit(0).cast("long").alias("n")).schema, ["day"], 8)
    for part in range(3):
        sums = e.filter(F.col("user_id") % 3 == part).groupBy(day).agg(n().alias("n"))
        tables.merge(spark, path, sums, when=f"t.n + s.n <= {cap}", values={"n": "t.n + s.n"}, insert=f"s.n <= {cap}", batch=f"part {part}")
    return tables.read(spark, path)


@query("""SELECT doc_id, CASE WHEN doc_id % 97 = 3 THEN 'missing' ELSE 'changed' END AS state FROM documents WHERE doc_id % 97 = 3 OR doc_id % 50 = 0
UNION ALL SELECT doc_id + 1000000000, 'extra' FROM documents WHERE doc_id % 89 = 0""")
def differing_rows(spark, d):
    """What a copy of the documents lacks, has more or otherwise: found by digests, level by level."""
    docs, path = t(spark, d, "documents").select("doc_id", "lang", "text"), place(spark, "compared")
    copy = docs.filter("doc_id % 97 <> 3").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text")))
    more = docs.filter("doc_id % 89 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    for name, rows in (("left", docs), ("right", copy.unionByName(more))):
        readback.stage(rows, f"{path}/{name}", ["doc_id"])
    return readback.differences(spark, f"{path}/left", f"{path}/right", docs.schema, ["doc_id"])[0]


@query("""SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0""")
def flipped_store(spark, d):
    """Two stores published one after the other, each read back and compared first; readers see the second."""
    docs, root = t(spark, d, "documents").select("doc_id", "lang"), place(spark, "root")
    readback.publish(docs, root, ["doc_id"])
    readback.publish(docs.filter("doc_id % 2 = 0"), root, ["doc_id"])
    return spark.read.schema(docs.schema).parquet(f"{readback.current(spark, root)}/{readback.ROWS}").select(*docs.columns)


_AND = "list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'and', 'of'])"


def indexed(spark, d) -> str:
    """A fresh index of the documents."""
    path = place(spark, "postings")
    postings.build(t(spark, d, "documents"), path)
    return path


@query(f"SELECT DISTINCT doc_id FROM documents WHERE {_AND}")
def indexed_and_search(spark, d):
    """``lexical_and_search`` by the index."""
    return postings.with_all(spark, indexed(spark, d), ["the", "and", "of"]).withColumnRenamed("id", "doc_id")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)
SELECT doc_id, count(*) AS score FROM w WHERE token IN ('the', 'and', 'of') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 25""")
def indexed_top(spark, d):
    """The 25 documents in which three tokens stand most often, by block maxima."""
    return postings.top(spark, indexed(spark, d), ["the", "and", "of"], 25).withColumnRenamed("id", "doc_id")


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)
SELECT doc_id, bool_or(starts_with(token, 'sch')) AS begins, bool_or(contains(token, 'schkeit')) AS holds FROM w WHERE starts_with(token, 'sch') OR contains(token, 'schkeit') GROUP BY doc_id""")
def indexed_parts(spark, d):
    """Documents with a token that begins with a string, or holds another."""
    path = indexed(spark, d)
    begins, holds = postings.containing(spark, path, "sch", prefix=True), postings.containing(spark, path, "schkeit")
    both = begins.withColumn("begins", F.lit(True)).join(holds.withColumn("holds", F.lit(True)), "id", "full")
    return both.select(F.col("id").alias("doc_id"), F.coalesce("begins", F.lit(False)).alias("begins"), F.coalesce("holds", F.lit(False)).alias("holds"))


@query(releases.COLLAPSED)
def indexed_collapsed(spark, d):
    """``collapsed_search`` with its word and its part of a word from the index: texts are read for their groups only."""
    path = indexed(spark, d)
    hits = postings.with_any(spark, path, ["and"]).unionByName(postings.containing(spark, path, "schkeit")).distinct().select(F.col("id").alias("doc_id"), F.lit(True).alias("found"))
    docs = t(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))  # no text goes into the joins
    rows = docs.join(t(spark, d, "labels"), "doc_id", "left").join(hits, "doc_id", "left")
    hit = F.coalesce("found", F.lit(False)) | F.coalesce((F.col("quality") == 1) & (F.col("lang") == "es"), F.lit(False))
    items = rows.select("doc_id", "h", (F.coalesce("toxic", F.lit(0)) != 1).alias("visible"), hit.alias("hit"))
    return reviews.collapsed(items, "doc_id", "h", "hit", "visible")
