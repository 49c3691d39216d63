"""Queries on retrieval evaluation, search checks, request plans, listings and usage audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import normalise as N
from ..operators import vectors
from .register import n, query, t


def _sql_ranks(sizes: tuple[int, ...]) -> str:
    lanes = " UNION ALL ".join(f"SELECT {k} AS dims, vec_id, label, CAST(embedding[1:{k}] AS DOUBLE[]) AS e FROM embeddings" for k in sizes)
    return f"""WITH v AS ({lanes}), s AS (SELECT q.dims, q.vec_id AS query_id, v.vec_id, v.label = q.label AS hit, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON v.dims = q.dims WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY dims, query_id ORDER BY score DESC, vec_id) AS rank FROM s) """


def prefix_ranks(spark, d, sizes: tuple[int, ...], k: int) -> DataFrame:
    """dims, query_id, vec_id, hit, rank of the k nearest by each prefix of the vectors."""
    v = t(spark, d, "embeddings")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("ql"))
    out = None
    for size in sizes:
        part = v.select("vec_id", "label", F.slice("embedding", 1, size).alias("embedding"))
        near = vectors.nearest(part, part.filter("vec_id % 100 = 0"), k).join(own, "query_id").select(F.lit(size).cast("long").alias("dims"), "query_id", "vec_id", (F.col("label") == F.col("ql")).alias("hit"), "rank")
        out = near if out is None else out.unionByName(near)
    return out


def reciprocal(hit: Column, rank: Column) -> Column:
    return F.coalesce(1.0 / F.min(F.when(hit, rank)), F.lit(0.0))


@query(_sql_ranks((16, 32, 64)) + """, m AS (SELECT dims, query_id, cut, CAST(sum(CASE WHEN hit AND rank <= cut THEN 1 ELSE 0 END) AS DOUBLE) / cut AS p, coalesce(1.0 / min(CASE WHEN hit AND rank <= cut THEN rank END), 0) AS rr FROM k, (VALUES (1), (3), (5)) a(cut) GROUP BY dims, query_id, cut)
SELECT dims, CAST(cut AS BIGINT) AS cutoff, round(avg(p), 6) AS precision, round(avg(rr), 6) AS mrr FROM m GROUP BY dims, cut""")
def arm_dimensions(spark, d):
    """Precision and reciprocal rank at 1, 3 and 5 by prefix length."""
    ranks = prefix_ranks(spark, d, (16, 32, 64), 5).select("*", F.explode(F.array(*[F.lit(x) for x in (1, 3, 5)])).alias("cutoff"))
    hit = F.col("hit") & (F.col("rank") <= F.col("cutoff"))
    by = ranks.groupBy("dims", "query_id", "cutoff").agg((F.count_if(hit) / F.first("cutoff")).alias("p"), reciprocal(hit, F.col("rank")).alias("rr"))
    return by.groupBy("dims", F.col("cutoff").cast("long").alias("cutoff")).agg(F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("rr"), 6).alias("mrr"))


@query(_sql_ranks((16, 64)) + """, m AS (SELECT dims, query_id, sum(CASE WHEN hit AND rank <= 5 THEN 1 ELSE 0 END) / 5 AS recall, coalesce(1.0 / min(CASE WHEN hit AND rank <= 5 THEN rank END), 0) AS rr FROM k GROUP BY ALL),
a AS (SELECT avg(CASE WHEN dims = 16 THEN recall END) AS c, avg(CASE WHEN dims = 64 THEN recall END) AS b, avg(CASE WHEN dims = 16 THEN rr END) AS cm, avg(CASE WHEN dims = 64 THEN rr END) AS bm, count(DISTINCT query_id) AS queries FROM m)
SELECT round(c, 6) AS compact_recall, round(b, 6) AS baseline_recall, round(cm, 6) AS compact_mrr, round(bm, 6) AS baseline_mrr, b - c <= 0.1 AND bm - cm <= 0.1 AS passed, queries FROM a""")
def lane_canary(spark, d):
    """A compact lane against the baseline: mean recall and reciprocal rank, and whether the drop stays within a tenth."""
    ranks = prefix_ranks(spark, d, (16, 64), 5)
    m = ranks.groupBy("dims", "query_id").agg((F.count_if("hit") / 5).alias("recall"), reciprocal(F.col("hit"), F.col("rank")).alias("rr"))
    lane = lambda c, k: F.avg(F.when(F.col("dims") == k, F.col(c)))
    a = m.agg(lane("recall", 16).alias("c"), lane("recall", 64).alias("b"), lane("rr", 16).alias("cm"), lane("rr", 64).alias("bm"), F.count_distinct("query_id").alias("queries"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return a.select(r("c", "compact_recall"), r("b", "baseline_recall"), r("cm", "compact_mrr"), r("bm", "baseline_mrr"), ((F.col("b") - F.col("c") <= 0.1) & (F.col("bm") - F.col("cm") <= 0.1)).alias("passed"), "queries")


@query("""WITH a AS (SELECT 'all' AS arm, vec_id FROM embeddings UNION ALL SELECT 'even', vec_id FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'moved', vec_id + 1 FROM embeddings)
SELECT arm, count(*) AS items, CAST(sum(CASE WHEN e.vec_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown, count(e.vec_id) = (SELECT count(*) FROM embeddings) AND count(*) = (SELECT count(*) FROM embeddings) AS complete FROM a LEFT JOIN embeddings e ON a.vec_id = e.vec_id GROUP BY arm""")
def arm_completeness(spark, d):
    """An arm takes part only if its ids are exactly those of the manifest."""
    v = t(spark, d, "embeddings").select("vec_id")
    arm = lambda df, name: df.select(F.lit(name).alias("arm"), "vec_id")
    arms = arm(v, "all").unionByName(arm(v.filter("vec_id % 2 = 0"), "even")).unionByName(arm(v.select((F.col("vec_id") + 1).alias("vec_id")), "moved"))
    met = arms.join(v.select("vec_id", F.lit(True).alias("known")), "vec_id", "left").groupBy("arm").agg(n().alias("items"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return met.join(F.broadcast(v.agg(n().alias("manifest")))).select("arm", "items", "unknown", ((F.col("unknown") == 0) & (F.col("items") == F.col("manifest"))).alias("complete"))  # one row


_GROUPS = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(v.label AS BIGINT) AS label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
g AS (SELECT query_id, label, max(score) AS score, min(CASE WHEN score = m THEN vec_id END) AS vec_id FROM (SELECT *, max(score) OVER (PARTITION BY query_id, label) AS m FROM s) GROUP BY query_id, label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM g) """


@query(_GROUPS + "SELECT query_id, label, score, vec_id, rank FROM r WHERE rank <= 5")
def full_corpus_search(spark, d):
    """The five nearest groups of every stored query, each by its best member, over all vectors."""
    v = t(spark, d, "embeddings")
    return vectors.nearest_groups(v, v.filter("vec_id % 100 = 0"), 5)


@query(_GROUPS + """, p AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, label) AS rank FROM (SELECT q.vec_id AS query_id, CAST(v.label AS BIGINT) AS label, max(round(list_cosine_similarity(CAST(q.embedding[1:32] AS DOUBLE[]), CAST(v.embedding[1:32] AS DOUBLE[])), 6)) AS m FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 GROUP BY ALL))
SELECT r.query_id, r.label, r.score FROM r LEFT JOIN (SELECT * FROM p WHERE rank <= 5) x ON x.query_id = r.query_id AND x.label = r.label WHERE r.rank <= 5 AND r.score > 0.2 + 0.000002 AND x.label IS NULL""")
def search_verification(spark, d):
    """Groups above the cutoff that a search by half the dimensions misses; the exact search is the judge."""
    v = t(spark, d, "embeddings")
    q = v.filter("vec_id % 100 = 0")
    half = v.select("vec_id", "label", F.slice("embedding", 1, 32).alias("embedding"))
    need = vectors.nearest_groups(v, q, 5).filter(F.col("score") > 0.2 + 0.000002)
    found = vectors.nearest_groups(half, half.filter("vec_id % 100 = 0"), 5)
    return need.join(found.select("query_id", "label"), ["query_id", "label"], "left_anti").select("query_id", "label", "score")


@query("""SELECT doc_id AS query_id, CASE WHEN doc_id % 100 = 0 AND e.vec_id IS NOT NULL THEN 'stored' WHEN doc_id % 3 = 0 THEN 'cached' ELSE 'provider' END AS origin, CASE WHEN doc_id % 100 = 0 THEN e.vec_id END AS vec_id FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id AND doc_id % 100 = 0""")
def query_vectors(spark, d):
    """Where the vector of a request comes from: a stored query, the cache, or else a call that costs."""
    stored = t(spark, d, "embeddings").filter("vec_id % 100 = 0").select("vec_id")
    asked = t(spark, d, "documents").select(F.col("doc_id").alias("query_id"))
    met = asked.join(stored, F.col("query_id") == F.col("vec_id"), "left")
    return met.select("query_id", F.when(F.col("vec_id").isNotNull(), "stored").when(F.col("query_id") % 3 == 0, "cached").otherwise("provider").alias("origin"), "vec_id")


@query("""WITH r AS (SELECT 'item:' || p_partkey || ':' || arm AS key, 100 AS units FROM part, (VALUES ('image'), ('joint')) a(arm) UNION ALL SELECT 'query:' || s_suppkey % 10 || ':' || provider, 10 FROM supplier, (VALUES ('p1'), ('p2'), ('p3')) b(provider))
SELECT split_part(key, ':', 1) AS kind, count(*) AS logical, count(DISTINCT sha256(key)) AS unique_requests, CAST(sum(units) AS BIGINT) AS units FROM r GROUP BY 1""")
def request_plan(spark, d):
    """Items by arms and queries by providers, keyed by a digest of what they ask: logical and unique requests."""
    key = lambda *c: F.concat_ws(":", *c)
    items = t(spark, d, "part").select(F.lit("item").alias("kind"), F.explode(F.array(F.lit("image"), F.lit("joint"))).alias("arm"), F.col("p_partkey").cast("string").alias("id"), F.lit(100).alias("units"))
    asked = t(spark, d, "supplier").select(F.lit("query").alias("kind"), F.explode(F.array(*[F.lit(f"p{i}") for i in (1, 2, 3)])).alias("arm"), (F.col("s_suppkey") % 10).cast("string").alias("id"), F.lit(10).alias("units"))
    by = items.unionByName(asked).select("kind", F.sha2(key("kind", "id", "arm"), 256).alias("key"), "units").groupBy("kind", "key").agg(n().alias("often"), F.sum("units").alias("units"))
    return by.groupBy("kind").agg(F.sum("often").alias("logical"), n().alias("unique_requests"), F.sum("units").alias("units"))


# joins and aggregates

_PAIRS = "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON "


@query(f"SELECT * FROM ({_PAIRS} a.vec_id < b.vec_id) WHERE score >= 0.35")
def all_pairs(spark, d):
    """All pairs of a cosine of 0.35 or more, in packed blocks."""
    v = t(spark, d, "embeddings")
    return vectors.pairs_above(v, v, 0.35)


@query(f"SELECT *, CASE WHEN right_id % 100 = 0 THEN 'new-new' ELSE 'new-old' END AS side FROM ({_PAIRS} a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND (b.vec_id % 100 <> 0 OR a.vec_id < b.vec_id)) WHERE score >= 0.25")
def incremental_tiles(spark, d):
    """Incoming vectors against the old ones and among themselves; old pairs aren't compared again."""
    v = t(spark, d, "embeddings")
    new, old = v.filter("vec_id % 100 = 0"), v.filter("vec_id % 100 <> 0")
    met = vectors.pairs_above(new, old, 0.25).withColumn("side", F.lit("new-old"))
    return met.unionByName(vectors.pairs_above(new, new, 0.25).withColumn("side", F.lit("new-new")))


@query("""SELECT l_orderkey, string_agg(l_linenumber || ':' || o_orderstatus || ':' || coalesce(p_name, '?'), ' ' ORDER BY l_linenumber, l_partkey) AS terms FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def taxonomy_terms(spark, d):
    """Assignments by a composite key, their terms in the order of their numbers."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    met = t(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_linenumber", "l_partkey").join(o, ["l_orderkey", "l_linestatus"]).join(p, "l_partkey", "left")
    own = met.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_linestatus", F.coalesce("p_name", F.lit("?")).alias("term")))).alias("a"))
    return own.select("l_orderkey", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x.l_linenumber.cast("string"), x.l_linestatus, x.term)), " ").alias("terms"))


@query("""WITH i AS (SELECT doc_id, sha256(text) AS f, doc_id % 10 = 0 AS frozen FROM documents WHERE text IS NOT NULL)
SELECT f AS file, count(*) AS members, CAST(sum(CASE WHEN frozen THEN 1 ELSE 0 END) AS BIGINT) AS keepers, CASE WHEN sum(CASE WHEN frozen THEN 1 ELSE 0 END) > 1 THEN 'conflict' WHEN sum(CASE WHEN frozen THEN 1 ELSE 0 END) = 1 THEN 'alias' ELSE 'new' END AS route FROM i GROUP BY f HAVING count(*) > 1""")
def keeper_routing(spark, d):
    """Groups of exact copies by their frozen keepers: one takes the others as aliases, several contradict each other."""
    i = t(spark, d, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("file"), (F.col("doc_id") % 10 == 0).alias("frozen"))
    g = i.groupBy("file").agg(n().alias("members"), F.count_if("frozen").alias("keepers")).filter("members > 1")
    return g.withColumn("route", F.when(F.col("keepers") > 1, "conflict").when(F.col("keepers") == 1, "alias").otherwise("new"))


@query("""SELECT p.page_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN d.source = 'web' THEN 'hash' WHEN d.n_chars % 2 = 0 THEN 'key' ELSE 'unknown' END AS matched_by FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id""")
def manifest_lookup(spark, d):
    """Items enriched by their full identity, else by their key alone; what has drifted stays unknown."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("by_key"), F.col("source").alias("s"), "n_chars")
    strict = docs.filter("s = 'web'").select("page_id", F.lit(True).alias("by_hash"))
    loose = docs.filter("n_chars % 2 = 0").select("page_id", "by_key")
    met = t(spark, d, "pages").select("page_id").join(strict, "page_id", "left").join(loose, "page_id", "left")
    return met.select("page_id", F.when(F.col("by_hash"), "hash").when(F.col("by_key"), "key").otherwise("unknown").alias("matched_by"))


@query("""WITH d AS (SELECT * FROM (VALUES ('ECONOMY'), ('STANDARD'), ('nothing')) d(category))
SELECT coalesce(category, 'unclassified') AS category, count(DISTINCT p_brand) AS groups FROM (SELECT d.category, p.p_brand FROM d LEFT JOIN part p ON p.p_type = d.category UNION ALL SELECT NULL, p_brand FROM part WHERE p_type NOT IN (SELECT category FROM d)) GROUP BY 1""")
def category_counts(spark, d):
    """Distinct groups of every defined category, and those of no category as unclassified."""
    known = ["ECONOMY", "STANDARD", "nothing"]
    p = t(spark, d, "part").select(F.when(F.col("p_type").isin(known), F.col("p_type")).otherwise("unclassified").alias("category"), "p_brand").distinct()
    counts = p.groupBy("category").agg(n().alias("found"))
    defined = spark.range(1).select(F.explode(F.array(*map(F.lit, [*known, "unclassified"]))).alias("category"))
    return defined.join(counts, "category", "left").select("category", F.coalesce("found", F.lit(0)).alias("groups"))


@query("""WITH u AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS total, CAST(round(value * 40) AS BIGINT) AS cached, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(round(value * 10) AS BIGINT) END AS output FROM events)
SELECT user_id, count(*) AS turns, CAST(sum(CASE WHEN output IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(total) AS BIGINT) AS total, CASE WHEN count(output) = count(*) THEN CAST(sum(output) AS BIGINT) END AS output, bool_and(cached <= total AND coalesce(output, 0) <= total) AS sound FROM u GROUP BY user_id""")
def usage_audit(spark, d):
    """Counters of every session: parts may not exceed totals, and a sum with a missing part is unknown."""
    cents = lambda x: F.round(F.col("value") * x).cast("long")
    u = t(spark, d, "events").select("user_id", cents(100).alias("total"), cents(40).alias("cached"), F.when(F.col("event_id") % 50 != 0, cents(10)).alias("output"))
    sound = F.every((F.col("cached") <= F.col("total")) & (F.coalesce("output", F.lit(0)) <= F.col("total")))
    return u.groupBy("user_id").agg(n().alias("turns"), F.count_if(F.col("output").isNull()).alias("missing"), F.sum("total").alias("total"), F.when(F.count("output") == n(), F.sum("output")).alias("output"), sound.alias("sound"))


@query("""WITH e AS (SELECT DISTINCT o_orderkey AS style FROM orders), s AS (SELECT l_suppkey AS session, l_orderkey AS style, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
c AS (SELECT style, count(*) AS k FROM s GROUP BY style)
SELECT session, count(*) AS styles, round(sum(q), 2) AS quantity, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated, CAST(sum(CASE WHEN e.style IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unexpected FROM s JOIN c ON c.style = s.style LEFT JOIN e ON e.style = s.style GROUP BY session""")
def session_cover(spark, d):
    """Sessions that should cover the expected ids once each: what they sum to, repeat and hold unasked."""
    s = t(spark, d, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("session"), F.col("l_orderkey").alias("style")).agg(F.sum("l_quantity").alias("q"))
    c = s.groupBy("style").agg(n().alias("k"))
    e = t(spark, d, "orders").select(F.col("o_orderkey").alias("style"), F.lit(True).alias("expected")).distinct()
    met = s.join(c, "style").join(e, "style", "left")
    return met.groupBy("session").agg(n().alias("styles"), F.round(F.sum("q"), 2).alias("quantity"), F.count_if(F.col("k") > 1).alias("repeated"), F.count_if(F.col("expected").isNull()).alias("unexpected"))


@query("""SELECT conv_id, turn, count(*) AS receipts, count(DISTINCT sha256(role || ':' || coalesce(text, ''))) = 1 AS consistent FROM (SELECT * FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, turn, role, text || '!' FROM conversations WHERE conv_id % 5 = 0) GROUP BY conv_id, turn""")
def turn_receipts(spark, d):
    """Receipts of a turn count once; the same turn with other content is a contradiction."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    rows = c.unionByName(c.filter("conv_id % 3 = 0")).unionByName(c.filter("conv_id % 5 = 0").withColumn("text", F.concat("text", F.lit("!"))))
    h = F.sha2(F.concat_ws(":", "role", F.coalesce("text", F.lit(""))), 256)
    return rows.groupBy("conv_id", "turn").agg(n().alias("receipts"), (F.min(h) == F.max(h)).alias("consistent"))


# order and pages


def clamped(limit: int | None, offset: int | None, most: int = 100) -> tuple[int, int]:
    """A limit of 1 to ``most`` and an offset of 0 or more."""
    return max(1, min(most, 20 if limit is None else int(limit))), max(0, int(offset or 0))


#: Sort keys by name; nulls come last whatever the direction, the id breaks ties.
SORTS = {
    "newest": [F.desc_nulls_last, "o_orderdate"], "oldest": [F.asc_nulls_last, "o_orderdate"], "dearest": [F.desc_nulls_last, "o_totalprice"], "cheapest": [F.asc_nulls_last, "o_totalprice"],
    "priority": [F.asc_nulls_last, "o_orderpriority"], "customer": [F.asc_nulls_last, "o_custkey"], "state": [F.asc_nulls_last, "o_orderstatus"], "id": [F.asc_nulls_last, "o_orderkey"],
}


def page(rows: DataFrame, sort: str, limit: int | None, offset: int | None) -> DataFrame:
    direction, column = SORTS[sort]
    most, skipped = clamped(limit, offset)
    return rows.orderBy(direction(column), "o_orderkey").offset(skipped).limit(most)


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort, o_orderkey FROM orders ORDER BY {v}, o_orderkey LIMIT 24 OFFSET 24)" for k, v in (("newest", "o_orderdate DESC"), ("dearest", "o_totalprice DESC"), ("priority", "o_orderpriority"), ("customer", "o_custkey"))) + " UNION ALL SELECT * FROM (SELECT 'clamped', o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100)")
def sort_menu(spark, d):
    """The second page of 24 by each of several sorts, and a page whose limit and offset are out of bounds."""
    o = t(spark, d, "orders")
    out = page(o, "id", 5000, -3).select(F.lit("clamped").alias("sort"), "o_orderkey")
    for name in ("newest", "dearest", "priority", "customer"):
        out = out.unionByName(page(o, name, 24, 24).select(F.lit(name).alias("sort"), "o_orderkey"))
    return out


@query("""WITH g AS (SELECT p_brand, count(*) AS variants, max(p_retailprice) AS price FROM part GROUP BY 1)
SELECT * FROM (SELECT 'variants' AS sort, p_brand, row_number() OVER (ORDER BY variants DESC, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT)) AS place FROM g UNION ALL SELECT 'number', p_brand, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT)) FROM g) WHERE place <= 24""")
def gallery_orders(spark, d):
    """The first 24 groups by number of variants, and by the number in their name; a row a group, of which there are few."""
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("long")
    g = t(spark, d, "part").groupBy("p_brand").agg(n().alias("variants"))
    out = lambda name, *order: g.orderBy(*order).limit(24).select(F.lit(name).alias("sort"), "p_brand", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))
    return out("variants", F.desc("variants"), number).unionByName(out("number", number))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_id % 4 = 1 THEN '2020-01-01 00:00:00' END AS arrival, CASE event_id % 4 WHEN 0 THEN 'arrival_at' WHEN 1 THEN 'collected_at' ELSE 'ordinal' END AS basis FROM events""")
def arrival_basis(spark, d):
    """The first valid one of the timestamps, else the row's place; basis says which."""
    k = F.col("event_id") % 4
    keys = {"arrival_at": F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon"), "ingested_at": F.lit(None).cast("string"), "collected_at": F.when(k <= 1, "2020-01-01 00:00:00")}
    told = F.filter(F.array(*[F.struct(F.try_to_timestamp(v, F.lit("yyyy-MM-dd HH:mm:ss")).alias("at"), F.lit(name).alias("basis")) for name, v in keys.items()]), lambda x: x["at"].isNotNull())
    first = F.get(told, 0)
    return t(spark, d, "events").select("event_id", F.date_format(first["at"], "yyyy-MM-dd HH:mm:ss").alias("arrival"), F.coalesce(first["basis"], F.lit("ordinal")).alias("basis"))
