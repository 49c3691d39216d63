"""Queries of incremental state, rollups, selection and checks on tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import ranking
from .register import n, query, t


@query("""WITH c AS (SELECT user_id, event_type, ts, event_id, md5(props) AS h, lag(md5(props)) OVER w AS before, lag(ts) OVER w AS sealed FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, CASE WHEN before IS NULL THEN 'new' WHEN before IS DISTINCT FROM h THEN 'changed' WHEN ts - sealed >= INTERVAL 7 DAYS THEN 'expired' ELSE 'skip' END AS act FROM c""")
def container_checkpoint(spark, d):
    """Unchanged content is skipped for seven days after it was sealed."""
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = t(spark, d, "events").withColumn("h", F.md5("props"))
    rows = rows.select("event_id", "ts", "h", F.lag("h").over(w).alias("before"), F.lag("ts").over(w).alias("sealed"))
    act = F.when(F.col("before").isNull(), "new").when(F.col("before") != F.col("h"), "changed").when(F.col("ts") - F.col("sealed") >= F.expr("INTERVAL 7 DAYS"), "expired").otherwise("skip")
    return rows.select("event_id", act.alias("act"))


@query("""SELECT event_id, user_id, CASE WHEN k = event_id THEN 'kept' WHEN u = user_id THEN 'repeat' ELSE 'collapsed' END AS act, k AS first_event FROM
(SELECT event_id, user_id, min(event_id) OVER (PARTITION BY md5(props)) AS k, arg_min(user_id, event_id) OVER (PARTITION BY md5(props)) AS u FROM events)""")
def cross_run_dedupe(spark, d):
    """A content first seen under another user collapses the later ones; the state is one row a content."""
    rows = t(spark, d, "events").select("event_id", "user_id", F.md5("props").alias("h"))
    seen = rows.groupBy("h").agg(F.min("event_id").alias("k"), F.min_by("user_id", "event_id").alias("u"))
    act = F.when(F.col("k") == F.col("event_id"), "kept").when(F.col("u") == F.col("user_id"), "repeat").otherwise("collapsed")
    return rows.join(seen, "h").select("event_id", "user_id", act.alias("act"), F.col("k").alias("first_event"))


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS decision, count(*) AS attempts, count(DISTINCT props) > 1 AS conflict FROM events GROUP BY user_id, event_type""")
def decision_ledger(spark, d):
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("decision"), n().alias("attempts"), (F.count_distinct("props") > 1).alias("conflict"))


@query("""SELECT user_id, count(*) AS attempts, CAST(greatest(sum(CAST(round(value * 100) AS BIGINT)) - count(*) * 20000, 0) AS BIGINT) AS overrun, sum(CAST(round(value * 100) AS BIGINT)) > count(*) * 20000 AS blocked FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def overrun_reconcile(spark, d):
    """What the events used beyond 200 reserved for each."""
    over = F.sum(F.round(F.col("value") * 100).cast("long")) - n() * 20000
    return t(spark, d, "events").filter("value IS NOT NULL").groupBy("user_id").agg(n().alias("attempts"), F.greatest(over, F.lit(0)).alias("overrun"), (over > 0).alias("blocked"))


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name FROM lineitem l JOIN (SELECT p_partkey, p_name FROM part) p ON p.p_partkey = l.l_partkey WHERE l.l_returnflag = 'R'""")
def cache_fanout(spark, d):
    """One result a part goes to every line that refers to it."""
    return t(spark, d, "lineitem").filter("l_returnflag = 'R'").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query("""SELECT s.n_nationkey, s.suppliers, coalesce(c.customers, 0) AS customers, s.suppliers <= coalesce(c.customers, 0) AS covered FROM (SELECT n_nationkey, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) s
LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) c ON c.c_nationkey = s.n_nationkey""")
def kind_summary_zero_fill(spark, d):
    count = lambda name, key, out: t(spark, d, name).groupBy(F.col(key).alias("n_nationkey")).agg(n().alias(out))
    rows = t(spark, d, "nation").select("n_nationkey").join(count("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left").join(count("customer", "c_nationkey", "customers"), "n_nationkey", "left").fillna(0)
    return rows.withColumn("covered", F.col("suppliers") <= F.col("customers"))


@query("""SELECT source, list_sort(list(DISTINCT lang)) AS langs, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY source""")
def group_row_rollup(spark, d):
    return t(spark, d, "documents").filter("lang IS NOT NULL").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"), n().alias("docs"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first"))


@query("""WITH b AS (SELECT doc_id // 500 AS block, sha256(string_agg(doc_id || ':' || coalesce(sha256(text), '-'), ',' ORDER BY doc_id)) AS h, count(*) AS rows FROM documents GROUP BY 1),
s AS (SELECT block // 500 AS super, sha256(string_agg(block || ':' || h, ',' ORDER BY block)) AS h, sum(rows) AS rows FROM b GROUP BY 1)
SELECT sha256(string_agg(super || ':' || h, ',' ORDER BY super)) AS fingerprint, CAST(sum(rows) AS BIGINT) AS rows FROM s""")
def table_fingerprint(spark, d):
    """A digest of the rows in order by way of blocks, of 500 in levels until one is left, so that no list grows with the table."""
    level = t(spark, d, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("-")).alias("h"), F.lit(1).cast("long").alias("rows"))
    top, keys = level.agg(F.max("doc_id")).first()[0] or 0, ["doc_id", "block", "super"]
    while top // 500 ** len(keys):
        keys.append(f"super{len(keys)}")
    for key, up in zip(keys, [*keys[1:], "all"], strict=True):
        part = F.struct(F.col(key), F.concat(F.col(key).cast("string"), F.lit(":"), F.col("h")).alias("s"))
        digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p.s), ","), 256)
        group = F.lit(0) if up == "all" else F.expr(f"{key} div 500")
        level = level.groupBy(group.alias(up)).agg(digest.alias("h"), F.sum("rows").alias("rows"))
    return level.select(F.col("h").alias("fingerprint"), "rows")


@query("""SELECT regexp_replace(url, '[?#].*$', '') AS page_url, min(page_id) AS first_page, arg_min(html, page_id) IS NOT NULL AS has_body, count(*) AS uses, count(DISTINCT url) AS aliases FROM pages GROUP BY 1""")
def alias_first_row(spark, d):
    plain = F.regexp_replace("url", "[?#].*$", "").alias("page_url")
    return t(spark, d, "pages").groupBy(plain).agg(F.min("page_id").alias("first_page"), F.min_by(F.col("html").isNotNull(), "page_id").alias("has_body"), n().alias("uses"), F.count_distinct("url").alias("aliases"))


@query("""SELECT min(CASE WHEN quality = 1 THEN s END) AS least_good, max(CASE WHEN quality = 0 THEN s END) AS most_bad, floor(min(CASE WHEN quality = 1 THEN s END) * 100) / 100 AS lower_edge, (floor(max(CASE WHEN quality = 0 THEN s END) * 100) + 1) / 100 AS upper_edge,
count(*) FILTER (quality = 1 AND s >= 0.5) AS good_above, count(*) FILTER (quality = 0 AND s >= 0.5) AS bad_above FROM (SELECT quality, 1.0 * length(replace(text, ' ', '')) / length(text) AS s FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0)""")
def calibration_edges(spark, d):
    """The share of characters that aren't spaces as a score: its extremes by label and the edges of the band between them."""
    rows = t(spark, d, "documents").filter(F.length("text") > 0).join(t(spark, d, "labels"), "doc_id")
    rows = rows.select("quality", (F.length(F.translate("text", " ", "")).cast("double") / F.length("text")).alias("s"))
    good, bad, s = F.col("quality") == 1, F.col("quality") == 0, F.col("s")
    ends = rows.agg(F.min(F.when(good, s)).alias("least_good"), F.max(F.when(bad, s)).alias("most_bad"), F.count_if(good & (s >= 0.5)).alias("good_above"), F.count_if(bad & (s >= 0.5)).alias("bad_above"))
    return ends.withColumn("lower_edge", F.floor(F.col("least_good") * 100).cast("double") / 100).withColumn("upper_edge", (F.floor(F.col("most_bad") * 100) + 1).cast("double") / 100)


@query("""WITH g AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS members FROM orders GROUP BY 1) SELECT members, count(*) AS groups, min(o_custkey) AS first FROM g GROUP BY 1""")
def merged_by_member_set(spark, d):
    sets = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("members"))
    return sets.groupBy("members").agg(n().alias("groups"), F.min("o_custkey").alias("first"))


@query("""SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('seed-839:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 12""")
def seeded_order_sample(spark, d):
    """The first twelve of each source in the order of a seeded digest; partial top lists go before the exchange."""
    rows = t(spark, d, "documents").select("source", "doc_id", F.sha2(F.concat(F.lit("seed-839:"), F.col("doc_id").cast("string")), 256).alias("h"))
    place = F.row_number().over(W.partitionBy("source").orderBy("h", "doc_id"))
    return rows.withColumn("place", place).filter("place <= 12").select("source", "doc_id", F.col("place").cast("long").alias("place"))


@query("""SELECT c_custkey, (place - 1) // 3 AS batch, (place - 1) % 3 AS slot FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer)""")
def work_batches(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").isNull().alias("unknown"), (-F.col("c_acctbal")).alias("low"))
    return ranking.ranks(rows, [], ["unknown", "low", "c_custkey"], "place").selectExpr("c_custkey", "(place - 1) div 3 AS batch", "(place - 1) % 3 AS slot")


@query("""SELECT 'missing' AS side, count(*) AS rows FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, '-') FROM orders)
UNION ALL SELECT 'extra', count(*) FROM (SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, '-') FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)""")
def readback_diff(spark, d):
    """Rows that differ between a table and its rewritten form, both ways."""
    old = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = old.withColumn("o_orderstatus", F.coalesce("o_orderstatus", F.lit("-")))
    side = lambda rows, name: rows.agg(n().alias("rows")).select(F.lit(name).alias("side"), "rows")
    return side(old.exceptAll(new), "missing").unionByName(side(new.exceptAll(old), "extra"))


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'returned' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') THEN 'open' ELSE o_orderstatus END AS state FROM orders""")
def set_state_update(spark, d):
    """Two updates of rows in a set, the first one winning; one pass over the lines."""
    facts = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_linestatus") == "O").alias("o"))
    rows = t(spark, d, "orders").join(facts, "o_orderkey", "left")
    return rows.select("o_orderkey", "o_orderstatus", F.when(F.col("r"), "returned").when(F.col("o"), "open").otherwise(F.col("o_orderstatus")).alias("state"))


@query("""SELECT c_custkey AS doc_id, 'customer' AS kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = c_custkey) UNION ALL SELECT doc_id, 'document' FROM documents""")
def insert_if_absent(spark, d):
    docs = t(spark, d, "documents").select("doc_id")
    new = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id")).join(docs, "doc_id", "left_anti")
    return new.withColumn("kind", F.lit("customer")).unionByName(docs.withColumn("kind", F.lit("document")))


@query("""SELECT 'discount_range' AS rule, count(*) FILTER (l_discount < 0 OR l_discount > 1) AS violations FROM lineitem UNION ALL SELECT 'quantity_positive', count(*) FILTER (l_quantity <= 0) FROM lineitem
UNION ALL SELECT 'flag_known', count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem UNION ALL SELECT 'price_whole', count(*) FILTER (l_extendedprice IS NULL) FROM lineitem""")
def check_constraints(spark, d):
    """All rules in one pass, one row a rule."""
    rules = {"discount_range": "l_discount < 0 OR l_discount > 1", "quantity_positive": "l_quantity <= 0", "flag_known": "l_returnflag NOT IN ('A', 'N', 'R')", "price_whole": "l_extendedprice IS NULL"}
    counts = t(spark, d, "lineitem").agg(*[F.count_if(F.expr(r)).alias(k) for k, r in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing' WHEN NOT regexp_matches(json_extract_string(props, '$.k'), '^-?[0-9]+$') THEN 'type' ELSE 'valid' END AS verdict FROM events""")
def json_row_validation(spark, d):
    k = F.get_json_object("props", "$.k")
    return t(spark, d, "events").select("event_id", F.when(k.isNull(), "missing").when(~k.rlike("^-?[0-9]+$"), "type").otherwise("valid").alias("verdict"))


@query("""SELECT p_partkey, lower(trim(p_name)) AS family, count(*) OVER (PARTITION BY lower(trim(p_name))) AS members FROM part""")
def name_families(spark, d):
    """Every row with its family's size; the sizes are joined, so that a large family is counted before it moves."""
    rows = t(spark, d, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("family"))
    return rows.join(rows.groupBy("family").agg(n().alias("members")), "family").select("p_partkey", "family", "members")


@query("""SELECT page_id, host, path FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY page_id) AS r FROM pages) WHERE r = 1""")
def one_per_host(spark, d):
    """The canary: the first page of each host."""
    rows = t(spark, d, "pages").filter(X.http_url(F.col("url")).isNotNull()).select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    return rows.groupBy("host").agg(F.min_by(F.struct("page_id", "path"), "page_id").alias("p")).select("p.page_id", "host", "p.path")


@query("""SELECT CASE WHEN quality IS NULL THEN 'unprocessed' WHEN quality = 0 THEN 'changed' ELSE 'unchanged' END AS class, count(*) AS docs, max(doc_id) AS newest FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def backlog_classes(spark, d):
    kind = F.when(F.col("quality").isNull(), "unprocessed").when(F.col("quality") == 0, "changed").otherwise("unchanged")
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left").groupBy(kind.alias("class")).agg(n().alias("docs"), F.max("doc_id").alias("newest"))
