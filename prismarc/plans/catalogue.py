"""The registered queries and their SQL, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import graph, ranking, vectors
from ..streaming import windows
from . import evaluation, families, fields, ledgers, links, media, projections, releases, reviews, states, stored, streams, texts
from .register import n, oracle_sql, queries, query, t

__all__ = ["evaluation", "families", "fields", "flagship", "ledgers", "links", "media", "oracle_sql", "projections", "queries", "reviews", "states", "stored", "streams", "texts"]

# groups of equal rows


@query("""SELECT 'exact-' || substr(sha256(text), 1, 24) AS group_id, count(*) AS members, min(doc_id) AS representative
FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1""")
def exact_group_rollup(spark, d):
    rows = t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return graph.representatives(rows, "digest", "doc_id").select(X.group_id("exact", F.col("digest")).alias("group_id"), "members", "representative")


@query("""SELECT * FROM (SELECT substr(sha256(text), 1, 24) AS digest, doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS representative,
count(*) OVER (PARTITION BY sha256(text)) AS members FROM documents WHERE text IS NOT NULL) WHERE members > 1""")
def exact_group_members(spark, d):
    rows = t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    groups = graph.representatives(rows, "digest", "doc_id")
    return rows.join(groups, "digest").select(F.substring("digest", 1, 24).alias("digest"), "doc_id", "representative", "members")


@query(r"""WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '\[[^\[\]]*\]|\{[^{}]*\}|[0-9]+', ' <var> ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS h FROM documents)
SELECT substr(h, 1, 24) AS template, count(*) AS members, min(doc_id) AS representative FROM k GROUP BY h HAVING count(*) > 1""")
def same_template_groups(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.sha2(X.template(F.col("text")), 256).alias("h"))
    return graph.representatives(rows, "h", "doc_id").select(F.substring("h", 1, 24).alias("template"), "members", "representative")


@query("""SELECT source, sha256(text) AS digest, lang, count(*) AS members FROM documents WHERE text IS NOT NULL GROUP BY source, lang, sha256(text) HAVING count(*) > 1""")
def composite_key_groups(spark, d):
    return t(spark, d, "documents").filter("text IS NOT NULL").groupBy("source", "lang", F.sha2("text", 256).alias("digest")).agg(n().alias("members")).filter("members > 1")


@query("""WITH g AS (SELECT doc_id, CASE WHEN l.quality = 1 THEN 160 ELSE 0 END + CASE WHEN l.toxic = 0 THEN 140 ELSE 0 END + CASE WHEN l.doc_id IS NOT NULL THEN 40 ELSE 0 END
 - CASE WHEN n_chars < 200 THEN 20 ELSE 0 END AS score, sha256(text) AS h FROM documents LEFT JOIN labels l USING (doc_id))
SELECT substr(h, 1, 24) AS digest, arg_max(doc_id, CAST(score AS BIGINT) * 1000000000 - doc_id) AS keeper, max(score) AS score, count(*) AS members FROM g GROUP BY h HAVING count(*) > 1""")
def keeper_score(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    score = F.when(F.col("quality") == 1, 160).otherwise(0) + F.when(F.col("toxic") == 0, 140).otherwise(0) + F.when(F.col("known"), 40).otherwise(0) - F.when(F.col("n_chars") < 200, 20).otherwise(0)
    scored = rows.select("doc_id", score.alias("score"), F.sha2("text", 256).alias("h"))
    best = scored.groupBy("h").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("keeper"), F.max("score").alias("score"), n().alias("members"))
    return best.filter("members > 1").select(F.substring("h", 1, 24).alias("digest"), "keeper", "score", "members")


@query(r"""WITH RECURSIVE h AS (SELECT doc_id, sha256(text) AS x, sha256(trim(regexp_replace(regexp_replace(lower(text), '\[[^\[\]]*\]|\{[^{}]*\}|[0-9]+', ' <var> ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS y FROM documents),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS a, min(doc_id) OVER (PARTITION BY y) AS b FROM h),
e AS (SELECT doc_id AS u, a AS v FROM m WHERE a <> doc_id UNION SELECT doc_id, b FROM m WHERE b <> doc_id),
f AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS node, u AS seen FROM f UNION SELECT r.node, f.v FROM r JOIN f ON r.seen = f.u)
SELECT node, min(seen) AS root FROM r GROUP BY node""")
def connected_components(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("x"), F.sha2(X.template(F.col("text")), 256).alias("y"))
    rows = graph.written(rows)  # the texts are read and hashed once for both kinds of star
    stars = [rows.join(rows.groupBy(k).agg(F.min("doc_id").alias("least")), k).filter("doc_id <> least").select("doc_id", "least") for k in ("x", "y")]
    return graph.components(stars[0].unionByName(stars[1]).distinct(), "doc_id", "least")


@query("""SELECT b.item_id, count(d.doc_id) AS copies FROM benchmark b LEFT JOIN documents d ON sha256(trim(lower(b.text))) = sha256(trim(lower(d.text))) GROUP BY b.item_id""")
def cross_set_exact(spark, d):
    key = lambda c: F.sha2(F.trim(F.lower(c)), 256)
    counts = t(spark, d, "documents").groupBy(key("text").alias("h")).agg(n().alias("copies"))
    items = t(spark, d, "benchmark").select("item_id", key("text").alias("h"))
    return items.join(counts, "h", "left").select("item_id", F.coalesce("copies", F.lit(0)).alias("copies"))


# projections and predicates


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'P4' WHEN c_acctbal >= 5000 AND c_mktsegment = 'BUILDING' THEN 'P1' WHEN c_acctbal >= 5000 THEN 'P2' ELSE 'P3' END AS tier,
c_acctbal >= 5000 AS visible FROM customer""")
def tier_decision(spark, d):
    rich = F.col("c_acctbal") >= 5000
    tier = F.when(F.col("c_acctbal") < 0, "P4").when(rich & (F.col("c_mktsegment") == "BUILDING"), "P1").when(rich, "P2").otherwise("P3")
    return t(spark, d, "customer").select("c_custkey", tier.alias("tier"), rich.alias("visible"))


@query(r"""SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN nullif(substr(trim(regexp_replace(d.text, '[ \t\n\r]+', ' ', 'g')), 1, 120), '') END AS public_text,
coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0""")
def public_projection(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").filter("coalesce(toxic, 0) = 0")
    gate = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return rows.select("doc_id", "source", F.when(gate, X.bounded(F.col("text"), 120)).alias("public_text"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query(r"""SELECT page_id, CASE WHEN lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%' THEN url END AS public_url,
CASE WHEN url IS NULL OR url = '' THEN 'missing' WHEN lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%' OR lower(url) LIKE 'data:%' THEN 'remote' ELSE 'local' END AS uri_kind,
regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def url_projection(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", X.http_url(u).alias("public_url"), X.uri_kind(u).alias("uri_kind"), F.regexp_extract(u, "^https?://([^/?#]+)", 1).alias("host"))


@query(r"""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n, count(DISTINCT url) AS urls FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 20""")
def remote_inventory_top(spark, d):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")
    return t(spark, d, "pages").groupBy(host).agg(n().alias("n"), F.count_distinct("url").alias("urls")).orderBy(F.desc("n"), "host").limit(20)


@query("""WITH r(prefix, allow) AS (VALUES ('/', true), ('/en', false), ('/en/2', true), ('/fr', false), ('/de/1', false)),
p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT p.page_id, coalesce(arg_max(allow, length(prefix) * 2 + CASE WHEN allow THEN 1 ELSE 0 END), true) AS allowed FROM p LEFT JOIN r ON starts_with(path, prefix) GROUP BY p.page_id""")
def robots_longest_match(spark, d):
    rules = spark.createDataFrame([("/", True), ("/en", False), ("/en/2", True), ("/fr", False), ("/de/1", False)], "prefix string, allow boolean")
    paths = t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    met = paths.join(F.broadcast(rules), F.expr("startswith(path, prefix)"), "left")  # five rules
    return met.groupBy("page_id").agg(F.coalesce(F.max_by("allow", F.struct(F.length("prefix"), "allow")), F.lit(True)).alias("allowed"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_pointer(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k IS NOT NULL")


@query("""SELECT DISTINCT o.o_orderkey, o.o_orderpriority FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity >= 45 AND l.l_returnflag = 'R'""")
def facet_consistent_members(spark, d):
    one = t(spark, d, "lineitem").filter("l_quantity >= 45 AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").join(one, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("""SELECT doc_id, octet_length(encode(text)) AS n_bytes, length(text) AS n_code_points, sha256(text) AS sha, md5(text) AS md5 FROM documents WHERE text IS NOT NULL""")
def text_digests(spark, d):
    return t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_code_points"), F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query()
def git_blob_digests(spark, d):
    return t(spark, d, "documents").select("doc_id", X.git_blob_sha1(F.col("text")).alias("blob_sha1"))


@query("""WITH g AS (SELECT item_id, CASE WHEN length(text) = 0 THEN [] WHEN length(text) < 3 THEN [text] ELSE list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, CAST(i AS INTEGER), 3))) END AS s FROM benchmark),
p AS (SELECT a.item_id AS left_id, b.item_id AS right_id, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS x, len(b.s) AS y FROM g a JOIN g b ON b.item_id = a.item_id + 1)
SELECT left_id, right_id, round(i / nullif(x + y - i, 0), 6) AS jaccard FROM p""")
def char3_jaccard(spark, d):
    g = t(spark, d, "benchmark").select("item_id", X.char_ngrams(F.col("text")).alias("s"))
    a, b = g.toDF("left_id", "a"), g.toDF("right_id", "b")
    return a.join(b, F.col("right_id") == F.col("left_id") + 1).select("left_id", "right_id", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


# joins


@query("""WITH s AS (SELECT l_orderkey, max(l_partkey) AS seventh FROM lineitem WHERE l_linenumber = 7 GROUP BY 1), f AS (SELECT l_orderkey, arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS first FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(seventh, first) AS part, CASE WHEN seventh IS NOT NULL THEN 'given' WHEN first IS NOT NULL THEN 'fallback' ELSE 'none' END AS basis FROM orders LEFT JOIN s ON o_orderkey = s.l_orderkey LEFT JOIN f ON o_orderkey = f.l_orderkey""")
def fallback_asset_join(spark, d):
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_linenumber") == 7, F.col("l_partkey"))).alias("seventh"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first"))
    basis = F.when(F.col("seventh").isNotNull(), "given").when(F.col("first").isNotNull(), "fallback").otherwise("none")
    return t(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("seventh", "first").alias("part"), basis.alias("basis"))


@query("""SELECT c_custkey, c_name, n_name, r_name, count(o_orderkey) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def multiway_join(spark, d):
    orders = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n().alias("orders"))
    places = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, "c_custkey", "left")
    return rows.select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""SELECT doc_id FROM documents WHERE (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR contains(lower(text), 'license') OR lang = 'es')
AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def hybrid_semi_anti(spark, d):
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    hits = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id")
    hits = hits.unionByName(docs.filter("contains(lower(text), 'license') OR lang = 'es'").select("doc_id")).distinct()
    return hits.join(labels.filter("toxic = 1"), "doc_id", "left_anti")


@query("""SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'and', 'of'])""")
def lexical_and_search(spark, d):
    found = X.tokens(F.col("text"))
    return t(spark, d, "documents").filter(F.size(F.array_intersect(found, F.array(*map(F.lit, ("the", "and", "of"))))) == 3).select("doc_id")


@query("""WITH o AS (SELECT user_id, max(event_id) AS last FROM events WHERE ts < '2024-01-16' GROUP BY 1), i AS (SELECT user_id, max(event_id) AS last FROM events WHERE ts >= '2024-01-16' GROUP BY 1)
SELECT coalesce(i.user_id, o.user_id) AS user_id, coalesce(i.last, o.last) AS last, CASE WHEN o.last IS NULL THEN 'new' WHEN i.last IS NULL THEN 'retained' ELSE 'refreshed' END AS state FROM o FULL JOIN i USING (user_id)""")
def queue_merge(spark, d):
    e = t(spark, d, "events")
    side = lambda c, name: e.filter(c).groupBy("user_id").agg(F.max("event_id").alias(name))
    both = side("ts < '2024-01-16'", "old").join(side("ts >= '2024-01-16'", "now"), "user_id", "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "retained").otherwise("refreshed")
    return both.select("user_id", F.coalesce("now", "old").alias("last"), state.alias("state"))


@query("""SELECT CAST(sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(DISTINCT l_suppkey) AS used FROM lineitem LEFT JOIN (SELECT s_suppkey AS s FROM supplier) ON l_suppkey = s""")
def coverage_partition(spark, d):
    used = t(spark, d, "lineitem").groupBy("l_suppkey").agg(n().alias("n"))
    met = used.join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("there")), "l_suppkey", "left")
    return met.agg(F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("missing"), n().alias("used"))


# aggregates


@query("""SELECT user_id, CASE WHEN count(v) = count(*) THEN sum(v) END AS complete, coalesce(sum(v), 0) AS known, count(*) - count(v) AS unknown
FROM (SELECT user_id, CASE WHEN event_id % 97 <> 0 THEN CAST(value * 100 AS BIGINT) END AS v FROM events) GROUP BY user_id""")
def null_masked_totals(spark, d):
    v = F.when(F.col("event_id") % 97 != 0, F.round(F.col("value") * 100).cast("long"))
    rows = t(spark, d, "events").select("user_id", v.alias("v"))
    return rows.groupBy("user_id").agg(X.null_masked_sum(F.col("v")).alias("complete"), F.coalesce(F.sum("v"), F.lit(0)).alias("known"), (n() - F.count("v")).alias("unknown"))


@query("""SELECT lang, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n_chars, 0.95) AS BIGINT) AS p95, CAST(max(n_chars) AS BIGINT) AS most, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY lang""")
def nearest_rank_percentiles(spark, d):
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n_chars)").cast("long")
    return t(spark, d, "documents").groupBy("lang").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("n_chars").cast("long").alias("most"), F.sum("n_chars").alias("total"))


@query("""SELECT CAST(th AS BIGINT) AS threshold, count(*) AS pairs, CAST(sum(quality) AS BIGINT) AS positives, count(*) - CAST(sum(quality) AS BIGINT) AS negatives, round(sum(quality) / count(*), 6) AS rate
FROM labels JOIN documents USING (doc_id), (SELECT unnest([100, 500, 1000, 2000, 5000]) AS th) WHERE n_chars >= th GROUP BY th""")
def threshold_sweep(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    swept = rows.withColumn("threshold", F.explode(F.array(*[F.lit(x).cast("long") for x in (100, 500, 1000, 2000, 5000)]))).filter("n_chars >= threshold")
    pos = F.sum("quality")
    return swept.groupBy("threshold").agg(n().alias("pairs"), pos.alias("positives"), (n() - pos).alias("negatives"), F.round(pos / n(), 6).alias("rate"))


@query("""SELECT CASE WHEN n_chars < 500 THEN 'a' WHEN n_chars < 1500 THEN 'b' WHEN n_chars < 3000 THEN 'c' ELSE 'd' END AS bin, count(*) FILTER (quality = 1 AND toxic = 0) AS good, count(*) FILTER (toxic = 1) AS toxic,
count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def label_histogram(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    c = F.col("n_chars")
    return rows.groupBy(F.when(c < 500, "a").when(c < 1500, "b").when(c < 3000, "c").otherwise("d").alias("bin")).agg(
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled")
    )


@query("""SELECT lower(source) AS facet, count(DISTINCT lang) AS groups, min(source) AS shown, count(*) AS docs FROM documents GROUP BY lower(source) HAVING count(DISTINCT lang) >= 2""")
def facet_counts(spark, d):
    return t(spark, d, "documents").groupBy(F.lower("source").alias("facet")).agg(F.count_distinct("lang").alias("groups"), F.min("source").alias("shown"), n().alias("docs")).filter("groups >= 2")


@query("""SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source""")
def lane_state_pivot(spark, d):
    return t(spark, d, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().na.fill(0)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_states(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(n().alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_states(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(n().alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query()
def approximate_distinct(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.expr("approx_percentile(l_quantity, 0.5)").alias("median"))


@query("""SELECT (row_number - 1) // 500 AS shard, count(*) AS rows, min(doc_id) AS first, max(doc_id) AS last, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS row_number FROM documents WHERE doc_id % 3 <> 1) GROUP BY 1""")
def fixed_size_shards(spark, d):
    """Shards of 500 rows each in the order of the key, whatever gaps it has; the rows are numbered over range partitions."""
    rows = t(spark, d, "documents").filter("doc_id % 3 <> 1").select("doc_id", "text", F.lit(0).alias("all"))
    return ranking.ranks(rows, ["all"], ["doc_id"], "r").groupBy(F.expr("(r - 1) div 500").alias("shard")).agg(n().alias("rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum(F.octet_length("text")).alias("bytes"))


# windows


@query("""SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_key(spark, d):
    best = F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("b")
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(best).select("user_id", "event_type", "b.event_id", "b.ts")


@query("""SELECT props, arg_min(user_id, event_id) AS first_user, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY props""")
def first_occurrence_ledger(spark, d):
    return t(spark, d, "events").groupBy("props").agg(F.min_by("user_id", "event_id").alias("first_user"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), n().alias("n"))


@query("""SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) - lag(CAST(round(value * 100) AS BIGINT), 1, 0) OVER w AS delta,
coalesce(value < lag(value) OVER w, false) AS reset FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def cumulative_delta(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("long")
    return t(spark, d, "events").select("event_id", "user_id", (cents - F.lag(cents, 1, 0).over(w)).alias("delta"), F.coalesce(F.col("value") < F.lag("value").over(w), F.lit(False)).alias("reset"))


@query("""SELECT conv_id, bracket, count(*) AS turns, min(turn) AS first_turn FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS bracket FROM conversations) GROUP BY ALL""")
def turn_brackets(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("bracket"))
    return rows.groupBy("conv_id", "bracket").agg(n().alias("turns"), F.min("turn").alias("first_turn"))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type""")
def consecutive_duplicate_drop(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").withColumn("b", F.lag("event_type").over(w)).filter("NOT (b <=> event_type)").select("event_id", "user_id", "event_type")


@query("""SELECT event_id, sha256(CAST(event_id AS VARCHAR) || ':' || coalesce(CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR), '')) AS link FROM events""")
def hash_chain(spark, d):
    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    return t(spark, d, "events").select("event_id", F.sha2(F.concat(F.col("event_id").cast("string"), F.lit(":"), F.coalesce(before.cast("string"), F.lit(""))), 256).alias("link"))


@query("""SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 3 ELSE 2 END, n_chars DESC, doc_id) AS BIGINT) AS rank_index FROM documents LEFT JOIN labels USING (doc_id)""")
def priority_rank(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")
    tier = F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 3).otherwise(2)
    keyed = rows.select("doc_id", "source", tier.alias("tier"), (-F.col("n_chars")).alias("short"))
    return ranking.ranks(keyed, ["source"], ["tier", "short", "doc_id"], "rank_index").select("doc_id", "source", "rank_index")


@query("""SELECT user_id, session, count(*) AS events, min(ts) AS began FROM (SELECT *, CAST(sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, session""")
def sessions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t(spark, d, "events").withColumn("g", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS"), 0).otherwise(1))
    return rows.withColumn("session", F.sum("g").over(w)).groupBy("user_id", "session").agg(n().alias("events"), F.min("ts").alias("began"))


# order and pages


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def paged_listing_with_total(spark, d):
    rows = t(spark, d, "orders").filter("o_orderstatus = 'F'")
    page = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")
    return page.join(F.broadcast(rows.agg(n().alias("total"))))  # one row


@query("""SELECT c_custkey, c_name, base64(encode(CAST(c_custkey AS VARCHAR))) AS cursor FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 26""")
def keyset_page(spark, d):
    page = t(spark, d, "customer").filter("c_custkey > 100").orderBy("c_custkey").limit(26)
    return page.select("c_custkey", "c_name", F.base64(F.encode(F.col("c_custkey").cast("string"), "UTF-8")).alias("cursor"))


@query("""SELECT doc_id, source, r FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id)) AS r FROM documents) ORDER BY r, source LIMIT 50""")
def round_robin_selection(spark, d):
    r = F.row_number().over(W.partitionBy("source").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)))
    return t(spark, d, "documents").select("doc_id", "source", r.cast("long").alias("r")).filter("r <= 50").orderBy("r", "source").limit(50)  # no source gives more than the limit


@query("""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('11:' || doc_id)) AS r FROM documents) WHERE r <= 3""")
def stratified_quota_sample(spark, d):
    r = F.row_number().over(W.partitionBy("source", "lang").orderBy(F.sha2(F.concat(F.lit("11:"), F.col("doc_id").cast("string")), 256)))
    return t(spark, d, "documents").select("doc_id", "source", "lang", r.alias("r")).filter("r <= 3").drop("r")


# sets


@query("""SELECT k, 'both' AS side FROM (SELECT user_id AS k FROM events WHERE ts < '2024-01-10' INTERSECT SELECT user_id FROM events WHERE ts >= '2024-01-20')
UNION ALL SELECT k, 'old' FROM (SELECT props AS k FROM events WHERE ts < '2024-01-10' EXCEPT SELECT props FROM events WHERE ts >= '2024-01-20')""".replace("SELECT k, 'both'", "SELECT CAST(k AS VARCHAR) AS k, 'both'"))
def setop_versions(spark, d):
    e = t(spark, d, "events")
    old, new = e.filter("ts < '2024-01-10'"), e.filter("ts >= '2024-01-20'")
    both = old.select(F.col("user_id").cast("string").alias("k")).intersect(new.select(F.col("user_id").cast("string"))).withColumn("side", F.lit("both"))
    gone = old.select(F.col("props").alias("k")).subtract(new.select("props"))
    return both.unionByName(gone.withColumn("side", F.lit("old")))


@query("""SELECT * FROM (SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT l_linestatus, count(*) FROM lineitem GROUP BY 1)""")
def union_lanes(spark, d):
    a = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(n().alias("n"))
    return a.unionByName(t(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("state")).agg(n().alias("n")))


# state and ledgers


@query("""WITH o AS (SELECT user_id, event_type, max(props) AS v FROM events WHERE ts < '2024-01-16' GROUP BY ALL), i AS (SELECT user_id, event_type, max(props) AS v FROM events WHERE ts >= '2024-01-16' GROUP BY ALL)
SELECT i.user_id, i.event_type, CASE WHEN o.v IS NULL THEN 'new' WHEN o.v = i.v THEN 'unchanged' ELSE 'changed' END AS state FROM i LEFT JOIN o ON i.user_id = o.user_id AND i.event_type = o.event_type""")
def version_watermark(spark, d):
    e = t(spark, d, "events")
    side = lambda c, name: e.filter(c).groupBy("user_id", "event_type").agg(F.max("props").alias(name))
    met = side("ts >= '2024-01-16'", "now").join(side("ts < '2024-01-16'", "then"), ["user_id", "event_type"], "left")
    return met.select("user_id", "event_type", F.when(F.col("then").isNull(), "new").when(F.col("then") == F.col("now"), "unchanged").otherwise("changed").alias("state"))


@query("""SELECT event_id, day, spent, spent <= 3000 AS allowed FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS BIGINT) AS spent FROM events)""")
def budget_running_cap(spark, d):
    """Spent of a day's budget so far, and whether it holds; a day's events of a type may be any number."""
    cents = F.round(F.col("value") * 100).cast("long")
    rows = t(spark, d, "events").select("event_id", "ts", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), cents.alias("cents"))
    return ranking.running_sums(rows, ["day", "event_type"], ["ts", "event_id"], "cents", "spent").select("event_id", "day", "spent", (F.col("spent") <= 3000).alias("allowed"))


@query("""SELECT user_id, coalesce(max(CASE WHEN event_type = 'click' THEN c END), 0) AS reserved, coalesce(max(CASE WHEN event_type = 'purchase' THEN c END), 0) AS actual,
greatest(coalesce(max(CASE WHEN event_type = 'click' THEN c END), 0), coalesce(max(CASE WHEN event_type = 'purchase' THEN c END), 0)) AS charged
FROM (SELECT user_id, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY user_id""")
def ledger_fold(spark, d):
    c = F.round(F.col("value") * 100).cast("long")
    most = lambda kind: F.coalesce(F.max(F.when(F.col("event_type") == kind, c)), F.lit(0).cast("long"))
    return t(spark, d, "events").groupBy("user_id").agg(most("click").alias("reserved"), most("purchase").alias("actual")).withColumn("charged", F.greatest("reserved", "actual"))


@query("""SELECT coalesce(o.o_orderkey, n.o_orderkey) AS k, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'keep' WHEN o.h IS DISTINCT FROM n.h THEN 'update' ELSE 'same' END AS act
FROM (SELECT o_orderkey, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN
(SELECT o_orderkey, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 5 <> 0) n ON o.o_orderkey = n.o_orderkey""")
def conditional_upsert(spark, d):
    o = t(spark, d, "orders")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.md5("o_orderstatus").alias("a"))
    new = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.md5(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("b"))
    act = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "keep").when(~F.col("a").eqNullSafe(F.col("b")), "update").otherwise("same")
    return old.join(new, "k", "full_outer").select("k", act.alias("act"))


@query("""SELECT 'dangling' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
SELECT 'repeated_key', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'bad_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')""")
def fk_and_unique_audit(spark, d):
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    rule = lambda df, name: df.agg(n().alias("violations")).select(F.lit(name).alias("rule"), "violations")
    dangling = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    repeated = o.groupBy("o_orderkey").count().filter("count > 1")
    return rule(dangling, "dangling").unionByName(rule(repeated, "repeated_key")).unionByName(rule(o.filter("o_orderstatus NOT IN ('F', 'O', 'P')"), "bad_status"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def watermark_windows(spark, d):
    """Hourly counts of the events as a stream with a watermark, run to the end of the input."""
    stream = windows.event_stream(spark, f"{d}/events.parquet*", t(spark, d, "events").schema)
    # append would hold back the windows that the watermark has not passed when the input ends
    out = windows.run_to_files(windows.windowed_counts(stream), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


# vectors and retrieval

_KNN = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(v.label AS BIGINT) AS label, CAST(q.label AS BIGINT) AS ql, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) """


def _searched(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = t(spark, d, "embeddings")
    return vectors.nearest(v, v.filter("vec_id % 100 = 0"), k)


@query(_KNN + "SELECT query_id, vec_id, label, score, rank FROM k WHERE rank <= 5")
def knn_topk_per_query(spark, d):
    return _searched(spark, d, 5)


@query(_KNN + """SELECT query_id, CAST(sum(CASE WHEN label = ql THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(coalesce(1.0 / min(CASE WHEN label = ql THEN rank END), 0), 6) AS reciprocal_rank,
round(sum(CASE WHEN label = ql THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS dcg FROM k WHERE rank <= 10 GROUP BY query_id""")
def ndcg_mrr_recall(spark, d):
    own = t(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    rows = _searched(spark, d, 10).join(own, "query_id")
    hit = F.col("label") == F.col("ql")
    return rows.groupBy("query_id").agg(
        F.count_if(hit).alias("hits"), F.round(F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), 6).alias("dcg")
    )


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0)
SELECT CAST(label AS BIGINT) AS label, max(s) AS score, arg_max(vec_id, s * 1000000000 - vec_id) AS matched FROM (SELECT label, vec_id, round(list_cosine_similarity(e, CAST(embedding AS DOUBLE[])), 6) AS s FROM embeddings, q) GROUP BY label ORDER BY score DESC, label LIMIT 5""")
def group_vector_search(spark, d):
    v = t(spark, d, "embeddings")
    q = v.filter("vec_id = 0").select(F.col("embedding").alias("e")).limit(1)
    score = F.round(vectors.dot("embedding", "e") / F.sqrt(vectors.dot("embedding", "embedding") * vectors.dot("e", "e")), 6)
    scored = v.join(F.broadcast(q)).select(F.col("label").cast("long").alias("label"), "vec_id", score.alias("s"))  # one row
    return scored.groupBy("label").agg(F.max("s").alias("score"), F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("matched")).orderBy(F.desc("score"), "label").limit(5)


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS first FROM embeddings""")
def prefix_renormalise(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(F.get(vectors.unit_prefix(F.col("embedding"), 16), 0), 5).alias("first"))


@query(families.FINGERPRINTS + """, r AS (SELECT hi, lo, min(doc_id) AS doc_id FROM b GROUP BY ALL),
p AS (SELECT a.doc_id AS left_id, c.doc_id AS right_id, CAST(bit_count(xor(a.hi, c.hi)) + bit_count(xor(a.lo, c.lo)) AS BIGINT) AS hamming FROM r a JOIN r c ON a.doc_id < c.doc_id
UNION ALL SELECT r.doc_id, b.doc_id, 0 FROM r JOIN b ON r.hi = b.hi AND r.lo = b.lo AND b.doc_id > r.doc_id)
SELECT left_id, right_id, hamming, CASE WHEN hamming = 0 THEN 'exact' WHEN hamming <= 3 THEN 'near' ELSE 'manual' END AS relation FROM p WHERE hamming <= 6""")
def hamming_banded_pairs(spark, d):
    """Documents whose word fingerprints differ in six bits at most; copies follow as links to the first of them."""
    relation = F.when(F.col("hamming") == 0, "exact").when(F.col("hamming") <= 3, "near").otherwise("manual")
    return vectors.banded_pairs(families.fingerprints(spark, d), "doc_id", "bits", 6).withColumn("relation", relation)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_group_rollup(spark, sf_dir)
