"""Queries on what people are asked to review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection
from .register import n, query, t


@query("""WITH RECURSIVE p AS (SELECT 'n' || c_nationkey AS a, 'm' || strftime(o_orderdate, '%Y-%m') AS b, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY orders DESC, a, b) AS i FROM p),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, false AS took
UNION ALL SELECT r.i, CASE WHEN len(list_filter(used, lambda x: x = a)) < 4 AND len(list_filter(used, lambda x: x = b)) < 4 THEN list_concat(used, [a, b]) ELSE used END,
  len(list_filter(used, lambda x: x = a)) < 4 AND len(list_filter(used, lambda x: x = b)) < 4 FROM w JOIN r ON r.i = w.i + 1)
SELECT a AS nation, b AS month, orders FROM w JOIN r USING (i) WHERE took""")
def capped_review_pairs(spark, d):
    """Pairs of nations and months by their orders, the most first, four to a nation and to a month: what a walk would take."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = o.groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"), F.concat(F.lit("m"), F.date_format("o_orderdate", "yyyy-MM")).alias("month")).agg(n().alias("orders"))
    return selection.capped_pairs(pairs, "nation", "month", [-F.col("orders")], 4)


@query("""WITH RECURSIVE act AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 9 <> 8),
fam AS (SELECT DISTINCT lang || ':' || n_chars AS s, doc_id AS m FROM documents JOIN act USING (doc_id)),
l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
told AS (SELECT x.doc_id AS a, y.doc_id AS b, CASE WHEN x.q = y.q THEN 1 ELSE 0 END AS v FROM l x JOIN l y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 3 > 0
  UNION SELECT f.doc_id, g.doc_id, CASE WHEN f.doc_id % 4 = 0 THEN 0 ELSE 1 END FROM documents f JOIN documents g ON g.lang = f.lang AND g.n_chars = f.n_chars AND g.doc_id > f.doc_id AND g.doc_id // 200 = f.doc_id // 200),
pairs AS (SELECT a, b, min(v) AS v FROM told WHERE a IN (SELECT doc_id FROM act) AND b IN (SELECT doc_id FROM act) AND a <> b GROUP BY a, b),
e AS (SELECT a, b FROM pairs WHERE v = 1 UNION SELECT b, a FROM pairs WHERE v = 1),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
comp AS (SELECT a AS m, least(a, min(b)) AS s FROM reach GROUP BY a),
sets AS (SELECT 'family' AS kind, CAST(s AS VARCHAR) AS s, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS k, count(*) AS size, min(m) AS least FROM fam GROUP BY s HAVING count(*) > 1
  UNION ALL SELECT 'positive', CAST(s AS VARCHAR), string_agg(CAST(m AS VARCHAR), ',' ORDER BY m), count(*), min(m) FROM comp GROUP BY s HAVING count(*) > 1),
one AS (SELECT min(kind) AS kind, k, any_value(size) AS size, any_value(least) AS least FROM sets GROUP BY k),
mem AS (SELECT k, CAST(unnest(string_split(k, ',')) AS BIGINT) AS m FROM one),
c AS (SELECT x.k, count(*) FILTER (v = 1) AS positives, count(*) FILTER (v = 0) AS conflicts FROM pairs JOIN mem x ON x.m = a JOIN mem y ON y.m = b AND y.k = x.k GROUP BY x.k)
SELECT kind, size, least, coalesce(positives, 0) AS positives, coalesce(conflicts, 0) AS conflicts FROM one LEFT JOIN c USING (k)""")
def candidate_sets(spark, d):
    """Families of documents (one language and length), then components of the pairs that labels confirm; with the pairs that speak against them."""
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    active = docs.filter("doc_id % 9 <> 8").select("doc_id")
    families = docs.select(F.concat_ws(":", "lang", F.col("n_chars").cast("string")).alias("family"), "doc_id")
    graded = labels.groupBy("doc_id").agg(F.max("quality").alias("q"))
    beside = graded.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other"), F.col("q").alias("p"))
    shown = graded.filter("doc_id % 3 > 0").join(beside, "doc_id").select("doc_id", "other", F.when(F.col("q") == F.col("p"), 1).otherwise(0).alias("v"))
    # within 200 ids, so copies don't all meet
    own = docs.select("lang", "n_chars", F.floor(F.col("doc_id") / 200).alias("part"), "doc_id")
    twins = own.join(own.withColumnRenamed("doc_id", "other"), ["lang", "n_chars", "part"]).filter("other > doc_id")
    told = shown.unionByName(twins.select("doc_id", "other", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("v")))
    return selection.candidate_sets(families, told, active, "family", "doc_id", "doc_id", "other", "v")[0].drop("name")
