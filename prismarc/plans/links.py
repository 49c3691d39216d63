"""Queries on links between rows: absorption, aliases, retention, mutual neighbours, diversity, ladders, joins by keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import graph, vectors
from .register import n, query, t


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS x FROM lineitem),
z AS (SELECT s, count(*) AS size, string_agg(x, ',' ORDER BY x) AS h FROM m GROUP BY s),
f AS (SELECT h, min(s) AS first, min(size) AS size FROM z GROUP BY h),
k AS (SELECT m.s, m.x, f.size FROM m JOIN f ON m.s = f.first),
o AS (SELECT a.s, b.s AS holder, b.size AS bigger FROM k a JOIN k b ON a.x = b.x AND b.size > a.size GROUP BY a.s, b.s, a.size, b.size HAVING count(*) = a.size),
w AS (SELECT s, holder FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY bigger DESC, holder) AS r FROM o) WHERE r = 1)
SELECT z.s AS l_orderkey, coalesce(w.holder, CASE WHEN z.s <> f.first THEN f.first END) AS absorbed_by FROM z JOIN f USING (h) LEFT JOIN w ON w.s = f.first WHERE w.holder IS NOT NULL OR z.s <> f.first""")
def set_absorption(spark, d):
    """Orders whose parts are all in another order."""
    return graph.absorb_sets(t(spark, d, "lineitem"), "l_orderkey", "l_partkey").withColumnRenamed("by", "absorbed_by")


_ALIAS = "WITH a AS (SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS root, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS hops FROM orders) "


@query(_ALIAS + "SELECT node, root, CAST(hops AS BIGINT) AS hops, false AS cyclic FROM a WHERE parent IS NOT NULL")
def alias_chain(spark, d):
    """Every order stands for the customer's order before it; the ends of these chains."""
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    links = t(spark, d, "orders").select("o_orderkey", before.alias("parent")).filter("parent IS NOT NULL")
    return graph.resolve_aliases(links, "o_orderkey", "parent")


@query(_ALIAS + "SELECT root, count(*) AS archived, min(node) AS first_alias, max(hops) AS depth FROM a WHERE parent IS NOT NULL GROUP BY root")
def alias_lineage(spark, d):
    return alias_chain(spark, d).groupBy("root").agg(n().alias("archived"), F.min("node").alias("first_alias"), F.max("hops").alias("depth"))


@query()
def greedy_retention(spark, d):
    """Documents that stay when each goes that shares its template, or language, source and length, with one that stays before it."""
    rows = t(spark, d, "documents").select("doc_id", F.sha2(X.template(F.col("text")), 256).alias("a"), F.concat_ws("|", "lang", "source", F.col("n_chars").cast("string")).alias("b"))
    return graph.keep_unmatched(rows, "doc_id", ["a", "b"])


_RANKED = """WITH s AS (SELECT q.vec_id AS a, v.vec_id AS b, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE v.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s) """


@query(_RANKED + "SELECT x.a AS query_id, x.b AS vec_id, x.score, x.rank, y.rank AS back_rank FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a % 100 = 0 AND x.rank <= 10 AND y.rank <= 10")
def mutual_knn_edges(spark, d):
    """The queries' neighbours that have the query among their own ten nearest; only these neighbours are searched back."""
    v = t(spark, d, "embeddings")
    there = graph.written(vectors.nearest(v, v.filter("vec_id % 100 = 0"), 10))
    back = vectors.nearest(v, v.join(there.select("vec_id").distinct(), "vec_id", "left_semi"), 10)
    back = back.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("query_id"), F.col("rank").alias("back_rank"))
    return there.join(back, ["query_id", "vec_id"]).select("query_id", "vec_id", "score", "rank", "back_rank")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id % 100 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank, CASE WHEN score >= 0.98 THEN 'identity' WHEN score >= 0.73 THEN 'candidate' ELSE 'new' END AS relation FROM k WHERE rank <= 3""")
def old_new_top3(spark, d):
    v = t(spark, d, "embeddings")
    best = vectors.nearest(v.filter("vec_id % 100 <> 0"), v.filter("vec_id % 100 = 0"), 3)
    return best.select("query_id", "vec_id", "score", "rank", F.when(F.col("score") >= 0.98, "identity").when(F.col("score") >= 0.73, "candidate").otherwise("new").alias("relation"))


def _diverse(group: pd.DataFrame) -> pd.DataFrame:
    """Greedy picks of 0.7 x relevance - 0.3 x the greatest similarity to a pick, out of one query's 50 candidates."""
    group = group.sort_values("vec_id").reset_index(drop=True)
    vecs = np.stack(group["embedding"].to_numpy()).astype(float)
    vecs /= np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)
    near, score = np.zeros(len(group)), group["score"].to_numpy()
    left, picks = np.ones(len(group), bool), []
    for _ in range(min(10, len(group))):
        gain = np.where(left, np.round(0.7 * score - 0.3 * near, 9), -np.inf)
        best = int(gain.argmax())
        picks.append((group.query_id[0], group.vec_id[best], len(picks) + 1, round(float(gain[best]), 6)))
        left[best] = False
        near = vecs @ vecs[best] if len(picks) == 1 else np.maximum(near, vecs @ vecs[best])
    return pd.DataFrame(picks, columns=["query_id", "vec_id", "pick", "gain"])


@query()
def marginal_relevance(spark, d):
    v = t(spark, d, "embeddings")
    found = vectors.nearest(v, v.filter("vec_id % 100 = 0"), 50).select("query_id", "vec_id", "score").join(v.select("vec_id", "embedding"), "vec_id")
    return found.groupBy("query_id").applyInPandas(_diverse, "query_id long, vec_id long, pick long, gain double")


@query("""WITH o AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS pr FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
i AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS pr FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT i.o_custkey, CASE WHEN o.o_custkey IS NULL THEN 'new' WHEN o.st = i.st AND o.pr = i.pr THEN 'unchanged' WHEN o.pr = i.pr THEN 'remix' ELSE 'update' END AS kind FROM i LEFT JOIN o USING (o_custkey)""")
def batch_ladder(spark, d):
    """Each customer's newest order of the incoming period against the newest one before."""
    newest = lambda rows, s: rows.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias(s))
    o, cut = t(spark, d, "orders"), F.lit("1997-01-01").cast("timestamp")
    met = newest(o.filter(F.col("o_orderdate") >= cut), "i").join(newest(o.filter(F.col("o_orderdate") < cut), "o"), "o_custkey", "left")
    same = F.col("o.o_orderpriority") == F.col("i.o_orderpriority")
    kind = F.when(F.col("o").isNull(), "new").when(same & (F.col("o.o_orderstatus") == F.col("i.o_orderstatus")), "unchanged").when(same, "remix").otherwise("update")
    return met.select("o_custkey", kind.alias("kind"))


@query("""WITH i AS (SELECT item_id, sha256(text) AS a, sha256(trim(regexp_replace(regexp_replace(lower(text), '\\[[^\\[\\]]*\\]|\\{[^{}]*\\}|[0-9]+', ' <var> ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS b FROM benchmark),
c AS (SELECT doc_id, sha256(text) AS a, sha256(trim(regexp_replace(regexp_replace(lower(text), '\\[[^\\[\\]]*\\]|\\{[^{}]*\\}|[0-9]+', ' <var> ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS b FROM documents)
SELECT i.item_id, (SELECT min(doc_id) FROM c WHERE c.a = i.a) AS exact_id, (SELECT min(doc_id) FROM c WHERE c.b = i.b) AS template_id FROM i""")
def incoming_identity(spark, d):
    """For each item the first document with its text, and with its template."""
    keys = lambda name: t(spark, d, name).withColumn("a", F.sha2("text", 256)).withColumn("b", F.sha2(X.template(F.col("text")), 256))
    docs, out = keys("documents"), keys("benchmark").select("item_id", "a", "b")
    for key, name in (("a", "exact_id"), ("b", "template_id")):
        out = out.join(docs.groupBy(key).agg(F.min("doc_id").alias(name)), key, "left")
    return out.select("item_id", "exact_id", "template_id")


@query("""SELECT event_id, user_id FROM events WHERE user_id IN (SELECT CAST(unnest(from_json('[1, 5, 8, 13, 400, 99999]', '["BIGINT"]')) AS BIGINT))""")
def semi_join_json_ids(spark, d):
    ids = spark.range(1).select(F.explode(F.from_json(F.lit("[1, 5, 8, 13, 400, 99999]"), "array<bigint>")).alias("user_id"))
    return t(spark, d, "events").join(F.broadcast(ids), "user_id", "left_semi").select("event_id", "user_id")  # six ids


@query("""SELECT o_orderkey, l_linenumber, p_name, s_name, l_linenumber = 1 AS main FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 50 OFFSET 10""")
def ordinal_paging_join(spark, d):
    """A page of lines with what they refer to; the page is cut before the outer joins."""
    lines = t(spark, d, "orders").select("o_orderkey").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    page = lines.orderBy("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").offset(10).limit(50)
    named = page.join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"), "left").join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return named.select("o_orderkey", "l_linenumber", "p_name", "s_name", (F.col("l_linenumber") == 1).alias("main"))


@query("""SELECT d.doc_id, coalesce(l.quality, m.quality) AS quality, CASE WHEN l.doc_id IS NOT NULL THEN 'own' WHEN m.h IS NOT NULL THEN 'copy' ELSE 'none' END AS basis FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN (SELECT sha256(text) AS h, min(quality) AS quality FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY 1) m ON m.h = sha256(d.text)""")
def overlay_lookup(spark, d):
    """A document's label, or else that of a copy of it."""
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    own = t(spark, d, "labels").select("doc_id", F.col("quality").alias("q"), F.lit(True).alias("own"))
    marked = docs.join(own, "doc_id", "left")
    copies = marked.filter("own AND h IS NOT NULL").groupBy("h").agg(F.min("q").alias("q2"), F.lit(True).alias("copy"))
    basis = F.when(F.col("own"), "own").when(F.col("copy"), "copy").otherwise("none")
    return marked.join(copies, "h", "left").select("doc_id", F.coalesce("q", "q2").alias("quality"), basis.alias("basis"))


@query("""SELECT s_suppkey, (SELECT min(p_name) FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey) AS least_name FROM supplier""")
def scalar_min_join(spark, d):
    least = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey").agg(F.min("p_name").alias("least_name"))
    return t(spark, d, "supplier").join(least, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "least_name")


@query("""SELECT 'unlabelled' AS rule, count(*) AS violations FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'unknown_label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'labelled_twice', count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'bad_value', count(*) FROM labels WHERE coalesce(quality NOT IN (0, 1), true) OR coalesce(toxic NOT IN (0, 1), true)""")
def label_validation(spark, d):
    docs, labels = t(spark, d, "documents").select("doc_id"), t(spark, d, "labels")
    rule = lambda rows, name: rows.agg(n().alias("violations")).select(F.lit(name).alias("rule"), "violations")
    bad = labels.filter("coalesce(quality NOT IN (0, 1), true) OR coalesce(toxic NOT IN (0, 1), true)")
    out = rule(docs.join(labels, "doc_id", "left_anti"), "unlabelled").unionByName(rule(labels.join(docs, "doc_id", "left_anti"), "unknown_label"))
    return out.unionByName(rule(labels.groupBy("doc_id").count().filter("count > 1"), "labelled_twice")).unionByName(rule(bad, "bad_value"))
