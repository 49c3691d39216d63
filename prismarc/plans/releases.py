"""Queries on releases: rights, gated records, recommendations, searches by group, audits, line scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import releases as R
from ..functions import text as X
from ..operators import graph, reviews, vectors
from ..sources import files
from .register import query, t


def _rated(spark, d) -> DataFrame:
    """Documents with rights; labels stand in for the statuses, and lengths for the release gate."""
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "Restricted").when(F.col("quality") == 1, " Cleared ").when(F.col("quality") == 0, "link_only")
    rights = R.rights_record(status, F.col("n_chars") >= 700, F.col("text").isNotNull(), F.col("lang") == "en", ("cleared",), ("link_only",), ("restricted",))
    return rows.withColumn("rights", rights)


_RATED = """s AS (SELECT d.*, quality, toxic, CASE WHEN toxic = 1 THEN 'Restricted' WHEN quality = 1 THEN 'Cleared' WHEN quality = 0 THEN 'link_only' ELSE 'not_verified' END AS status, coalesce(n_chars >= 700, false) AS gate FROM documents d LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, CASE WHEN status = 'Restricted' THEN 'P4' WHEN gate AND status = 'Cleared' THEN 'P1' WHEN gate AND status = 'link_only' THEN 'P2' ELSE 'P3' END AS tier FROM s)"""


@query(f"""WITH {_RATED} SELECT doc_id, status, tier, CASE tier WHEN 'P1' THEN 'public' WHEN 'P2' THEN 'metadata_link_only' ELSE 'admin_only' END AS visibility,
CASE tier WHEN 'P4' THEN 'quarantine_only' WHEN 'P3' THEN 'reference_allowed' ELSE 'public_or_metadata' END AS usage, tier IN ('P1', 'P2') AS metadata_eligible, status = 'Cleared' AS explicitly_cleared,
tier = 'P1' AND text IS NOT NULL AS text_eligible, tier = 'P1' AND coalesce(lang = 'en', false) AS media_eligible, NOT (gate AND status = 'Cleared') AS needs_review FROM r""")
def rights_records(spark, d):
    return _rated(spark, d).select("doc_id", "rights.*")


@query(f"""WITH {_RATED}, p AS (SELECT doc_id, tier, source, CASE WHEN tier = 'P1' THEN text END AS said,
CASE WHEN tier = 'P1' AND coalesce(lang = 'en', false) THEN concat_ws(' ', CASE WHEN doc_id % 3 <> 0 THEN 'a/' || doc_id END, CASE WHEN doc_id % 4 <> 0 OR doc_id % 8 = 0 THEN 'b/' || doc_id END) ELSE '' END AS uris FROM r WHERE tier IN ('P1', 'P2'))
SELECT doc_id, tier, said IS NOT NULL AS text_included, uris, sha256(concat_ws('|', doc_id, tier, source, said, uris)) AS content_sha256 FROM p""")
def public_records(spark, d):
    """What goes out of every releasable document: text and assets behind their gates, and a digest of that."""
    i = F.col("doc_id")
    asset = lambda name, private, staging, released: F.struct(F.concat(F.lit(name), i.cast("string")).alias("uri"), private.alias("private"), staging.alias("staging"), released.alias("released"))
    no = F.lit(False)
    assets = F.array(asset("a/", i % 3 == 0, no, no), asset("b/", no, i % 4 == 0, i % 8 == 0))
    rated = _rated(spark, d).filter("rights.metadata_eligible").filter(R.releasable(i, F.col("rights")))
    out = rated.select("doc_id", "rights.tier", "source", F.when(F.col("rights.text_eligible"), F.col("text")).alias("said"), F.array_join(F.transform(R.public_assets(assets, F.col("rights")), lambda a: a["uri"]), " ").alias("uris"))
    return out.select("doc_id", "tier", F.col("said").isNotNull().alias("text_included"), "uris", F.sha2(F.concat_ws("|", i.cast("string"), "tier", "source", "said", "uris"), 256).alias("content_sha256"))


@query(f"""WITH {_RATED}, g AS (SELECT doc_id, sha256(text) AS h, [CASE WHEN status = 'Cleared' THEN 'rights_cleared' END, CASE WHEN gate THEN 'release_gate' END, CASE WHEN toxic = 0 THEN 'reviewed' END, CASE WHEN source IS NOT NULL THEN 'sourced' END, CASE WHEN n_chars < 1000 THEN 'short' END] AS why,
CASE WHEN status = 'Cleared' THEN 400 ELSE 0 END + CASE WHEN gate THEN 160 ELSE 0 END + CASE WHEN toxic = 0 THEN 140 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 40 ELSE 0 END - CASE WHEN n_chars < 1000 THEN 20 ELSE 0 END AS score FROM r WHERE text IS NOT NULL)
SELECT h AS digest, arg_max(doc_id, (score, -doc_id)) AS keeper, max(score) AS score, CASE WHEN max(score) >= 500 THEN 'tier_1' WHEN max(score) >= 250 THEN 'tier_2' ELSE 'tier_3' END AS tier,
array_to_string(list_filter(arg_max(why, (score, -doc_id)), lambda x: x IS NOT NULL), ' ') AS reasons, count(*) AS members FROM g GROUP BY h HAVING count(*) > 1""")
def group_recommendations(spark, d):
    """The member to keep of each group of equal texts, with its score, tier and reasons."""
    c = F.col
    signals = ((c("rights.explicitly_cleared"), 400, "rights_cleared"), (c("n_chars") >= 700, 160, "release_gate"), (c("toxic") == 0, 140, "reviewed"), (c("source").isNotNull(), 40, "sourced"), (c("n_chars") < 1000, -20, "short"))
    rows = _rated(spark, d).filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), R.member_score(signals).alias("signal"))
    return reviews.recommended(rows, "digest", "doc_id", "signal").filter("members > 1").withColumn("reasons", F.array_join("reasons", " "))


COLLAPSED = """WITH a AS (SELECT d.doc_id, sha256(text) AS h, coalesce(toxic, 0) <> 1 AS visible, coalesce(list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'and'), false) OR coalesce(contains(lower(text), 'schkeit'), false) OR (quality = 1 AND lang = 'es') IS TRUE AS hit FROM documents d LEFT JOIN labels USING (doc_id)),
g AS (SELECT h, arg_min(visible, doc_id) AS shown, min(doc_id) AS least, min(CASE WHEN hit THEN doc_id END) AS first, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM a WHERE h IS NOT NULL GROUP BY h)
SELECT doc_id, CASE WHEN g.h IS NULL THEN doc_id WHEN shown THEN least ELSE first END AS item, coalesce(matched, 1) AS matched FROM a LEFT JOIN g ON a.h = g.h WHERE hit"""


@query(COLLAPSED)
def collapsed_search(spark, d):
    """Hits by a word, by a part of one or by an alias, each with the item that stands for its group of equal texts."""
    word, part = F.array_contains(X.tokens(F.col("text")), "and"), F.contains(F.lower("text"), F.lit("schkeit"))
    docs = t(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"), (F.coalesce(word, F.lit(False)) | F.coalesce(part, F.lit(False))).alias("told"))  # no text goes into the join
    rows = docs.join(t(spark, d, "labels"), "doc_id", "left")
    hit = F.col("told") | F.coalesce((F.col("quality") == 1) & (F.col("lang") == "es"), F.lit(False))
    items = rows.select("doc_id", "h", (F.coalesce("toxic", F.lit(0)) != 1).alias("visible"), hit.alias("hit"))
    return reviews.collapsed(items, "doc_id", "h", "hit", "visible")


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(e, CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id <> query_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10),
h AS (SELECT query_id, label, arg_max(vec_id, (score, -vec_id)) AS matched, max(score) AS score FROM k GROUP BY ALL), m AS (SELECT label, min(vec_id) AS representative FROM embeddings WHERE vec_id % 7 <> 0 OR label % 3 <> 0 GROUP BY label)
SELECT query_id, h.label, matched, score, CASE WHEN representative IS NULL OR matched % 50 = 0 THEN 'missing' WHEN matched % 11 = 0 THEN 'matched_elsewhere' ELSE 'sound' END AS state FROM h LEFT JOIN m USING (label)""")
def hydrated_groups(spark, d):
    """Each query's best hit of every label among its ten nearest, held against a store that lost some rows and moved others."""
    v = t(spark, d, "embeddings")
    near = vectors.nearest(v, v.filter("vec_id % 100 = 0"), 10).select("query_id", "vec_id", "score").join(v.select("vec_id", "label"), "vec_id")
    best = near.groupBy("query_id", "label").agg(F.max_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("matched"), F.max("score").alias("score"))
    least = v.filter("vec_id % 7 <> 0 OR label % 3 <> 0").groupBy("label").agg(F.min("vec_id").alias("representative"))
    hits = best.join(least, "label", "left").select("query_id", "label", "matched", "score", "representative")
    store = v.select("vec_id", F.when(F.col("vec_id") % 11 == 0, F.col("label") + 1000).otherwise(F.col("label")).alias("label")).filter("vec_id % 50 <> 0")
    whole = v.select("vec_id", "label")
    matched = reviews.hydrated(hits.withColumn("own", F.col("matched")), store, "vec_id", "label", "matched", "own").withColumnRenamed("state", "a")
    both = reviews.hydrated(matched, whole, "vec_id", "label", "matched", "representative")
    return both.select("query_id", "label", "matched", "score", F.when(F.col("state") == "sound", F.col("a")).otherwise(F.col("state")).alias("state"))


@query("""SELECT 'no text' AS rule, CAST(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM documents
UNION ALL SELECT 'wrong length', CAST(sum(CASE WHEN n_chars <> length(text) THEN 1 ELSE 0 END) AS BIGINT) FROM documents
UNION ALL SELECT 'short', CAST(sum(CASE WHEN n_chars < 700 THEN 1 ELSE 0 END) AS BIGINT) FROM documents
UNION ALL SELECT 'repeated doc_id', CAST(count(*) - count(DISTINCT doc_id) AS BIGINT) FROM documents
UNION ALL SELECT 'repeated digest', CAST(count(*) - count(DISTINCT sha256(coalesce(text, ''))) AS BIGINT) FROM documents""")
def archive_audit(spark, d):
    docs = t(spark, d, "documents").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    c = F.col
    return reviews.audited(docs, {"no text": c("text").isNull(), "wrong length": c("n_chars") != F.char_length("text"), "short": c("n_chars") < 700}, ("doc_id", "digest"))


@query("""SELECT doc_id, 'sound' AS state, sha256(coalesce(text, '')) AS digest, n_chars FROM documents""")
def line_scan(spark, d):
    """Documents written as lines of JSON and scanned again, line by line."""
    path = f"{graph.shared_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    t(spark, d, "documents").select("doc_id", "text", "n_chars").write.json(path)
    back = files.scan_jsonl(spark, path, "doc_id long, text string, n_chars long", "doc_id")
    return back.select("doc_id", "state", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "n_chars")
