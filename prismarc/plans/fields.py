"""Queries of field functions: text, keys, vectors, JSON, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking, vectors
from .register import n, query, t


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS second, CAST(ts AS DATE) AS day FROM events""")
def utc_seconds(spark, d):
    return t(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("second"), F.to_date("ts").alias("day"))


@query("""SELECT doc_id, coalesce(left(text, CAST(list_max(list_filter(range(0, 65), lambda i: octet_length(encode(left(text, CAST(i AS BIGINT)))) <= 64)) AS BIGINT)), '') AS head FROM documents""")
def byte_bounded_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.coalesce(X.byte_bounded(F.col("text"), 64), F.lit("")).alias("head"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '!?\[([^\[\]]*)\]\([^()]*\)', '\1', 'g'), 'https?://[^ \t\n\r]+', '', 'g'), ' -|:*#') AS title FROM pages""")
def display_titles(spark, d):
    return t(spark, d, "pages").select("page_id", X.display_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(r"""SELECT page_id, len(refs) AS refs, list_sort(list_distinct(list_filter(refs, lambda u: regexp_matches(lower(u), '^https?://')))) AS remote FROM (SELECT page_id, regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1) AS refs FROM pages)""")
def media_references(spark, d):
    refs = F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), 1)
    return t(spark, d, "pages").select("page_id", refs.alias("r")).select("page_id", F.size("r").cast("long").alias("refs"), F.array_sort(F.array_distinct(F.filter("r", lambda u: F.lower(u).rlike("^https?://")))).alias("remote"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9]+')) AS latin, len(regexp_extract_all(text, '\p{Hangul}+')) AS hangul, len(regexp_extract_all(text, '\p{Han}')) AS han, len(regexp_extract_all(text, '[\p{Hiragana}\p{Katakana}]+')) AS kana FROM documents""")
def script_runs(spark, d):
    runs = {"latin": "([a-zA-Z0-9]+)", "hangul": r"(\p{IsHangul}+)", "han": r"(\p{IsHan})", "kana": r"([\p{IsHiragana}\p{IsKatakana}]+)"}
    count = lambda p: F.when(F.col("text").isNotNull(), F.size(F.regexp_extract_all("text", F.lit(p), 1)).cast("long"))
    return t(spark, d, "documents").select("doc_id", *[count(p).alias(k) for k, p in runs.items()])


@query("""SELECT o_orderkey, rtrim(translate(to_base64(encode('{"k":' || o_orderkey || '}')), '+/', '-_'), '=') AS cursor, o_orderkey AS decoded FROM orders""")
def cursor_roundtrip(spark, d):
    cursor = X.cursor(F.to_json(F.struct(F.col("o_orderkey").alias("k"))))
    return t(spark, d, "orders").select("o_orderkey", cursor.alias("cursor")).withColumn("decoded", F.get_json_object(X.cursor_text(F.col("cursor")), "$.k").cast("long"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) <= 1e-3 AS is_unit,
round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE) - 0.01))), 5) AS l1, CAST(CAST(embedding[1] AS DOUBLE) / 3 AS FLOAT) = CAST(embedding[1] AS DOUBLE) / 3 AS exact_float FROM embeddings""")
def vector_checks(spark, d):
    e = F.col("embedding")
    norm = F.sqrt(vectors.dot(e, e))
    l1 = F.aggregate(e, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double") - 0.01))
    third = F.get(e, 0).cast("double") / 3
    return t(spark, d, "embeddings").select("vec_id", F.round(norm, 5).alias("norm"), (F.abs(norm - 1) <= 1e-3).alias("is_unit"), F.round(l1, 5).alias("l1"), (third.cast("float").cast("double") == third).alias("exact_float"))


@query("""SELECT p_partkey, CASE WHEN p_size IS NULL OR p_retailprice <= 0 THEN NULL ELSE round(abs(p_size - p_retailprice) / greatest(p_size, p_retailprice), 6) END AS delta, CAST(ceil(p_size * 1.02) + 8 AS BIGINT) AS reserved FROM part""")
def ratio_and_reservation(spark, d):
    a, b = F.col("p_size").cast("double"), F.col("p_retailprice")
    return t(spark, d, "part").select("p_partkey", F.when(a.isNotNull() & (b > 0), F.round(F.abs(a - b) / F.greatest(a, b), 6)).alias("delta"), (F.ceil(a * 1.02) + 8).alias("reserved"))


@query("""SELECT conv_id, CAST(count(*) * max(length(text)) + sum(length(text)) AS BIGINT) AS cost, count(*) <= 20 AND count(*) * max(length(text)) + sum(length(text)) <= 10000 AS allowed FROM conversations GROUP BY conv_id""")
def rerank_cost_guard(spark, d):
    cost = n() * F.max(F.length("text")) + F.sum(F.length("text"))
    return t(spark, d, "conversations").groupBy("conv_id").agg(cost.alias("cost"), ((n() <= 20) & (cost <= 10000)).alias("allowed"))


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'none' ELSE 'body' END AS held, regexp_matches(props, '"(path|k)" *:') AS forbidden FROM events""")
def forbidden_keys(spark, d):
    keys = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: (F.lower(k) == "k") & v.isNotNull())
    return t(spark, d, "events").select("event_id", F.when(F.size(F.coalesce(keys, F.create_map().cast("map<string,string>"))) > 0, "body").otherwise("none").alias("held"), F.col("props").rlike('"(path|k)" *:').alias("forbidden"))


@query(r"""SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%d\_w%' ESCAPE '\' OR lower(p_name) LIKE '%d w%'""")
def escaped_like(spark, d):
    """The question's own % and _ stand for themselves."""
    name = F.lower("p_name")
    return t(spark, d, "part").filter(name.contains("d_w") | name.contains("d w")).select("p_partkey", "p_name")


@query("""SELECT p_partkey, 'case-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS case_id, split_part(p_type, ' ', 1) AS family, CASE WHEN split_part(p_type, ' ', 1) IN ('ECONOMY', 'PROMO') THEN 'shown' ELSE 'unclassified' END AS category,
CASE WHEN lower(trim(p_name)) = lower(trim(p_brand)) THEN 'Reference ' || p_partkey ELSE p_name END AS title, CASE WHEN list_has_any(string_split(lower(p_name), ' '), ['widget', 'gear']) THEN 'device' END AS note FROM part""")
def record_projection(spark, d):
    family = F.split_part("p_type", F.lit(" "), F.lit(1))
    same = F.lower(F.trim("p_name")) == F.lower(F.trim("p_brand"))
    return t(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("case-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("case_id"), family.alias("family"), F.when(family.isin("ECONOMY", "PROMO"), "shown").otherwise("unclassified").alias("category"),
        F.when(same, F.concat(F.lit("Reference "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("title"), F.when(F.arrays_overlap(F.split(F.lower("p_name"), " "), F.array(F.lit("widget"), F.lit("gear"))), "device").alias("note"),
    )


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN l.quality = 1 THEN 'detected' ELSE '' END, ''), CASE WHEN l.toxic = 0 THEN 'reported' END, 'fallback') AS effective FROM documents LEFT JOIN labels l USING (doc_id)""")
def first_non_empty(spark, d):
    detected = F.nullif(F.when(F.col("quality") == 1, "detected").otherwise(""), F.lit(""))
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce(detected, F.when(F.col("toxic") == 0, "reported"), F.lit("fallback")).alias("effective"))


@query(r"""SELECT item_id, len(w) AS words, len(list_filter(range(1, len(w) + 1), lambda i: i = 1 OR w[i] <> w[i - 1])) AS runs, substr(sha256(array_to_string(list_filter(w, lambda x: length(x) > 3), ' ')), 1, 24) AS long_words FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)""")
def token_signature(spark, d):
    w = F.col("w")
    runs = F.size(F.filter(w, lambda x, i: (i == 0) | (x != F.get(w, i - 1))))
    return t(spark, d, "benchmark").select("item_id", X.tokens(F.col("text")).alias("w")).select("item_id", F.size(w).cast("long").alias("words"), runs.cast("long").alias("runs"), F.substring(F.sha2(F.array_join(F.filter(w, lambda x: F.length(x) > 3), " "), 256), 1, 24).alias("long_words"))


@query("""SELECT page_id, row_number() OVER (ORDER BY CASE WHEN key <> '' THEN 0 ELSE 1 END, CAST(nullif(key, '') AS BIGINT), lower(url), page_id) AS place FROM (SELECT page_id, url, regexp_extract(url, '/([0-9]{1,18})(?:[?#].*)?$', 1) AS key FROM pages)""")
def numeric_aware_order(spark, d):
    key = F.nullif(F.regexp_extract("url", "/([0-9]{1,18})(?:[?#].*)?$", 1), F.lit("")).cast("long")
    rows = t(spark, d, "pages").select("page_id", key.isNull().alias("a"), F.coalesce(key, F.lit(0)).alias("b"), F.lower("url").alias("c"))
    return ranking.ranks(rows, [], ["a", "b", "c", "page_id"], "place").select("page_id", "place")
