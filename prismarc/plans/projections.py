"""Queries on projections, filters and predicates over records, and the lanes' normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import records as R
from ..functions import text as X
from .register import n, query, t

_ASSETS = """(SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN '/abs/' || page_id || '.png' WHEN 2 THEN 'img/' || page_id || '.PNG' WHEN 3 THEN '../up/' || page_id || '.png'
WHEN 4 THEN 'img/' || page_id || '.txt' WHEN 5 THEN 'Staging\\Out/' || page_id || '.webp' ELSE 'img/../' || page_id || '.jpg' END AS uri FROM pages)"""


def _assets(spark, d) -> DataFrame:
    """Asset addresses of every kind, one a page."""
    p, k = F.col("page_id").cast("string"), F.col("page_id") % 7
    uri = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/abs/"), p, F.lit(".png"))).when(k == 2, F.concat(F.lit("img/"), p, F.lit(".PNG"))).when(k == 3, F.concat(F.lit("../up/"), p, F.lit(".png")))
    uri = uri.when(k == 4, F.concat(F.lit("img/"), p, F.lit(".txt"))).when(k == 5, F.concat(F.lit("Staging\\Out/"), p, F.lit(".webp"))).otherwise(F.concat(F.lit("img/../"), p, F.lit(".jpg")))
    return t(spark, d, "pages").select("page_id", uri.alias("uri"))


@query(f"SELECT page_id, CASE WHEN page_id % 7 = 2 OR page_id % 7 = 5 THEN uri END AS asset, page_id % 7 = 2 AND page_id % 2 = 0 AS present FROM {_ASSETS}")
def local_asset_guard(spark, d):
    """Addresses that stay inside the root; present where such a file is known."""
    own = _assets(spark, d).select("page_id", R.local_asset(F.col("uri")).alias("asset"))
    known = t(spark, d, "pages").filter("page_id % 2 = 0").select(F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".png")).alias("file"), F.lit(True).alias("there"))
    return own.join(known, F.lower("asset") == F.col("file"), "left").select("page_id", "asset", F.coalesce("there", F.lit(False)).alias("present"))


@query(f"SELECT page_id, page_id % 7 = 5 AS staging, page_id % 7 = 1 AS private FROM {_ASSETS}")
def private_paths(spark, d):
    return _assets(spark, d).select("page_id", R.has_marker(F.col("uri"), ["staging/out/", "\\tmp\\"]).alias("staging"), R.has_marker(F.col("uri"), ["/ABS/"]).alias("private"))


@query(f"""SELECT page_id, CASE WHEN page_id % 7 IN (2, 4) THEN uri END AS resource FROM {_ASSETS}""")
def resource_paths(spark, d):
    return _assets(spark, d).select("page_id", R.safe_resource(F.col("uri")).alias("resource"))


@query("""WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'HOUSEHOLD') AS reported, CASE WHEN c_acctbal < 0 THEN 'MIT' END AS detected, CASE WHEN c_custkey % 3 = 0 THEN 'CC0-1.0' END AS fallback, CASE WHEN c_custkey % 5 = 0 THEN 'checked' END AS status FROM customer)
SELECT c_custkey, reported, detected, coalesce(detected, reported, fallback) AS effective, coalesce(status, CASE WHEN coalesce(detected, reported, fallback) IS NOT NULL THEN 'reported' ELSE 'not_verified' END) AS status FROM c""")
def license_normalised(spark, d):
    key = F.col("c_custkey")
    made = R.license_record(F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")), F.when(F.col("c_acctbal") < 0, " MIT "), F.when(key % 3 == 0, "CC0-1.0"), F.when(key % 5 == 0, "checked"))
    return t(spark, d, "customer").select("c_custkey", made.alias("l")).select("c_custkey", "l.*")


@query(r"""SELECT doc_id, CASE WHEN trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, 40) END, '[ \t\n\r]+', ' ', 'g')) = trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))
THEN 'Reference D' || doc_id ELSE CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, 40) END END AS title FROM documents""")
def redacted_titles(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.col("text"))).otherwise(F.substring("text", 1, 40))
    return t(spark, d, "documents").select("doc_id", R.public_title(title, F.col("text"), F.concat(F.lit("D"), F.col("doc_id").cast("string"))).alias("title"))


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'restricted' WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN 'verified' ELSE 'unverified' END AS status,
CASE WHEN l.quality = 1 THEN ['https://a.example.com/' || d.source, 'https://b.example.com/'] ELSE ['https://b.example.com/'] END AS evidence
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""")
def rights_notices(spark, d):
    l = t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = F.sha2(F.col("text"), 256)
    evidence = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 2 == 0, own).otherwise(F.sha2(F.lit("another"), 256)))
    links = F.array(F.lit("https://b.example.com/"), F.when(F.col("quality") == 1, F.concat(F.lit("https://a.example.com/"), F.col("source"))), F.lit("https://b.example.com/"))
    return t(spark, d, "documents").join(l, "doc_id", "left").select("doc_id", R.rights_status(F.col("toxic") == 1, evidence, own).alias("status"), F.array_sort(F.array_distinct(F.array_compact(links))).alias("evidence"))


@query(r"""SELECT page_id, CASE WHEN page_id % 4 = 1 THEN NULL ELSE regexp_extract(url, '^[^?#]*') || CASE WHEN page_id % 4 = 0 THEN regexp_extract(url, '#[A-Za-z0-9_-]+$') WHEN page_id % 4 = 2 AND NOT contains(url, '#') THEN '#part-1' ELSE '' END END AS link FROM pages""")
def public_links(spark, d):
    k = F.col("page_id") % 4
    odd = F.when(k == 1, F.replace(F.col("url"), F.lit("://"), F.lit("://user:pass@"))).when(k == 2, F.concat("url", F.lit("#part-1"))).when(k == 3, F.concat("url", F.lit("#a=b"))).otherwise(F.col("url"))
    return t(spark, d, "pages").select("page_id", R.public_url(odd).alias("link"))


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS had_body, CAST(1 AS INTEGER) AS left_keys FROM events")
def stripped_bodies(spark, d):
    """Body keys go whatever their case; had_body says whether one held anything."""
    every = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("Title"), F.lit("t"), F.lit("PROMPT"), F.lit("")))
    body = lambda k: F.lower(k).isin("k", "prompt", "text")
    own = t(spark, d, "events").select("event_id", every.alias("m"))
    return own.select("event_id", F.exists(F.map_entries("m"), lambda e: body(e.key) & (F.coalesce(e.value, F.lit("")) != "")).alias("had_body"), F.size(F.map_filter("m", lambda k, v: ~body(k))).alias("left_keys"))


@query("""SELECT o_orderkey, o_orderstatus = 'P' OR o_totalprice > 400000 OR o_orderpriority = '1-URGENT' AS locked FROM orders""")
def paid_or_locked(spark, d):
    access = F.when(F.col("o_orderpriority") == "1-URGENT", "Premium").otherwise("free")
    return t(spark, d, "orders").select("o_orderkey", R.paid_or_locked(access, F.col("o_orderstatus") == "P", F.col("o_totalprice") > 400000).alias("locked"))


@query("""SELECT o_orderkey, c_name, coalesce(lines, 0) AS lines FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def approved_scope(spark, d):
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n().alias("lines"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t(spark, d, "orders").filter("o_orderstatus = 'F'").join(c, "o_custkey", "left").join(lines, "o_orderkey", "left").select("o_orderkey", "c_name", F.coalesce("lines", F.lit(0)).alias("lines"))


def without_quarantine(rows: DataFrame, tier: str, include: bool = False) -> DataFrame:
    """Rows whose tier isn't P4, unless the caller asks for all; an unknown tier stays."""
    return rows if include else rows.filter(F.coalesce(F.col(tier), F.lit("")) != "P4")


_TIERS = "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'P4' WHEN l.quality = 1 THEN 'P1' WHEN l.quality = 0 THEN 'P3' END AS tier FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id"


@query(f"SELECT * FROM ({_TIERS}) WHERE tier IS DISTINCT FROM 'P4'")
def quarantine_filter(spark, d):
    l = t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    tier = F.when(F.col("toxic") == 1, "P4").when(F.col("quality") == 1, "P1").when(F.col("quality") == 0, "P3")
    return without_quarantine(t(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", tier.alias("tier")), "tier")


def searched(rows: DataFrame, hay: Column, words: str, equal: dict[str, str]) -> DataFrame:
    """Rows that equal the given values but for case and hold all words as substrings, with the total on each."""
    for name, value in equal.items():
        rows = rows.filter(F.lower(name) == value.lower())
    for w in words.lower().split():
        rows = rows.filter(F.contains(F.lower(hay), F.lit(w)))
    return rows.join(F.broadcast(rows.agg(n().alias("total"))))  # one row


@query("""WITH f AS (SELECT p_partkey, p_name FROM part WHERE lower(p_brand) = 'brand#2' AND lower(p_type) = 'economy' AND contains(lower(p_name), 'e') AND contains(lower(p_name), 'r')) SELECT p_partkey, p_name, (SELECT count(*) FROM f) AS total FROM f ORDER BY p_partkey LIMIT 20""")
def filtered_search(spark, d):
    found = searched(t(spark, d, "part"), F.col("p_name"), "E r", {"p_brand": "BRAND#2", "p_type": "Economy"})
    return found.orderBy("p_partkey").select("p_partkey", "p_name", "total").limit(20)


def robots_rules(lines: DataFrame, site: str, at: str, line: str) -> DataFrame:
    """site, line, kind, path of the rules in the groups for every agent.  Agent lines in a row head one group; a site's lines are one file."""
    w = W.partitionBy(site).orderBy(at)
    plain = F.trim(F.regexp_replace(line, "#.*$", ""))
    rows = lines.select(site, at, F.lower(F.trim(F.substring_index(plain, ":", 1))).alias("kind"), F.trim(F.substr(plain, F.instr(plain, ":") + F.lit(1))).alias("path")).filter(F.col("kind").isin("user-agent", "allow", "disallow"))
    agent = F.col("kind") == "user-agent"
    heads = agent & F.coalesce(F.lag("kind").over(w) != "user-agent", F.lit(True))
    rows = rows.withColumn("heads", heads).withColumn("block", F.sum(F.col("heads").cast("int")).over(w))
    whole = F.max((agent & (F.col("path") == "*")).cast("int")).over(W.partitionBy(site, "block"))
    return rows.withColumn("every", whole).filter((F.col("every") == 1) & ~agent & (F.col("block") > 0) & (F.col("path") != "")).select(site, at, "kind", "path")


@query("""WITH l AS (SELECT page_id // 50 AS site, page_id AS "at", CASE WHEN page_id % 10 IN (0, 1) THEN 'agent' ELSE 'rule' END AS k, page_id % 20 IN (0, 11) AS any_agent FROM pages),
b AS (SELECT site, "at" // 10 AS block, bool_or(any_agent) AS every FROM l GROUP BY ALL)
SELECT l.site, "at", CASE WHEN "at" % 3 = 0 THEN 'allow' ELSE 'disallow' END AS kind, '/p' || "at" AS path FROM l JOIN b ON l.site = b.site AND "at" // 10 = b.block WHERE k = 'rule' AND every""")
def robots_groups(spark, d):
    p = F.col("page_id")
    agents = F.when(p % 20 == 0, "User-Agent: *").when(p % 20 == 11, "user-agent : * # all").when(p % 10 < 2, "User-agent: bot")
    rule = F.concat(F.when(p % 3 == 0, "Allow: ").otherwise("DISALLOW:"), F.lit("/p"), p.cast("string"), F.lit("  # why"))
    return robots_rules(t(spark, d, "pages").select(F.floor(p / 50).alias("site"), p.alias("at"), F.coalesce(agents, rule).alias("line")), "site", "at", "line")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_quantity) AS p FROM lineitem)
SELECT l_orderkey, string_agg(l_partkey || ':' || l_linenumber, ' ' ORDER BY p > 1, l_linenumber, l_partkey, l_quantity) AS cards, count(*) AS members FROM r GROUP BY l_orderkey""")
def card_projection(spark, d):
    """Of every group the allow-listed fields of its members, the representative first; groups are orders, so bounded."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("v"), "l_linenumber", "l_partkey", "l_quantity"))).alias("m"))
    rest = F.array_sort(F.transform(F.slice("m", 2, F.greatest(F.size("m"), F.lit(1))), lambda x: F.struct(x.l_linenumber.alias("l_linenumber"), x.l_partkey.alias("l_partkey"), x.l_quantity.alias("q"))))
    card = lambda x: F.concat_ws(":", x.l_partkey.cast("string"), x.l_linenumber.cast("string"))
    return lines.select("l_orderkey", F.array_join(F.concat(F.array(card(F.get("m", 0))), F.transform(rest, card)), " ").alias("cards"), F.size("m").cast("long").alias("members"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring') THEN CASE WHEN p_type = 'PEOPLE' THEN [p_type] ELSE [p_type, 'people'] END ELSE [p_type] END AS categories FROM part""")
def people_override(spark, d):
    return t(spark, d, "part").select("p_partkey", R.with_people(F.array("p_type"), F.col("p_name"), ["red", "ring"]).alias("categories"))


@query("""SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN CASE WHEN p_type = 'ECONOMY' THEN ['low', 'cheap'] ELSE ['low'] END WHEN p_type = 'ECONOMY' THEN ['cheap'] ELSE ['unclassified'] END AS categories FROM part""")
def browse_categories(spark, d):
    ids = F.array(F.concat("p_brand", F.lit(".x.y")), F.concat("p_type", F.lit(".z")))
    return t(spark, d, "part").select("p_partkey", R.browse_categories(ids, {"low": ["Brand#1", "Brand#2"], "cheap": ["ECONOMY"]}).alias("categories"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def record_days(spark, d):
    """A date from the first key that has one, or out of the run's id."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 3
    run = F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-x"))
    return t(spark, d, "orders").select("o_orderkey", R.record_time(run, F.when(k == 0, day).otherwise("soon"), F.when(k == 1, F.concat(day, F.lit("")))).alias("day"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '/items/' || event_id || '/image?v=' || coalesce(json_extract_string(props, '$.k'), '0') AS image_url FROM events""")
def private_columns(spark, d):
    k = F.get_json_object("props", "$.k")
    return t(spark, d, "events").select("event_id", k.cast("long").alias("k"), F.concat(F.lit("/items/"), F.col("event_id").cast("string"), F.lit("/image?v="), F.coalesce(k, F.lit("0"))).alias("image_url"))


@query("""SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber, count(*) AS uses FROM lineitem GROUP BY 1, 2""")
def record_assets(spark, d):
    """Of the assets of a record the first of each address and role."""
    return t(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("l_linenumber"), n().alias("uses"))


@query("""SELECT p_partkey, p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand || ' ' END || p_type AS search_text FROM part""")
def search_texts(spark, d):
    brand = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_brand"))
    values = F.array(F.concat(F.lit(" "), F.col("p_name")), brand, F.lit(None), F.lit("  "), F.col("p_type"), F.lower("p_type"))
    return t(spark, d, "part").select("p_partkey", F.array_join(R.distinct_folded(values), " ").alias("search_text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND (o_totalprice > 300000 OR o_custkey % 5 = 0 OR o_orderkey % 7 = 0) THEN 'human' WHEN o_orderstatus = 'F' THEN 'large' WHEN o_orderkey % 100 >= 92 AND o_orderkey % 7 <> 0 THEN 'small'
WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'small' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'large' END AS route FROM orders""")
def model_routing(spark, d):
    p, key = F.col("o_orderpriority"), F.col("o_orderkey")
    task = F.when(p == "1-URGENT", "extract").when(p == "2-HIGH", "tag").when(p == "3-MEDIUM", "caption").otherwise("judge")
    route = R.routed(task, key % 100 / 100.0, F.col("o_totalprice") > 300000, F.col("o_custkey") % 5 == 0, key % 7 == 0, F.col("o_orderstatus") == "F")
    return t(spark, d, "orders").select("o_orderkey", route.alias("route"))


# lanes: every source becomes one kind of record


def lane_records(rows: DataFrame, lane: str, record: Column, style: Column, title: Column, text: Column, source: Column, url: Column | None = None) -> DataFrame:
    """The common record of a lane's rows; a row without an id raises, and nothing is released by default."""
    key = F.coalesce(record.cast("string"), F.raise_error(F.lit(f"a row of lane {lane} has no id")).cast("string"))
    shown = X.bounded(title, 120)
    return rows.select(
        F.concat(F.lit(lane + ":"), key).alias("catalog_key"), key.alias("record_id"), style.alias("style_id"), F.lit(lane).alias("lane"), shown.alias("title"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("prompt_sha256"),
        X.bounded(source, 80).alias("source_name"), (X.http_url(url) if url is not None else F.lit(None).cast("string")).alias("source_url"), F.lit(False).alias("release_eligible"),
    )


def _lane_sql(lane: str, table: str, record: str, style: str, title: str, text: str, source: str, url: str = "CAST(NULL AS VARCHAR)") -> str:
    return rf"""SELECT '{lane}:' || {record} AS catalog_key, CAST({record} AS VARCHAR) AS record_id, {style} AS style_id, '{lane}' AS lane, nullif(substr(trim(regexp_replace(replace({title}, chr(0), ' '), '[ \t\n\r]+', ' ', 'g')), 1, 120), '') AS title,
sha256(coalesce({text}, '')) AS prompt_sha256, {source} AS source_name, {url} AS source_url, false AS release_eligible FROM {table}"""


@query(_lane_sql("legacy", "pages", "page_id", "'CASE-' || lpad(CAST(page_id AS VARCHAR), 6, '0')", "url", "html", "regexp_extract(url, '^https?://([^/]+)', 1)", "url"))
def lane_legacy(spark, d):
    style = F.concat(F.lit("CASE-"), F.lpad(F.col("page_id").cast("string"), 6, "0"))
    return lane_records(t(spark, d, "pages"), "legacy", F.col("page_id"), style, F.col("url"), F.col("html"), F.regexp_extract("url", "^https?://([^/]+)", 1), F.col("url"))


@query(_lane_sql("unified", "documents", "doc_id", "source || '-' || doc_id", "substr(text, 1, 60)", "text", "source"))
def lane_unified(spark, d):
    return lane_records(t(spark, d, "documents"), "unified", F.col("doc_id"), F.concat_ws("-", "source", F.col("doc_id").cast("string")), F.substring("text", 1, 60), F.col("text"), F.col("source"))


@query(_lane_sql("collected", "benchmark", "item_id", "'B' || item_id", "text", "text", "'benchmark'"))
def lane_collected(spark, d):
    return lane_records(t(spark, d, "benchmark"), "collected", F.col("item_id"), F.concat(F.lit("B"), F.col("item_id").cast("string")), F.col("text"), F.col("text"), F.lit("benchmark"))


@query(_lane_sql("template", "part", "p_partkey", "p_brand", "p_name", "'A ' || p_name || ' by ' || p_brand || ', ' || lower(p_type)", "'templates'"))
def lane_template(spark, d):
    said = F.concat(F.lit("A "), F.col("p_name"), F.lit(" by "), F.col("p_brand"), F.lit(", "), F.lower("p_type"))
    return lane_records(t(spark, d, "part"), "template", F.col("p_partkey"), F.col("p_brand"), F.col("p_name"), said, F.lit("templates"))
