"""Queries on normal forms, scores, templates, JSON shapes and parsed text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import finds
from ..functions import normalise as N
from ..functions import records as R
from ..functions import text as X
from ..operators import graph, overlaps
from .register import n, query, t

_FLAT = r"trim(regexp_replace({}, '[ \t\n\r]+', ' ', 'g'))"


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents""")
def normal_texts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(N.normal_text(F.col("text")), 256).alias("digest"))


@query(f"""SELECT doc_id, sha256(replace(lower({_FLAT.format("coalesce(text, '')")}), 'ß', 'ss')) AS prompt, sha256(replace(lower({_FLAT.format("coalesce(text, '')")}), 'ß', 'ss')) AS term, sha256(lower({_FLAT.format("coalesce(text, '')")})) AS gallery FROM documents""")
def normal_forms(spark, d):
    return t(spark, d, "documents").select("doc_id", *[N.form_digest(k, F.col("text")).alias(k) for k in N.FORMS])


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]+|[㐀-鿿]+|[぀-ヿ]+')) AS tokens, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]+|[㐀-鿿]+|[぀-ヿ]+'), ' ')) AS digest FROM documents""")
def script_token_lists(spark, d):
    tokens = N.script_tokens(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("digest"))


@query("""WITH p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, CASE WHEN p_partkey % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) END AS b FROM part)
SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM p""")
def token_jaccard(spark, d):
    tokens = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    a, b = tokens(F.col("p_name")), F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<string>")).otherwise(tokens(F.concat_ws(" ", "p_name", "p_type")))
    return t(spark, d, "part").select("p_partkey", F.round(N.jaccard_or_zero(a, b), 6).alias("jaccard"))


@query("""WITH e AS (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS h, sha256(CAST(event_id + 1 AS VARCHAR)) AS g FROM events)
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(bit_count(xor(CAST('0x' || substr(h, 1, 8) AS BIGINT), CAST('0x' || substr(g, 1, 8) AS BIGINT))) + bit_count(xor(CAST('0x' || substr(h, 9, 8) AS BIGINT), CAST('0x' || substr(g, 9, 8) AS BIGINT))) AS BIGINT) END AS bits FROM e""")
def hex_hamming(spark, d):
    digest = lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 16)
    left = F.when(F.col("event_id") % 10 != 0, digest(F.col("event_id"))).otherwise(F.when(F.col("event_id") % 20 == 0, ""))
    return t(spark, d, "events").select("event_id", N.hamming(N.hex_bits(left), N.hex_bits(digest(F.col("event_id") + 1))).alias("bits"))


@query()
def near_texts(spark, d):
    """Near copies by the gated score, over all documents whose token sets can overlap enough.

    A Jaccard similarity of 0.88 leaves at most 12 in 100 tokens of the union to one side, so two such sets share one of the
    first (rarest first) floor(0.12 n) + 1 tokens of each: those are the keys.  Texts with equal tokens, length and fingerprint
    are one node: pairs of nodes are those of their least documents, and every other document of a node is a pair with that one
    (score 1), so each link is a pair of these or follows from it by the members.
    """
    docs = t(spark, d, "documents").filter("doc_id IS NOT NULL")
    rows = graph.tabled(docs.select("doc_id", N.token_sets(F.col("text")).alias("s")).select("doc_id", "s.*")).filter("own IS NOT NULL")
    slim = [F.first(c).alias(c) for c in ("chars", "size", "print", "keys", "home")]
    nodes = graph.tabled(overlaps.rare_keys(rows, "own", 0.12).groupBy("node").agg(F.min("doc_id").alias("doc_id"), *slim))
    # the narrow gates come first: lengths, sizes and fingerprints meet over the keys, token sets only where these are close
    close = (F.least("size", "other_size") >= 0.88 * F.greatest("size", "other_size")) & (F.least("chars", "other_chars") >= 0.9 * F.greatest("chars", "other_chars")) & (N.hamming(F.col("print"), F.col("other_print")) <= 12)
    named = nodes.select("node", "doc_id")
    met = overlaps.close_pairs(nodes.drop("doc_id"), rows.join(named, ["node", "doc_id"], "left_semi"), "own", close)
    a, b = (nodes.select(F.col("node").alias(n), *[F.col(c).alias(p + c) for c in ("doc_id", "chars", "size", "print")]) for n, p in (("node", "l_"), ("other", "r_")))
    c = F.col
    score = N.near_score((c("l_chars"), c("r_chars")), (c("l_size"), c("r_size")), (c("l_print"), c("r_print")), c("met"))
    apart = met.join(a, "node").join(b, "other").select(F.least("l_doc_id", "r_doc_id").alias("left_id"), F.greatest("l_doc_id", "r_doc_id").alias("right_id"), score.alias("score")).filter("score IS NOT NULL")
    members = rows.select("node", F.col("doc_id").alias("right_id")).join(named, "node").filter("right_id > doc_id").distinct()
    return apart.unionByName(members.select(F.col("doc_id").alias("left_id"), "right_id", F.lit(1.0).alias("score")))


@query()
def blake_simhashes(spark, d):
    """64-bit SimHashes of all documents, by word trigrams."""
    return t(spark, d, "documents").select("doc_id", F.lower(F.lpad(F.hex(N.script_simhash(F.col("text"))), 16, "0")).alias("simhash"))


@query(r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\[[^\]\n]{1,80}\]', ' <var> ', 'g'), '\{[^}\n]{1,80}\}', ' <var> ', 'g'), '<[^>\n]{1,80}>', ' <var> ', 'g'), '(?:"[^"\n]{1,120}"|''[^''\n]{1,120}'')', ' <var> ', 'g'), '\b[0-9]+(?:[.:/-][0-9]+)*\b', ' <var> ', 'g') AS m FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(m, '[ \t\n\r]+', ' ', 'g'))) AS template FROM m""")
def slot_templates(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(N.slotted(F.col("text")), 256).alias("template"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name || ' costs <var> in the shop at <var> today' END AS signature FROM part""")
def template_signatures(spark, d):
    said = F.concat(F.col("p_name"), F.lit(" costs "), F.col("p_size").cast("string"), F.lit(" [money] in the shop at https://a.b/c today"))
    return t(spark, d, "part").select("p_partkey", N.template_signature(F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(said)).alias("signature"))


@query("""SELECT p_partkey, 'what' AS name, p_name AS "default", 13 AS "begin", 46 + len(p_name) AS "end" FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), 6, 15 + len(CAST(p_size AS VARCHAR)) FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, NULL, NULL, 2, 11 FROM part WHERE p_partkey % 3 = 2""")
def literal_arguments(spark, d):
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat(F.lit('A picture of {argument name="what" default="'), "p_name", F.lit('"} please'))).when(k == 1, F.concat(F.lit("Size: [[size|"), F.col("p_size").cast("string"), F.lit("]]"))).otherwise(F.lit("A {argument nothing}"))
    finds.register(spark)
    rows = t(spark, d, "part").select("p_partkey", said.alias("said"))
    return spark.sql("SELECT r.p_partkey, f.name, f.default, CAST(f.begin AS BIGINT) AS begin, CAST(f.end AS BIGINT) AS end FROM {rows} r, LATERAL finds(r.said, 'arguments') f", rows=rows)


@query(r"""SELECT p_partkey, 0 AS ordinal, p_name AS name, 'so \"' || p_brand || '\" says' AS "default" FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 1, p_type, NULL FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 0, p_name, 'C:\x' FROM part WHERE p_partkey % 2 = 1""")
def escaped_arguments(spark, d):
    """Arguments whose quotes are escaped within them, and those that stand in escaped text; values as they stand."""
    even = F.concat(F.lit('{argument name="'), "p_name", F.lit('" default="so \\"'), "p_brand", F.lit('\\" says"} and {argument name="'), "p_type", F.lit('"}'))
    odd = F.concat(F.lit('{argument name=\\"'), "p_name", F.lit('\\"\n default=\\"C:\\x\\" }'))
    finds.register(spark)
    rows = t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd).alias("said"))
    return spark.sql("SELECT r.p_partkey, f.ordinal, f.name, f.default FROM {rows} r, LATERAL finds(r.said, 'arguments') f", rows=rows)


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(2 AS BIGINT) END AS containers, CASE WHEN event_id % 4 < 2 THEN CAST(3 AS BIGINT) END AS scalars, CASE WHEN event_id % 4 < 2 THEN CAST(3 AS BIGINT) END AS named_leaves, CASE WHEN event_id % 4 < 2 THEN CAST(1 AS BIGINT) END AS named_texts FROM events""")
def json_shapes(spark, d):
    k = F.col("event_id") % 4
    inner = F.concat(F.lit('{"type":"'), "event_type", F.lit('","v":['), F.col("event_id").cast("string"), F.lit(',""]}'))
    said = F.when(k == 0, inner).when(k == 1, F.concat(F.lit("```json\n"), inner, F.lit("\n```"))).when(k == 2, F.lit('{"a":1,"a":2}')).otherwise(F.lit('{"a":NaN}'))
    return t(spark, d, "events").select("event_id", N.json_shapes(said).alias("s")).select("event_id", *[F.get("s", i).alias(k) for i, k in enumerate(N.SHAPE)])


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 3 END AS tier FROM events""")
def prompt_tiers(spark, d):
    k = F.col("event_id") % 5
    said = F.when(k == 0, F.col("props")).when(k == 1, F.lit("# One\ntext\n## Two\n")).when(k == 2, F.col("event_type")).when(k == 3, F.lit(" ")).otherwise(F.lit("{}"))
    return t(spark, d, "events").select("event_id", N.prompt_tier(said).alias("tier"))


_COUNT = "least(len(regexp_extract_all(text, '{}')), {}) * {}"


@query("SELECT doc_id, CAST(coalesce(" + " + ".join(_COUNT.format(*x) for x in ((r"(?m)^#{1,6} ", 5, 6), (r"(?m)^[ \t]*[-*] ", 10, 2), (r"(?m)^[A-Za-z][A-Za-z ]{0,30}: ", 10, 2), (r"\{[^}\n]{1,80}\}", 5, 2))) + r" + least(len(regexp_extract_all(text, '[^ \t\n\r]+')) // 20, 20), 0) AS BIGINT) AS score FROM documents")
def structural_scores(spark, d):
    return t(spark, d, "documents").select("doc_id", N.structural_score(F.col("text")).alias("score"))


@query("""SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size % 4, p_partkey % 3, p_retailprice DESC, p_partkey) AS BIGINT) AS place FROM part ORDER BY place LIMIT 50""")
def priority_order(spark, d):
    """The first fifty by (tier, variant, score)."""
    first = t(spark, d, "part").orderBy(F.struct(F.col("p_size") % 4, F.col("p_partkey") % 3, -F.col("p_retailprice")), "p_partkey").limit(50)
    return first.select("p_partkey", F.row_number().over(W.orderBy(F.col("p_size") % 4, F.col("p_partkey") % 3, F.desc("p_retailprice"), "p_partkey")).cast("long").alias("place"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","type":"' || p_type || '"}' AS json, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '"}') AS digest FROM part""")
def stable_json(spark, d):
    """Sorted keys; the digest leaves the object's own digest field out."""
    m = F.create_map(F.lit("type"), F.col("p_type"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return t(spark, d, "part").select("p_partkey", N.stable_json(m).alias("json"), F.sha2(N.stable_json(F.map_filter(m, lambda k, v: k != "type")), 256).alias("digest"))


@query("""SELECT event_id, CASE WHEN value / 50 - 1 BETWEEN -1 AND 1 THEN round(value / 50 - 1, 6) END AS value, CASE WHEN NOT value / 50 - 1 BETWEEN -1 AND 1 THEN 'invalid_cosine' END AS flag FROM events""")
def checked_similarity(spark, d):
    return t(spark, d, "events").select("event_id", N.kept_similarity("cosine", F.col("value") / 50 - 1).alias("s")).select("event_id", "s.*")


@query("""SELECT p_partkey, CASE WHEN p_brand = p_type THEN [p_brand, p_name] ELSE [p_type, p_brand, p_name] END AS ordered, list_sort(list_distinct([p_type, p_brand, p_name]), 'ASC', 'NULLS LAST') AS sorted FROM (SELECT p_partkey, lower(p_type) AS p_type, lower(p_brand) AS p_brand, lower(p_name) AS p_name FROM part)""")
def string_lists(spark, d):
    values = F.array(F.lower("p_type"), F.lit(None), F.lower("p_brand"), F.lower("p_type"), F.lower("p_name"))
    own = F.array_distinct(F.array_compact(values))
    by_case = lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0)
    return t(spark, d, "part").select("p_partkey", own.alias("ordered"), F.array_sort(own, by_case).alias("sorted"))


@query("""SELECT c_custkey, [CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END, c_mktsegment, c_name] AS strings FROM customer""")
def flattened_strings(spark, d):
    """Prompt parts of every shape (text, list, object) as a list of strings, depth first, keys sorted."""
    b = F.struct(F.col("c_name").alias("z"), F.array("c_mktsegment", F.lit(None)).alias("b"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("a"), F.lit(5).alias("c"))
    return t(spark, d, "customer").select("c_custkey", N.strings_of(F.to_json(b)).alias("strings"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE sha256('{"id":"' || event_id || '"}') END AS version FROM events""")
def version_keys(spark, d):
    """The first timestamp, else the digest of the metadata without its body."""
    meta = N.stable_json(F.create_map(F.lit("id"), F.col("event_id").cast("string")))
    return t(spark, d, "events").select("event_id", F.coalesce(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")), F.sha2(meta, 256)).alias("version"))


@query("""SELECT 'order-' || substr(sha256(string_agg(k, chr(0) ORDER BY k)), 1, 24) AS group_id, count(*) AS members FROM (SELECT DISTINCT l_orderkey, CAST(l_partkey AS VARCHAR) AS k FROM lineitem) GROUP BY l_orderkey""")
def member_group_ids(spark, d):
    own = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("m"))
    return own.select(N.member_group_id("order", F.col("m")).alias("group_id"), F.size("m").cast("long").alias("members"))


@query()
def point_ids(spark, d):
    return t(spark, d, "embeddings").select("vec_id", N.point_id(F.concat(F.lit("snapshot-1:"), F.col("vec_id").cast("string"))).alias("point_id"))


@query("""SELECT p_partkey, 'item-' || p_partkey AS anchor, 'json' AS language, '{"name": "' || p_name || '"}' || chr(10) AS body, 'media/' || p_partkey || '.png' AS image, p_partkey % 2 = 0 AS known FROM part""")
def markdown_items(spark, d):
    """Anchors, literal fences and image links of markdown; links are held against the files of the tree."""
    p = F.col("p_partkey").cast("string")
    said = F.concat(F.lit('<a id="item-'), p, F.lit('"></a>\n## '), "p_name", F.lit("\n![x](media/"), p, F.lit('.png)\n```json\n{"name": "'), "p_name", F.lit('"}\n```\n'))
    rows = t(spark, d, "part").select("p_partkey", said.alias("md"), F.regexp_extract(said, r"!\[[^\]]*\]\(([^()]+)\)", 1).alias("image"))
    tree = t(spark, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("media/"), p, F.lit(".png")).alias("image"), F.lit(True).alias("there"))
    finds.register(spark)
    items = spark.sql("SELECT r.p_partkey, r.image, f.anchor, f.language, f.body FROM {rows} r, LATERAL finds(r.md, 'fences') f", rows=rows)
    return items.join(tree, "image", "left").select("p_partkey", "anchor", "language", "body", "image", F.coalesce("there", F.lit(False)).alias("known"))


@query("""SELECT p_partkey, 'name: ' || p_name || chr(10) || 'brand: ' || p_brand || CASE WHEN p_type = p_brand OR p_partkey % 4 = 0 THEN '' ELSE chr(10) || 'type: ' || p_type END AS text FROM part""")
def compact_texts(spark, d):
    """Whitelisted fields as labelled lines, every value once; a finding drops its field."""
    fields = [("name", F.col("p_name")), ("brand", F.concat(F.lit("  "), F.col("p_brand"))), ("also", F.upper("p_name")), ("type", F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")))]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), X.bounded(v, 200).alias("v")) for k, v in fields])
    own = F.filter(pairs, lambda p: p.v.isNotNull())
    folded = F.transform(own, lambda p: F.lower(p.v))
    kept = F.filter(own, lambda p, i: F.array_position(folded, F.lower(p.v)) == i + 1)
    return t(spark, d, "part").select("p_partkey", F.array_join(F.transform(kept, lambda p: F.concat(p.k, F.lit(": "), p.v)), "\n").alias("text"))


@query("""SELECT c_custkey, lower(c_name) || ' ' || lower(c_mktsegment) || ' kunde' AS lexical FROM customer""")
def lexical_documents(spark, d):
    """All strings of a card and its alias terms, every normalised term once."""
    card = F.to_json(F.struct(F.struct(F.upper("c_name").alias("x")).alias("b"), F.array("c_name", "c_mktsegment").alias("a")))
    terms = F.concat("strings", F.array(F.lit("Kunde"), F.col("c_mktsegment")))
    return t(spark, d, "customer").select("c_custkey", "c_mktsegment", N.strings_of(card).alias("strings")).select("c_custkey", F.lower(F.array_join(R.distinct_folded(terms), " ")).alias("lexical"))
