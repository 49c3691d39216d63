"""Queries on ledgers, caches and checkpoints that runs hand on, merges, and validations of what people decided."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import by_value
from ..operators import extensions
from .register import n, query, t

_DAY = "strftime(ts, '%Y-%m-%d')"


@query(f"SELECT user_id, event_type, max({_DAY}) AS version, CAST(0 AS BIGINT) AS details FROM events WHERE ts < '2024-01-16' GROUP BY ALL")
def forward_baseline(spark, d):
    """A first run records versions only, no details."""
    return t(spark, d, "events").filter("ts < '2024-01-16'").groupBy("user_id", "event_type").agg(F.max(F.date_format("ts", "yyyy-MM-dd")).alias("version"), F.lit(0).cast("long").alias("details"))


@query(f"""WITH r AS (SELECT *, {_DAY} AS run FROM events), c AS (SELECT run FROM r GROUP BY run HAVING max(value) > 40)
SELECT user_id, max(run) AS watermark, count(*) AS events FROM r WHERE run IN (SELECT run FROM c) GROUP BY user_id""")
def detail_bootstrap(spark, d):
    """The watermark of every user from completed runs only."""
    r = t(spark, d, "events").withColumn("run", F.date_format("ts", "yyyy-MM-dd"))
    done = r.groupBy("run").agg(F.max("value").alias("m")).filter("m > 40").select("run")
    return r.join(done, "run", "left_semi").groupBy("user_id").agg(F.max("run").alias("watermark"), n().alias("events"))


def folded_drafts(ops: DataFrame, key: str, at: str, expected: str, request: str) -> DataFrame:
    """key, revision, accepted, refused, repeated: operations of a draft in order.

    One is accepted if it names the draft's revision, which it raises by one; one whose request was accepted before does
    nothing.  The operations of one draft are folded as an array.
    """
    own = ops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(request).alias("request"), F.col(expected).cast("long").alias("expected")))).alias("ops"))
    zero = F.struct(F.lit(0).cast("long").alias("revision"), F.lit(0).cast("long").alias("refused"), F.lit(0).cast("long").alias("repeated"), F.array().cast("array<string>").alias("seen"))

    def step(s: Column, op: Column) -> Column:
        again = F.array_contains(s["seen"], op["request"])
        ok = ~again & (op["expected"] == s["revision"])
        one = lambda c: c.cast("long")
        return F.struct(
            (s["revision"] + one(ok)).alias("revision"), (s["refused"] + one(~again & ~ok)).alias("refused"), (s["repeated"] + one(again)).alias("repeated"),
            F.when(ok, F.array_append(s["seen"], op["request"])).otherwise(s["seen"]).alias("seen"),
        )

    return own.select(key, F.aggregate("ops", zero, step).alias("s")).select(key, "s.revision", F.col("s.revision").alias("accepted"), "s.refused", "s.repeated")


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn % 4 AS k FROM conversations),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS revision, CAST(0 AS BIGINT) AS refused FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT o.conv_id, o.i, f.revision + CASE WHEN o.k = 3 THEN 0 ELSE 1 END, f.refused + CASE WHEN o.k = 3 THEN 1 ELSE 0 END FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
SELECT conv_id, max(revision) AS revision, max(revision) AS accepted, max(refused) AS refused, CAST(0 AS BIGINT) AS repeated FROM f GROUP BY conv_id""")
def draft_revisions(spark, d):
    """Turns as operations on a draft: three of four name its revision, the fourth is a stale one."""
    c = t(spark, d, "conversations")
    stale = (F.col("turn") % 4) == 3
    expected = F.when(stale, F.lit(-1)).otherwise(F.col("turn") - F.floor((F.col("turn") + 1) / 4))
    return folded_drafts(c.select("conv_id", "turn", expected.alias("expected"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("request")), "conv_id", "turn", "expected", "request")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, sha256(o_orderkey || ':' || o_custkey) AS token, CASE WHEN o_orderkey % 7 = 0 THEN 'forged' ELSE sha256(o_orderkey || ':' || o_custkey) END AS given FROM orders)
SELECT o_orderkey, CASE WHEN token <> given THEN 'refused' WHEN o_orderkey % 2 = 0 THEN 'committed before' ELSE 'committed' END AS outcome FROM o""")
def token_commits(spark, d):
    """A commit needs the token of its preview, and a second one does nothing."""
    token = F.sha2(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), 256)
    o = t(spark, d, "orders").select("o_orderkey", token.alias("token"), F.when(F.col("o_orderkey") % 7 == 0, "forged").otherwise(token).alias("given"))
    done = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit(True).alias("done"))
    return o.join(done, "o_orderkey", "left").select("o_orderkey", F.when(F.col("token") != F.col("given"), "refused").when(F.col("done"), "committed before").otherwise("committed").alias("outcome"))


@query("""WITH p AS (SELECT p_partkey AS key, p_name AS v FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 30 = 0 THEN 'other' ELSE p_name END AS v FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(p.key, c.key) AS key, CASE WHEN p.v <> c.v THEN 'conflict' WHEN p.key IS NULL THEN 'own' WHEN c.key IS NULL THEN 'inherited' ELSE 'both' END AS origin FROM p FULL JOIN c ON p.key = c.key""")
def cache_carry_over(spark, d):
    """A child run inherits its parent's cache; a key with two values is a conflict."""
    part = t(spark, d, "part")
    p = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("pv"))
    c = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 30 == 0, "other").otherwise(F.col("p_name")).alias("cv"))
    return p.join(c, "key", "full").select("key", F.when(F.col("pv") != F.col("cv"), "conflict").when(F.col("pv").isNull(), "own").when(F.col("cv").isNull(), "inherited").otherwise("both").alias("origin"))


@query("""SELECT conv_id, count(*) AS attempts, count(*) = sum(CASE WHEN conv_id % 6 = 0 AND turn = 0 THEN 0 ELSE 1 END) AS prefix_holds FROM conversations GROUP BY conv_id""")
def ledger_prefixes(spark, d):
    """The first attempts of a child's ledger must be its parent's."""
    c = t(spark, d, "conversations")
    parent = c.select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    changed = F.when((F.col("conv_id") % 6 == 0) & (F.col("turn") == 0), F.lit("rewritten")).otherwise(F.col("h"))
    child = parent.select("conv_id", "turn", changed.alias("own")).unionByName(c.select("conv_id", (F.col("turn") + 1000).alias("turn"), F.lit("new").alias("own")))
    met = parent.join(child, ["conv_id", "turn"], "left")
    return met.groupBy("conv_id").agg(n().alias("attempts"), F.every(F.coalesce(F.col("h") == F.col("own"), F.lit(False))).alias("prefix_holds"))


@query("""SELECT o_custkey AS catalog_key, l_linenumber AS asset_index, arg_max(l_partkey, o_orderkey * 1000000 + l_partkey) AS result, count(*) AS writes FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def cache_index_merge(spark, d):
    """One result for each asset reference: of several writes the latest."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("catalog_key"))
    met = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(o, "l_orderkey")
    return met.groupBy("catalog_key", F.col("l_linenumber").alias("asset_index")).agg(F.max_by("l_partkey", F.struct("l_orderkey", "l_partkey")).alias("result"), n().alias("writes"))


def merged(target: DataFrame, source: DataFrame, keys: list[str], newer: str) -> DataFrame:
    """The rows of both, one a key: the one with the greatest ``newer``, the source's at a tie."""
    every = target.withColumn("_source", F.lit(0)).unionByName(source.withColumn("_source", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(newer, "_source")).alias("_best"))
    return best.select(*keys, "_best.*").select(*target.columns)


@query(f"""SELECT user_id, event_type, max({_DAY}) AS updated, arg_max(event_id, epoch_us(ts) * 10000000 + event_id) AS event_id FROM (SELECT * FROM events WHERE ts < '2024-01-16' UNION ALL SELECT * FROM events WHERE ts >= '2024-01-10') GROUP BY ALL""".replace("arg_max(event_id, epoch_us(ts) * 10000000 + event_id)", "arg_max(event_id, struct_pack(a := ts, b := event_id))"))
def merged_drafts(spark, d):
    """Drafts as they are after an upsert of later ones."""
    latest = lambda e: e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", F.date_format("m.ts", "yyyy-MM-dd").alias("updated"), "m.event_id", F.struct("m.ts", "m.event_id").alias("_at"))
    e = t(spark, d, "events")
    return merged(latest(e.filter("ts < '2024-01-16'")), latest(e.filter("ts >= '2024-01-10'")), ["user_id", "event_type"], "_at").drop("_at")


@query("""SELECT s_suppkey AS batch, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'no-op' WHEN s_suppkey % 3 = 0 THEN 'changed manifest' ELSE 'import' END AS action FROM supplier""")
def batch_imports(spark, d):
    """A batch whose manifest was imported before does nothing; one with the same name and another manifest stands out."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("batch"), F.sha2("s_name", 256).alias("manifest"))
    done = s.filter("batch % 3 = 0").select("batch", F.when(F.col("batch") % 2 == 0, F.col("manifest")).otherwise("older").alias("imported"))
    return s.join(done, "batch", "left").select("batch", F.when(F.col("imported").isNull(), "import").when(F.col("imported") == F.col("manifest"), "no-op").otherwise("changed manifest").alias("action"))


def rule_counts(rows: DataFrame, **rules: Column) -> DataFrame:
    """rule, violations in one pass; a rule that is unknown for a row counts as broken."""
    told = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return told.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])).alias("r")).select("r.*")


@query("""SELECT 'grade' AS rule, count(*) FILTER (NOT coalesce(quality IN (0, 1), false)) AS violations FROM labels UNION ALL SELECT 'toxic_is_bad', count(*) FILTER (NOT coalesce(toxic = 0 OR quality = 0, false)) FROM labels
UNION ALL SELECT 'known', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'once', count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)""")
def annotation_rules(spark, d):
    l = t(spark, d, "labels")
    own = rule_counts(l, grade=F.col("quality").isin(0, 1), toxic_is_bad=(F.col("toxic") == 0) | (F.col("quality") == 0))
    one = lambda df, name: df.agg(n().alias("violations")).select(F.lit(name).alias("rule"), "violations")
    return own.unionByName(one(l.join(t(spark, d, "documents").select("doc_id"), "doc_id", "left_anti"), "known")).unionByName(one(l.groupBy("doc_id").count().filter("count > 1"), "once"))


@query("""WITH g AS (SELECT l_orderkey AS g, count(DISTINCT l_partkey) AS members, count(*) AS lines, min(l_partkey) AS rep FROM lineitem GROUP BY 1)
SELECT 'two_members' AS rule, count(*) FILTER (members < 2) AS violations FROM g UNION ALL SELECT 'distinct_members', count(*) FILTER (members <> lines) FROM g UNION ALL SELECT 'representative_inside', count(*) FILTER (rep % 11 = 0) FROM g""")
def catalog_rules(spark, d):
    """Groups have two members or more, none twice, and their representative among them."""
    rep = F.when(F.min("l_partkey") % 11 == 0, -1).otherwise(F.min("l_partkey"))
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("all"), rep.alias("rep"))  # an order's lines are few
    distinct = F.size(F.array_distinct("all"))
    return rule_counts(g, two_members=distinct >= 2, distinct_members=distinct == F.size("all"), representative_inside=F.array_contains("all", F.col("rep")))


@query("""SELECT item_id AS version, CASE WHEN item_id % 4 = 3 THEN 'apply' WHEN item_id % 8 = 2 THEN 'drift' ELSE 'applied' END AS state FROM benchmark""")
def migration_plan(spark, d):
    """Versions by their digests: applied once; a digest that changed since is drift."""
    m = t(spark, d, "benchmark").select(F.col("item_id").alias("version"), F.sha2("text", 256).alias("h"))
    done = m.filter("version % 4 <> 3").select("version", F.when(F.col("version") % 8 == 2, "other").otherwise(F.col("h")).alias("was"))
    return m.join(done, "version", "left").select("version", F.when(F.col("was").isNull(), "apply").when(F.col("was") != F.col("h"), "drift").otherwise("applied").alias("state"))


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'P4' WHEN c_acctbal < 2000 THEN 'P3' ELSE 'P1' END AS tier, c_custkey % 9 <> 0 AND c_acctbal >= 0 AS shown, c_acctbal >= 2000 AND c_custkey % 5 <> 0 AS body FROM customer)
SELECT 'quarantine_is_hidden' AS rule, count(*) FILTER (tier = 'P4' AND shown) AS violations FROM r UNION ALL SELECT 'open_is_shown', count(*) FILTER (tier = 'P1' AND NOT shown) FROM r UNION ALL SELECT 'body_only_if_open', count(*) FILTER (body AND tier <> 'P1') FROM r UNION ALL SELECT 'body_only_if_shown', count(*) FILTER (body AND NOT shown) FROM r""")
def rights_policy_rules(spark, d):
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    tier, shown, body = F.when(b < 0, "P4").when(b < 2000, "P3").otherwise("P1"), (k % 9 != 0) & (b >= 0), (b >= 2000) & (k % 5 != 0)
    r = t(spark, d, "customer").select(tier.alias("tier"), shown.alias("shown"), body.alias("body"))
    c = F.col
    return rule_counts(r, quarantine_is_hidden=(c("tier") != "P4") | ~c("shown"), open_is_shown=(c("tier") != "P1") | c("shown"), body_only_if_open=~c("body") | (c("tier") == "P1"), body_only_if_shown=~c("body") | c("shown"))


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_KNOWN = {"type", "required", "properties", "additionalProperties", "items", "enum", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "pattern"}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def schema_errors(value: object, schema: dict, place: str = "$") -> list[str]:
    """Where a value breaks a schema of the vocabulary in ``_KNOWN``; any other word raises."""
    import re

    if unknown := set(schema) - _KNOWN:
        raise ValueError(f"unsupported: {sorted(unknown)}")
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{place}: type"]
    bad = [f"{place}: enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        bad += [f"{place}.{k}: required" for k in schema.get("required", ()) if k not in value]
        bad += [f"{place}.{k}: additional" for k in sorted(value) if k not in known and schema.get("additionalProperties", True) is False]
        for k in sorted(set(known) & set(value)):
            bad += schema_errors(value[k], known[k], f"{place}.{k}")
    elif isinstance(value, list):
        for i, x in enumerate(value if "items" in schema else ()):
            bad += schema_errors(x, schema["items"], f"{place}[{i}]")
    size = value if _is(value, "number") else len(value) if isinstance(value, (str, list)) else None
    low, high = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems")}.get(type(value), ("minimum", "maximum"))
    if size is not None:
        bad += [f"{place}: {low}"] if size < schema.get(low, size) else []
        bad += [f"{place}: {high}"] if size > schema.get(high, size) else []
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        bad.append(f"{place}: pattern")
    return bad


def json_errors(c: Column, schema: dict) -> Column:
    def each(v: str | None) -> list[str]:
        try:
            return schema_errors(json.loads(v or ""), schema)
        except json.JSONDecodeError:
            return ["$: json"]

    schema_errors(None, schema)  # an unsupported word raises here
    return by_value(each, "array<string>")(c)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN '$.k: maximum' ELSE '' END WHEN 1 THEN '$.k: type' WHEN 2 THEN '$.k: required,$.z: additional' ELSE '$: json' END AS errors FROM events""")
def json_schema_rows(spark, d):
    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 50}}}
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.col("props")).when(k == 1, F.lit('{"k": "1"}')).when(k == 2, F.lit('{"z": 1}')).otherwise(F.lit("{"))
    return t(spark, d, "events").select("event_id", json_errors(said, schema).alias("e")).select("event_id", F.array_join("e", ",").alias("errors"))


_DECISIONS = """WITH g AS (SELECT l_orderkey AS g, list_sort(list(DISTINCT l_partkey)) AS members FROM lineitem GROUP BY 1),
c AS (SELECT g, members, CASE WHEN g % 5 = 0 THEN list_append(members[1:1], -1) WHEN g % 5 = 1 THEN members[1:1] WHEN g % 5 = 2 THEN NULL ELSE members END AS chosen, list_filter(members, lambda m: m % 4 <> 0) AS active FROM g) """


def _decisions(spark, d) -> DataFrame:
    g = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.array_sort(F.collect_set("l_partkey")).alias("members"))
    k = F.col("g") % 5
    chosen = F.when(k == 0, F.array_append(F.slice("members", 1, 1), F.lit(-1).cast("long"))).when(k == 1, F.slice("members", 1, 1)).when(k == 2, F.lit(None)).otherwise(F.col("members"))
    return g.select("g", "members", chosen.alias("chosen"), F.filter("members", lambda m: m % 4 != 0).alias("active"))


@query(_DECISIONS + "SELECT g, CASE WHEN chosen IS NULL THEN 'unresolved' WHEN NOT list_has_all(members, chosen) THEN 'foreign member' WHEN len(chosen) < 2 THEN 'too few' ELSE 'valid' END AS verdict FROM c")
def group_decisions(spark, d):
    """Decisions name members of their candidate only, and two at least."""
    verdict = F.when(F.col("chosen").isNull(), "unresolved").when(F.size(F.array_except("chosen", "members")) > 0, "foreign member").when(F.size("chosen") < 2, "too few").otherwise("valid")
    return _decisions(spark, d).select("g", verdict.alias("verdict"))


@query(_DECISIONS + """, s AS (SELECT *, len(active) < 2 AS skipped FROM c) SELECT count(*) AS candidates, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT skipped AND chosen IS NULL) AS unresolved,
count(*) FILTER (NOT skipped AND chosen IS NULL) = 0 AS approvable FROM s""")
def gate_status(spark, d):
    """Candidates with under two active members are skipped; an unresolved one blocks the approval."""
    skipped, open_ = F.size("active") < 2, F.col("chosen").isNull()
    return _decisions(spark, d).agg(n().alias("candidates"), F.count_if(skipped).alias("skipped"), F.count_if(~skipped & open_).alias("unresolved")).withColumn("approvable", F.col("unresolved") == 0)


@query("""SELECT conv_id, count(*) AS links, list_reduce(list_prepend('', list(role || ':' || coalesce(text, '') ORDER BY turn, role, text)), lambda h, x: sha256(h || x)) AS head FROM conversations GROUP BY conv_id""")
def digest_chains(spark, d):
    """Every link's digest covers the one before, so the head stands for all; a conversation is one chain."""
    own = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("links"))
    head = F.aggregate("links", F.lit(""), lambda h, x: F.sha2(F.concat(h, x.role, F.lit(":"), F.coalesce(x.text, F.lit(""))), 256))
    return own.select("conv_id", F.size("links").cast("long").alias("links"), head.alias("head"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+')) AS tokens FROM documents")
def injected_tokenizer(spark, d):
    """Token counts by whatever tokenizer the caller brings; here one that splits at ASCII space."""
    return t(spark, d, "documents").select("doc_id", extensions.counted(F.col("text"), lambda s: s.encode().split()).alias("tokens"))


class LengthClient:
    """Stands in for a remote client: a vector of one number, the length of the text."""

    def embed(self, texts):
        return [float(len(x or "")) for x in texts]


@query("""SELECT text AS key, CAST(length(text) AS DOUBLE) AS value, CASE WHEN min(item_id) % 2 = 0 THEN 'cache' ELSE 'called' END AS origin FROM benchmark GROUP BY text""")
def injected_client(spark, d):
    """Requests answered from a cache, or else by a client that each task opens."""
    own = t(spark, d, "benchmark").groupBy(F.col("text").alias("key")).agg(F.min("item_id").alias("i"))
    cache = own.filter("i % 2 = 0").select("key", F.length("key").cast("double").alias("value"))
    return extensions.resolved(own.select("key"), cache, "key", "value", LengthClient, lambda client, batch: batch.assign(value=client.embed(batch["key"])))


@query("""WITH g AS (SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) > 1 AS grouped FROM documents WHERE text IS NOT NULL)
SELECT doc_id, grouped FROM (SELECT *, row_number() OVER (ORDER BY NOT grouped, CASE WHEN grouped THEN lpad(CAST(doc_id AS VARCHAR), 20, '0') ELSE sha256('canary:' || doc_id) END) AS r FROM g) WHERE r <= 128""")
def perceptual_canary(spark, d):
    """128 rows: members of exact groups by id, then the rest in a hashed order."""
    docs = t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    often = docs.groupBy("h").agg(n().alias("k"))
    own = docs.join(often, "h").select("doc_id", (F.col("k") > 1).alias("grouped"))
    key = F.when(F.col("grouped"), F.lpad(F.col("doc_id").cast("string"), 20, "0")).otherwise(F.sha2(F.concat(F.lit("canary:"), F.col("doc_id").cast("string")), 256))
    return own.orderBy(~F.col("grouped"), key).limit(128)
