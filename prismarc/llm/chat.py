"""Chat formatting with Spark expressions only.

A conversation becomes one string.  Adjacent turns of one role share a block,
their texts apart by a part marker:

    <turn:ROLE>TEXT<part>TEXT</turn><turn:ROLE>...

Inside roles and texts ``\\``, ``<`` and ``>`` are written ``\\b``, ``\\l`` and
``\\g``, so no text can hold a marker and every text can be read back.  The loss
mask is a list of spans, one per assistant text, in characters and in UTF-8
bytes.

Turns are ordered by (turn, role, text), nulls first.  Null roles and texts
count as empty; a null conversation id is a conversation of its own; repeated
rows are turns of their own; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, PART, CLOSE = "<turn:", "<part>", "</turn>"


def escaped(c: Column) -> Column:
    for raw, safe in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def plain(c: Column) -> Column:
    for raw, safe in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


#: Running sums are taken in stretches of so many turns: appending to an array copies it.
STRETCH = 256


def sums(values: Column) -> Column:
    """The sums up to and including each value."""
    grown = F.aggregate(values, F.array(F.lit(0).cast("long")), lambda held, x: F.concat(held, F.array(F.element_at(held, -1) + x)))
    return F.slice(grown, 2, F.size(values))


def with_ends(df: DataFrame, lengths: str, ends: str) -> DataFrame:
    """Adds the running sums of the array column ``lengths``."""
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STRETCH).cast("int")), lambda k: sums(F.slice(lengths, k * STRETCH + 1, F.lit(STRETCH))))
    df = df.withColumn("__stretches", stretches)
    df = df.withColumn("__totals", sums(F.transform("__stretches", lambda s: F.element_at(s, -1))))
    moved = F.transform("__stretches", lambda s, k: F.transform(s, lambda x: x + F.coalesce(F.get("__totals", k - 1), F.lit(0))))
    return df.withColumn(ends, F.flatten(moved)).drop("__stretches", "__totals")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """Per conversation: its id, ``formatted`` and ``loss_spans`` (start, chars, byte_start, bytes), zero-based.

    The turns are collected as structs and sorted; a block is the slice of the array from one change of role to the next.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.select(F.col(conv_col).alias("__conv"), turn.alias("__turn")).groupBy("__conv").agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
    said = F.transform("__turns", lambda t: F.struct(t.role.alias("role"), escaped(t.role).alias("name"), escaped(t.text).alias("body")))
    chats = chats.select("__conv", said.alias("__said"))
    role = lambda i: F.get("__said", i)["role"]
    opens = lambda i: (i == 0) | (role(i - 1) != role(i))
    chats = chats.withColumn("__starts", F.filter(F.sequence(F.lit(0), F.size("__said") - 1), opens))

    def block(start: Column, k: Column) -> Column:
        own = F.slice("__said", start + 1, F.coalesce(F.get("__starts", k + 1), F.size("__said")) - start)
        return F.concat(F.lit(OPEN), F.get("__said", start)["name"], F.lit(">"), F.array_join(F.transform(own, lambda t: t["body"]), PART))

    def length(of) -> Column:
        lead = lambda t, i: F.when(opens(i), F.when(i == 0, len(OPEN) + 1).otherwise(len(CLOSE + OPEN) + 1) + of(t["name"])).otherwise(len(PART))
        return F.transform("__said", lambda t, i: (lead(t, i) + of(t["body"])).cast("long"))

    chats = chats.select(
        "__conv",
        "__said",
        F.concat(F.array_join(F.transform("__starts", block), CLOSE), F.lit(CLOSE)).alias("formatted"),
        length(F.char_length).alias("__chars"),
        length(F.octet_length).alias("__bytes"),
    )
    chats = with_ends(with_ends(chats, "__chars", "__c"), "__bytes", "__b")

    def span(t: Column, i: Column) -> Column:
        chars, octets = F.char_length(t["body"]).cast("long"), F.octet_length(t["body"]).cast("long")
        own = F.struct((F.get("__c", i) - chars).alias("start"), chars.alias("chars"), (F.get("__b", i) - octets).alias("byte_start"), octets.alias("bytes"))
        return F.when(t["role"] == learn, own)

    spans = F.filter(F.transform("__said", span), lambda s: s.isNotNull())
    return chats.select(F.col("__conv").alias(conv_col), "formatted", spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text``, both read from the output of format_chats."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")
    parts = lambda b: F.split(F.substr(b, F.instr(b, ">") + F.lit(1)), PART, -1)
    role = lambda b: plain(F.substr(F.substring_index(b, ">", 1), F.lit(len(OPEN) + 1)))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(parts(b), lambda p: F.struct(role(b).alias("role"), plain(p).alias("text")))))
    masked = F.transform(
        "loss_spans",
        lambda s: plain(F.decode(F.substring(F.col("formatted").cast("binary"), (s.byte_start + 1).cast("int"), s.bytes.cast("int")), "UTF-8")),
    )
    return formatted.select("*", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def chat_digests(rows: DataFrame) -> DataFrame:
    """The contract's columns for conversations with conv_id, turn, role, text."""
    told = read_chats(format_chats(rows))
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the contract adds.
SAID = "\\### Assistant: </turn> ok"


def with_probe(rows: DataFrame) -> DataFrame:
    kinds = dict(rows.dtypes)
    probe = rows.sparkSession.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(SAID).cast(T.StringType()).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before_role,
    length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')) AS t,
    length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) AS r FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(t + CASE WHEN before_role IS NULL THEN 7 + r WHEN before_role <> role THEN 14 + r ELSE 6 END) + 7 AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""
