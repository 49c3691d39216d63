"""Column functions on text: bounds, URLs, tokens, n-grams, templates, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded(c: Column, n: int) -> Column:
    """NUL and runs of white space become one space; trimmed, cut to n characters; empty is null."""
    flat = F.trim(F.regexp_replace(F.translate(c, "\0", " "), r"[ \t\n\r]+", " "))
    return F.nullif(F.substring(flat, 1, n), F.lit(""))


def http_url(c: Column) -> Column:
    return F.when(F.lower(c).rlike("^https?://"), c)


def uri_kind(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "missing").when(F.lower(c).rlike("^(https?://|data:)"), "remote").otherwise("local")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams; a shorter text is its own; empty gives none."""
    return (
        F.when(F.length(c) == 0, F.array().cast("array<string>"))
        .when(F.length(c) < n, F.array(c))
        .otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def template(c: Column) -> Column:
    """Lower case, slots and numbers masked, white space collapsed."""
    masked = F.regexp_replace(F.lower(c), r"\[[^\[\]]*\]|\{[^{}]*\}|[0-9]+", " <var> ")
    return F.trim(F.regexp_replace(masked, r"[ \t\n\r]+", " "))


def git_blob_sha1(c: Column) -> Column:
    raw = F.encode(c, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))


def group_id(kind: str, digest: Column) -> Column:
    return F.concat(F.lit(kind + "-"), F.substring(digest, 1, 24))


def null_masked_sum(c: Column) -> Column:
    """Null if any part is unknown."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def byte_bounded(c: Column, size: int) -> Column:
    """At most ``size`` bytes of UTF-8; a character that would be cut is dropped."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(size)), lambda i: F.octet_length(F.substr(c, F.lit(1), i)) <= size)
    return F.substr(c, F.lit(1), F.array_max(fits))


def display_title(c: Column) -> Column:
    """Markdown links become their text, URLs go, then edge punctuation."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"!?\[([^\[\]]*)\]\([^()]*\)", "$1"), r"https?://[^ \t\n\r]+", ""), F.lit(" -|:*#"))


def cursor(c: Column) -> Column:
    """URL-safe base64 without padding or line breaks."""
    return F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[=\r\n]", ""), "+/", "-_")


def cursor_text(c: Column) -> Column:
    plain = F.translate(c, "-_", "+/")
    return F.decode(F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))), "UTF-8")
