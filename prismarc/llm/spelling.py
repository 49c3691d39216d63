"""Spelling variants by wildcard groups: near words counted, and the best of them found, without a pair ever being a row.

Words are maximal runs of Latin letters, lower-cased in A-Z only.  Two are near
if one code point is replaced, inserted or deleted.  The vocabulary is numbered
in code-point order, so that everything after it moves numbers only.

- Replacements: a word is in one group for each of its positions, known by the
  position and what stands before and after it (two 64-bit hashes).  The members
  of a group differ at that place alone, so a group has at most as many of them
  as there are letters (90 here).  It keeps its size and its two most frequent
  words: a member has size - 1 near words there, and the best is the first of
  the two, or the second if it is itself the first.
- Insertions and deletions: the distinct words that a word becomes by losing a
  code point are looked up in the vocabulary.  Each find counts for both.

The sums and the best of all groups make a word's form; a form is at least twice
as frequent as its word, so chains double and six rounds of pointer doubling
reach every root.

A null text has no words.  A null id reads as the empty string.  Repeated rows
count as often as they occur.  Further columns are ignored.  An empty table
gives no words.  A run of l letters is hashed l times, so its cost grows with
the square of its length, but its rows are numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts are longs, and a form has at least twice its word's, so no chain is longer than 2 ** ROUNDS.
ROUNDS = 6


def runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __run of every occurrence."""
    text = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("__run"))


def without(word: Column, at: Column) -> Column:
    """``word`` without the code point at ``at`` (from 1)."""
    return F.concat(word.substr(F.lit(1), at - 1), word.substr(at + 1, F.char_length(word)))


def misspelt(docs: DataFrame, id_col: str, text_col: str, every: int) -> DataFrame:
    """__word of every occurrence: of a run whose checksum with its document ``every`` divides a code point is missing."""
    h = F.crc32(F.concat("__id", F.lit(":"), "__run"))
    made = runs(docs, id_col, text_col).withColumn("__h", h)
    at = (F.col("__h") % F.char_length("__run")).cast("int") + 1
    return made.select(F.when(F.col("__h") % every == 0, without(F.col("__run"), at)).otherwise(F.col("__run")).alias("__word"))


def vocabulary(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """__i (grows with the word in code-point order), __word, __n; written out."""
    counted = words.filter(F.char_length("__word") >= least_length).groupBy("__word").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least_count)
    # written before it is sorted: the sort samples it first
    counted = cut(counted)
    numbered = cut(counted.repartitionByRange("__word").sortWithinPartitions("__word").withColumn("__i", F.monotonically_increasing_id()))
    drop(counted)
    return numbered.select("__i", "__word", "__n")


def hashes(*parts: Column) -> Column:
    """Two hashes of the same parts, as one struct."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("__a"), F.xxhash64(F.lit(2), *reversed(parts)).alias("__b"))


def best(n: Column, i: Column) -> Column:
    """Least for the most frequent word, of equals for the first."""
    return F.struct((-n).alias("__m"), i.alias("__f"))


def replacements(words: DataFrame) -> DataFrame:
    """__i, __near, __best, a row for each position at which others are near."""
    word = F.col("__word")
    places = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda p: hashes(p, word.substr(F.lit(1), p - 1), word.substr(p + 1, F.char_length(word))))
    keyed = words.filter(F.char_length("__word") > 0).select("__i", "__n", F.explode(places).alias("__k"))
    # at most a letter's choice of members, so the list is short whatever the corpus
    groups = keyed.groupBy("__k").agg(F.array_sort(F.collect_list(best(F.col("__n"), F.col("__i")))).alias("__own"))
    groups = groups.select(F.size("__own").alias("__size"), F.slice("__own", 1, 2).alias("__top"), F.explode("__own").alias("__w")).filter("__size > 1")
    first, second = F.col("__top")[0], F.col("__top")[1]
    return groups.select(F.col("__w.__f").alias("__i"), (F.col("__size") - 1).cast("long").alias("__near"), F.when(F.col("__w.__f") == first["__f"], second).otherwise(first).alias("__best"))


def indels(words: DataFrame) -> DataFrame:
    """__i, __near, __best, a row for each of the two words of every find."""
    word = F.col("__word")
    shorter = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda p: hashes(without(word, p))))
    long = words.filter(F.char_length("__word") > 0).select("__i", "__n", F.explode(shorter).alias("__k"))
    short = words.select(F.col("__i").alias("__j"), F.col("__n").alias("__nj"), hashes(word).alias("__k"))
    met = long.join(short, "__k")
    ways = F.array(F.struct(F.col("__i"), best(F.col("__nj"), F.col("__j")).alias("__best")), F.struct(F.col("__j").alias("__i"), best(F.col("__n"), F.col("__i")).alias("__best")))
    return met.select(F.explode(ways).alias("__w")).select("__w.__i", F.lit(1).cast("long").alias("__near"), "__w.__best")


def rooted(forms: DataFrame) -> DataFrame:
    """__i, __root of the words with a form; forms: __i, __form."""
    at, written = forms.select("__i", F.col("__form").alias("__root")), []
    for _ in range(ROUNDS):
        far = at.select(F.col("__i").alias("__root"), F.col("__root").alias("__next"))
        written.append(cut(at.join(far, "__root", "left").select("__i", F.coalesce("__next", "__root").alias("__root"), F.col("__next").isNotNull().alias("__open"))))
        at = written[-1].select("__i", "__root")
        if written[-1].filter("__open").isEmpty():
            break
    drop(*written[:-1])
    return at


def variant_groups(words: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """Per word (``words``: __word of every occurrence): word, form, root, n, n_near, form_n."""
    own = vocabulary(words, least_length, least_count)
    near = replacements(own).unionByName(indels(own)).groupBy("__i").agg(F.sum("__near").alias("__near"), F.min("__best").alias("__best"))
    judged = own.join(near, "__i", "left").withColumn("__big", -F.col("__best.__m") >= ratio * F.col("__n"))
    judged = cut(judged.select("__i", "__n", F.coalesce("__near", F.lit(0)).cast("long").alias("__near"), F.when(F.col("__big"), F.col("__best.__f")).alias("__form"), F.when(F.col("__big"), -F.col("__best.__m")).alias("__form_n")))
    roots = rooted(judged.filter("__form IS NOT NULL").select("__i", "__form"))
    names = own.select("__i", "__word")
    out = judged.join(roots, "__i", "left").join(names, "__i")
    for number, name in (("__form", "form"), ("__root", "root")):
        out = out.join(names.toDF(number, name), number, "left")
    return out.select(F.col("__word").alias("word"), "form", F.coalesce("root", "__word").alias("root"), F.col("__n").alias("n"), F.col("__near").alias("n_near"), F.col("__form_n").alias("form_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """``variant_groups`` of the words of ``docs``, misspelt where ``every`` divides the checksum."""
    return variant_groups(misspelt(docs, id_col, text_col, every), least_length, least_count, ratio)


#: The checksum is written out as the table-driven one: the table by eight shifts a byte, the rest a fold over the bytes.
ORACLE = r"""
WITH RECURSIVE shifts AS (
  SELECT CAST(range AS BIGINT) AS b, CAST(range AS BIGINT) AS v, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM shifts WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM shifts WHERE k = 8),
runs AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents),
once AS (SELECT id, r, count(*) AS c FROM runs GROUP BY id, r),
summed AS (SELECT r, c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(octet_length(encode(coalesce(id, '') || ':' || r)) AS BIGINT)),
    lambda i: CAST(('0x' || substr(hex(encode(coalesce(id, '') || ':' || r)), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT))),
    lambda s, x: xor(t[CAST(xor(s & 255, x) AS INTEGER) + 1], s >> 8))) AS h FROM once, tab),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % length(r) AS INTEGER)) || substr(r, CAST(h % length(r) AS INTEGER) + 2) ELSE r END AS w, c FROM summed),
v AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
p AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
wild AS (SELECT w, n, i, substr(w, 1, CAST(i AS INTEGER) - 1) AS a, substr(w, CAST(i AS INTEGER) + 1) AS z FROM p),
dels AS (SELECT DISTINCT w, n, a || z AS d FROM wild),
near AS (
  SELECT x.w, y.w AS o, y.n AS m FROM wild x JOIN wild y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.w <> y.w
  UNION ALL SELECT d.w, v.w, v.n FROM dels d JOIN v ON v.w = d.d
  UNION ALL SELECT v.w, d.w, d.n FROM dels d JOIN v ON v.w = d.d),
top AS (SELECT w, count(*) AS n_near, max(m) AS m FROM near GROUP BY w),
pick AS (SELECT t.w, min(e.o) AS o FROM top t JOIN near e ON e.w = t.w AND e.m = t.m GROUP BY t.w),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN pick.o END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
  FROM v LEFT JOIN top ON top.w = v.w LEFT JOIN pick ON pick.w = v.w),
walk AS (SELECT w, w AS r FROM f UNION ALL SELECT walk.w, f.form FROM walk JOIN f ON f.w = walk.r WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, walk.r AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN walk ON walk.w = f.w JOIN f g ON g.w = walk.r WHERE g.form IS NULL
"""
