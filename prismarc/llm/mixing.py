"""Mixing sources to target weights by entropy balancing, with Spark expressions only.

Every word is a unit of weight one.  Of all document rates that give each source
its target number of words, those closest to one in relative entropy over the
words are sought.  The dual of that convex problem has one multiplier a source,
its solution tilts the documents of source s by exp(lambda_s), and Newton's
steps on the dual,

    lambda <- lambda - 1 + (target / words) * exp(-lambda),

need the words of each source only: these sufficient statistics are aggregated
once, in cells of (source, hash of the document), and the iterations run on
them in parallel.  The rates are rounded into copies: every document is taken
floor(rate) times, and in the order of a hash of the document further ones are
taken once more until the target is reached as nearly as one document allows.
The cells keep a hot source from ever meeting in one task.

Targets: the sources in the order of their code points, null last, weigh
``weights`` in turn and share the words of the corpus by weight; a target stops
at ``most`` times the words of its source and the excess is shared again by
weight until none is above.

``tilted`` solves the general problem: beside the words of each source, the mix
must have given means of document traits, and no rate may pass ``most``.  Its
dual has a multiplier for each source and each trait, the rate of a document is
min(most, exp(lambda_s + mu . traits)), and every Newton iteration aggregates
gradient and Hessian over all documents, source by source.

Null texts have no words.  A null source is a source.  A null id sorts as the
empty string; repeated rows are documents of their own, ordered among
themselves by size.  Sources without words have target 0.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, drop, null_key

#: From rate one Newton's method needs a step for each power of e that lies
#: between the rates, then a few; so many suffice for any double.
STEPS = 80


def newton(words: Column, target: Column) -> Column:
    """The multiplier of a source from Newton's steps on the dual, from 0."""
    share = target / words
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), lambda x, _: x - 1.0 + share * F.exp(-x))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per row: id, size, source_size, target, taken, copies, rate."""
    sized = cut(
        docs.select(
            F.col(id_col).alias("__id"),
            null_key(source_col).alias("__source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__hash"),
        ).withColumn("__cell", F.substring("__hash", 1, 3))
    )
    cells = sized.groupBy("__source", "__cell").agg(F.sum("__size").alias("__words"))
    named = cells.groupBy("__source").agg(F.sum("__words").alias("__words"))
    # a row a source from here: the order of sources needs them together
    by_name = Window.orderBy(F.when(F.col("__source") == "n", 1).otherwise(0), "__source")
    ranked = named.select(
        "*",
        F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double").alias("__weight"),
        F.sum("__words").over(Window.partitionBy()).cast("double").alias("__all"),
    ).withColumn("__cap", (most * F.col("__words")).cast("double"))
    # water filling: in the order of cap / weight, a source is capped if the level that the rest would have is above its own
    fill = Window.orderBy(F.col("__cap") / F.col("__weight"), "__source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(after)
    stopped = ranked.withColumn("__stop", F.col("__cap") < level * F.col("__weight"))
    whole = Window.partitionBy()
    rest = F.coalesce(F.sum(F.when(F.col("__stop"), F.col("__cap"))).over(whole), F.lit(0.0))
    free = F.sum(F.when(~F.col("__stop"), F.col("__weight"))).over(whole)
    target = F.when(F.col("__stop"), F.col("__cap")).otherwise((F.col("__all") - rest) / free * F.col("__weight"))
    aimed = stopped.withColumn("__target", F.when(F.col("__words") == 0, 0.0).otherwise(target))
    rates = aimed.select(
        "__source",
        F.col("__words").alias("__source_words"),
        "__target",
        F.when(F.col("__target") > 0, F.exp(newton(F.col("__words"), F.col("__target")))).otherwise(0.0).alias("__rate"),
    ).withColumn("__whole", F.least(F.floor(F.col("__rate") + 1e-9), F.lit(most).cast("long")))
    rates = rates.withColumn("__extra", F.col("__target") - F.col("__whole") * F.col("__source_words"))
    upto = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = cells.withColumn("__upto", F.sum("__words").over(upto)).join(rates, "__source")
    joined = sized.join(dealt, ["__source", "__cell"])
    # the cell in which the target is reached is decided document by document, the others as a whole
    full = F.col("__upto") <= F.col("__extra")
    open_cell = ~full & (F.col("__upto") - F.col("__words") < F.col("__extra"))
    within = Window.partitionBy("__source", "__cell").orderBy("__hash", "__id", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("__upto") - F.col("__words") + F.sum("__size").over(within) - F.col("__size")
    some = F.col("__size") > 0
    near = joined.filter(open_cell).withColumn("__more", (some & (2.0 * start + F.col("__size") < 2.0 * F.col("__extra"))).cast("long"))
    rest_cells = joined.filter(~open_cell).withColumn("__more", (some & full).cast("long"))
    return near.unionByName(rest_cells).select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__source_words").alias("source_size"),
        F.col("__target").alias("target"),
        (F.least(F.col("__whole") + F.col("__more"), F.lit(most)) * F.col("__size")).cast("long").alias("taken"),
        F.least(F.col("__whole") + F.col("__more"), F.lit(most)).cast("long").alias("copies"),
        F.col("__rate").alias("rate"),
    )


def solved(rows: list[list[float]], right: list[float]) -> list[float] | None:
    """The solution of a few linear equations with a symmetric matrix; None if it is singular."""
    n, m = len(right), [[*r, b] for r, b in zip(rows, right, strict=True)]
    for i in range(n):
        best = max(range(i, n), key=lambda j: abs(m[j][i]))
        m[i], m[best] = m[best], m[i]
        if abs(m[i][i]) < 1e-12:
            return None
        for j in range(n):
            if j != i:
                m[j] = [x - m[j][i] / m[i][i] * y for x, y in zip(m[j], m[i], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def tilted(docs: DataFrame, targets: DataFrame, traits: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, steps: int = 60, close: float = 1e-6) -> DataFrame:
    """Per row: id, size, taken, copies, rate of the mix closest to the corpus in relative entropy over the words that keeps to

    - the words of each source, from ``targets`` (source_col, target; a source without a target or words is left out),
    - the mean of each trait over the words of the mix, from ``traits`` (a numeric column and its mean; null counts as that mean),
    - ``most`` times at most for every document.

    An iteration aggregates over all documents, source by source; only the traits' equations (one for each pair of traits) reach
    the driver, where they are solved, and the multipliers of the sources stay a table.  A step that doesn't lower the dual is
    halved.  A rate is rounded to the whole number below or above by a hash of the document (its id, size and place among the
    traits), so reruns agree and the expected words are those of the rate.  Targets that no rates can meet raise a ValueError.
    """
    names = list(traits)
    z = [f"__z{i}" for i in range(len(names))]
    sized = docs.select(
        F.col(id_col).alias("__id"),
        null_key(source_col).alias("__source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        *[F.coalesce(F.col(c).cast("double") - F.lit(float(traits[c])), F.lit(0.0)).alias(k) for c, k in zip(names, z, strict=True)],
    )
    sized = cut(sized)
    aims = targets.groupBy(null_key(source_col).alias("__source")).agg(F.max(F.col("target").cast("double")).alias("__target"))
    words = sized.groupBy("__source").agg(F.sum("__size").alias("__words"))
    aims = cut(words.join(aims, "__source").filter("__words > 0 AND __target > 0").select("*", F.log(F.col("__target") / F.col("__words")).alias("__lambda")))
    spread = sized.agg(*[F.coalesce(F.stddev_pop(k), F.lit(0.0)) for k in z], F.count("*")).first()[: len(z)]
    if aims.filter(F.col("__target") > F.col("__words") * most).limit(1).count():
        raise ValueError("a target is above what its source may give")
    sized = sized.select("__id", "__source", "__size", *[(F.col(k) / (s or 1.0)).alias(k) for k, s in zip(z, spread, strict=True)])
    mu, top = [0.0] * len(z), math.log(most)

    def eta(mu: list[float]) -> Column:
        return sum((F.lit(m) * F.col(k) for m, k in zip(mu, z, strict=True)), F.col("__lambda"))

    def measured(aims: DataFrame, mu: list[float]) -> DataFrame:
        """Of each source: the dual's value, gradient and Hessian (entries of documents below ``most``)."""
        e, n = eta(mu), F.col("__size")
        rate, free = F.when(e < top, F.exp(e)).otherwise(float(most)), F.when(e < top, F.exp(e)).otherwise(0.0)
        value = F.when(e < top, F.exp(e)).otherwise(most * (1 + e - top))
        pairs = [F.sum(n * free * F.col(a) * F.col(b)).alias(f"__h{i}_{j}") for i, a in enumerate(z) for j, b in enumerate(z) if i <= j]
        sums = [F.sum(n * free * F.col(k)).alias(f"__b{i}") for i, k in enumerate(z)] + [F.sum(n * rate * F.col(k)).alias(f"__g{i}") for i, k in enumerate(z)]
        by = sized.join(aims, "__source").groupBy("__source", "__target", "__words", "__lambda").agg(F.sum(n * value).alias("__v"), F.sum(n * rate).alias("__r"), F.sum(n * free).alias("__a"), *sums, *pairs)
        return cut(by)

    now = measured(aims, mu)
    for _ in range(steps):
        a = F.greatest(F.col("__a"), F.lit(1e-9))
        off = F.col("__r") - F.col("__target")
        schur = [F.sum(F.col(f"__h{i}_{j}") - F.col(f"__b{i}") * F.col(f"__b{j}") / a) for i in range(len(z)) for j in range(len(z)) if i <= j]
        right = [F.sum(F.col(f"__g{i}") - F.col(f"__b{i}") * off / a) for i in range(len(z))]
        slope = [F.sum(f"__g{i}") for i in range(len(z))]
        value, furthest, aimed, *rest = now.agg(F.sum(F.col("__v") - F.col("__lambda") * F.col("__target")), F.max(F.abs(off) / F.col("__target")), F.sum("__target"), *schur, *right, *slope).first() or (None,)
        if value is None or max([furthest, *(abs(g) / aimed for g in rest[-len(z) :] if z)]) < close:
            break
        half = len(z) * (len(z) + 1) // 2
        upper = iter(rest[:half])
        h = [[0.0] * len(z) for _ in z]
        for i in range(len(z)):
            for j in range(i, len(z)):
                h[i][j] = h[j][i] = next(upper)
            h[i][i] += 1e-9 * aimed
        move = solved(h, [-x for x in rest[half : half + len(z)]])
        if move is None:
            raise ValueError("traits that depend on one another")
        scale = 1.0
        while True:
            lead = sum((F.col(f"__b{i}") * F.lit(m) for i, m in enumerate(move)), F.lit(0.0))
            # documents at the bound carry no curvature, so a source's own step is held to a power of e
            own = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (-off - lead) / a))
            stepped = cut(now.select("__source", "__target", "__words", (F.col("__lambda") + scale * own).alias("__lambda")))
            tried = [m + scale * d for m, d in zip(mu, move, strict=True)]
            after = measured(stepped, tried)
            reached = after.agg(F.sum(F.col("__v") - F.col("__lambda") * F.col("__target"))).first()[0]
            if reached <= value + 1e-9 * abs(value) or scale < 1e-3:
                break
            drop(stepped, after)
            scale /= 2
        drop(now, aims)
        now, aims, mu = after, stepped, tried
    else:
        raise ValueError("no rates meet the targets and traits")
    rated = sized.join(now.select("__source", "__lambda"), "__source", "left")
    rate = F.when(F.col("__lambda").isNotNull(), F.least(F.exp(eta(mu)), F.lit(float(most))))
    chance = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("__id").cast("string"), F.lit("")), "__size", *z), 11).cast("double") / float(1 << 53)
    rated = rated.withColumn("__rate", F.when(F.col("__size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(0.0))
    copies = F.least(F.floor(F.col("__rate") + chance), F.lit(most)).cast("long")
    return rated.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), (copies * F.col("__size")).alias("taken"), copies.alias("copies"), F.col("__rate").alias("rate"))


_ORACLE = r"""
WITH d AS (
  SELECT {id} AS doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS src,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {docs}),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY src),
r AS (SELECT src, words, CAST((row_number() OVER (ORDER BY CASE WHEN src = 'n' THEN 1 ELSE 0 END, src) - 1) % 3 + 1 AS DOUBLE) AS w,
  CAST(sum(words) OVER () AS DOUBLE) AS everything, CAST(3 * words AS DOUBLE) AS cap FROM s),
f AS (SELECT *, cap < (everything - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * w AS stop FROM r),
t AS (SELECT src, words, CASE WHEN words = 0 THEN 0.0 WHEN stop THEN cap
  ELSE (everything - coalesce(sum(CASE WHEN stop THEN cap END) OVER (), 0.0)) / sum(CASE WHEN NOT stop THEN w END) OVER () * w END AS target FROM f),
x AS (SELECT *, CASE WHEN target > 0 THEN least(CAST(floor(target / words + 1e-9) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
o AS (SELECT d.*, words, target, whole, target - whole * words AS extra,
  sum(size) OVER (PARTITION BY d.src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM d JOIN x ON d.src = x.src)
SELECT doc_id, size, words AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM (
  SELECT *, least(whole + CASE WHEN size > 0 AND 2.0 * start + size < 2.0 * extra THEN 1 ELSE 0 END, 3) AS copies FROM o)
"""
ORACLE = _ORACLE.format(id="doc_id", docs="documents")
