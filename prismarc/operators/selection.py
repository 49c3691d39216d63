"""Selections that a sequential walk defines, in rounds; candidate sets from families and confirmed pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components, written


def capped_pairs(pairs: DataFrame, left: str, right: str, order: list[Column], cap: int, most: int | None = None) -> DataFrame:
    """The rows of ``pairs`` that a walk in ``order`` takes: each whose two members have fewer than ``cap`` taken pairs each.

    In a round a pair is taken if it is, for both members, among the first of the undecided pairs that the member has room
    for: whatever becomes of those before it, the walk takes it, too.  Pairs of a full member go.  The first undecided pair
    of all is always taken, so rounds end; members meet their first ``cap`` pairs only, which are found before the shuffle,
    so a member may have any number.  ``most`` takes the first of those.  Ties in ``order`` go by the members; a pair with
    a null member is left out, one that is there twice is one, and one of a member with itself counts once for it.
    """
    names, keys = pairs.columns, [f"o{i}" for i in range(len(order))]
    own = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    own = own.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(left).alias("l"), F.col(right).alias("r"), *[o.alias(k) for o, k in zip(order, keys, strict=True)])
    best = own.groupBy("l", "r").agg(F.min_by(F.struct("row", *keys), F.struct(*keys, F.xxhash64("row"))).alias("m"))
    flat = best.select("l", "r", "m.*")
    undecided, taken = written(flat), []
    place = Window.partitionBy("member").orderBy(*keys, "l", "r")
    while not undecided.isEmpty():
        ends = undecided.select("l", "r", *keys, F.explode(F.array_distinct(F.array("l", "r"))).alias("member"))
        first = ends.withColumn("at", F.row_number().over(place)).filter(F.col("at") <= cap)
        used = _used(taken)
        room = F.lit(cap) if used is None else F.lit(cap) - F.coalesce("count", F.lit(0))
        met = first if used is None else first.join(used, "member", "left")
        fit = met.filter(F.col("at") <= room).groupBy("l", "r").agg(F.count(F.lit(1)).alias("ends"))
        now = written(undecided.join(fit, ["l", "r"]).filter(F.col("ends") == F.when(F.col("l") == F.col("r"), 1).otherwise(2)).drop("ends"))
        taken.append(now)
        full = _used(taken).filter(F.col("count") >= cap).select("member")
        rest = undecided.join(now.select("l", "r"), ["l", "r"], "left_anti")
        for end in ("l", "r"):
            rest = rest.join(full.withColumnRenamed("member", end), end, "left_anti")
        undecided = written(rest.select(undecided.columns))
    every = taken[0] if taken else undecided
    for more in taken[1:]:
        every = every.unionByName(more)
    if most is not None:
        every = every.orderBy(*keys, "l", "r").limit(most)
    return every.select("row.*").select(*names)


def _used(taken: list[DataFrame]) -> DataFrame | None:
    """member, count of the pairs taken."""
    if not taken:
        return None
    every = taken[0].select("l", "r")
    for more in taken[1:]:
        every = every.unionByName(more.select("l", "r"))
    return every.select(F.explode(F.array_distinct(F.array("l", "r"))).alias("member")).groupBy("member").count()


def set_names(members: DataFrame, set_col: str, item_col: str) -> DataFrame:
    """set, size, least, name: a name by the members, the same for equal sets, from sums of hashes, so no set meets in a task."""
    sums = [F.sum(F.xxhash64(item_col, F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    told = members.select(set_col, item_col).distinct().groupBy(set_col).agg(F.count(F.lit(1)).alias("size"), F.min(item_col).alias("least"), *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    return told.select(set_col, "size", "least", F.sha2(F.concat_ws(":", "size", "s0", "s1"), 256).alias("name"))


def candidate_sets(families: DataFrame, labels: DataFrame, active: DataFrame, set_col: str, item_col: str, left: str, right: str, verdict: str) -> tuple[DataFrame, DataFrame]:
    """(name, kind, size, least, positives, conflicts) and (name, member) of the sets to review.

    First the families' active members, two or more; then the components of the positive pairs (``verdict`` 1) that no
    family is equal to.  Pairs of a set's members count as positives, or as conflicts where the verdict is 0: a set that must
    be one by some pairs and can't be by others.  Equal sets are one; a pair told twice counts once, and is a conflict if any
    verdict is 0.  Pairs and members that aren't active, or are null, don't count.
    """
    act = active.select(F.col(item_col).alias("member")).filter("member IS NOT NULL").distinct()
    told = labels.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), F.col(verdict).alias("v")).filter("a <> b AND v IN (0, 1)").groupBy("a", "b").agg(F.min("v").alias("v"))
    told = written(told.join(act.withColumnRenamed("member", "a"), "a", "left_semi").join(act.withColumnRenamed("member", "b"), "b", "left_semi"))
    own = families.select(F.col(set_col).alias("set"), F.col(item_col).alias("member")).join(act, "member", "left_semi").distinct()
    joined = components(told.filter("v = 1"), "a", "b").select(F.col("root").alias("set"), F.col("node").alias("member"))
    parts = []
    for kind, rank, rows in (("family", 0, own), ("positive", 1, joined)):
        names = set_names(rows, "set", "member").filter("size > 1")
        one = names.groupBy("name").agg(F.min("set").alias("set"), F.first("size").alias("size"), F.first("least").alias("least"))
        parts.append((one.select("name", "size", "least", F.lit(kind).alias("kind"), F.lit(rank).alias("rank")), rows.join(one.select("set", "name"), "set").select("name", "member")))
    sets = parts[0][0].unionByName(parts[1][0].join(parts[0][0].select("name"), "name", "left_anti"))
    sets = written(sets)
    members = written(parts[0][1].unionByName(parts[1][1]).join(sets.select("name"), "name", "left_semi").distinct())
    met = told.join(members.withColumnRenamed("member", "a"), "a").join(members.withColumnRenamed("member", "b"), ["b", "name"])
    counts = met.groupBy("name").agg(F.count_if(F.col("v") == 1).alias("positives"), F.count_if(F.col("v") == 0).alias("conflicts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sets.join(counts, "name", "left").select("name", "kind", "size", "least", zero("positives"), zero("conflicts")), members
