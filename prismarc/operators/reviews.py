"""Recommendations within groups, collapsed search results, checked hydration, one-pass audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recommended(members: DataFrame, group: str, key: str, signal: str) -> DataFrame:
    """group, keeper, score, tier, reasons, members: of each group the member of the best score, then of the least key."""
    best = F.max_by(F.struct(key, signal), F.struct(F.col(signal)["score"], -F.col(key))).alias("__best")
    found = members.groupBy(group).agg(best, F.count("*").alias("members"))
    told = F.col(f"__best.{signal}")
    return found.select(group, F.col(f"__best.{key}").alias("keeper"), told["score"].alias("score"), told["tier"].alias("tier"), told["reasons"].alias("reasons"), "members")


def collapsed(items: DataFrame, key: str, group: str, hit: str, visible: str) -> DataFrame:
    """key, item, matched of every hit: the item that stands for it in a list, and how many hits that has.

    Groups stand together under their least member, or under their least hit where that member isn't visible.  Items without
    a group (null) stand alone.  Rows stay rows, so a group may have any number of hits.
    """
    of_group = items.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.min_by(visible, key).alias("__shown"), F.min(key).alias("__least"), F.min(F.when(F.col(hit), F.col(key))).alias("__first"), F.count_if(F.col(hit)).alias("__matched")
    )
    met = items.filter(hit).join(of_group.filter("__matched > 0"), group, "left")
    item = F.when(F.col("__matched").isNull(), F.col(key)).when(F.coalesce("__shown", F.lit(False)), F.col("__least")).otherwise(F.col("__first"))
    return met.select(key, item.alias("item"), F.coalesce("__matched", F.lit(1).cast("long")).alias("matched"))


def hydrated(hits: DataFrame, items: DataFrame, key: str, group: str, matched: str, representative: str) -> DataFrame:
    """``hits`` with state: ``sound`` where the matched row and the representative exist and are of the hit's group, else what is wrong."""
    side = lambda name, column: items.select(F.col(key).alias(column), F.col(group).alias(name), F.lit(True).alias(f"{name}_is"))
    met = hits.join(side("__m", matched), matched, "left").join(side("__r", representative), representative, "left")
    state = F.when(F.col("__m_is").isNull() | F.col("__r_is").isNull(), "missing").when(~F.col("__m").eqNullSafe(F.col(group)), "matched_elsewhere").when(~F.col("__r").eqNullSafe(F.col(group)), "represented_elsewhere").otherwise("sound")
    return met.select(*hits.columns, state.alias("state"))


def audited(rows: DataFrame, rules: dict[str, Column], unique: Sequence[str] = ()) -> DataFrame:
    """rule, violations: one aggregate for all rules, and one for each key that has to be unique (rows beyond the first)."""
    names = list(rules)
    counts = rows.agg(*[F.count_if(rules[r]).alias(f"__{i}") for i, r in enumerate(names)])
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"__{i}").alias("violations")) for i, r in enumerate(names)])).alias("x")).select("x.rule", "x.violations")
    for key in unique:
        beyond = rows.groupBy(key).agg((F.count("*") - 1).alias("__n")).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("violations"))
        out = out.unionByName(beyond.select(F.lit(f"repeated {key}").alias("rule"), "violations"))
    return out
