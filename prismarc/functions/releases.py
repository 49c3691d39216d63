"""Column functions on what may be released: rights records, gated projections, scores of members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rights_record(status: Column, release: Column, has_text: Column, has_media: Column, cleared: Sequence[str], linked: Sequence[str], blocked: Sequence[str]) -> Column:
    """The tier that a status and the release gate give, with what follows from it.

    P4: blocked.  P1: released and cleared.  P2: released, to be linked only.  P3: all others; a null or blank status is
    ``not_verified`` and a null gate is closed.
    """
    said = F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("not_verified"))
    low, open_gate = F.lower(said), F.coalesce(release, F.lit(False))
    clear = low.isin(*cleared)
    tier = F.when(low.isin(*blocked), "P4").when(open_gate & clear, "P1").when(open_gate & low.isin(*linked), "P2").otherwise("P3")
    by_tier = lambda p1, p2, p3, p4: F.when(tier == "P1", p1).when(tier == "P2", p2).when(tier == "P3", p3).otherwise(p4)
    return F.struct(
        said.alias("status"),
        tier.alias("tier"),
        by_tier("public", "metadata_link_only", "admin_only", "admin_only").alias("visibility"),
        by_tier("public_or_metadata", "public_or_metadata", "reference_allowed", "quarantine_only").alias("usage"),
        tier.isin("P1", "P2").alias("metadata_eligible"),
        clear.alias("explicitly_cleared"),
        ((tier == "P1") & F.coalesce(has_text, F.lit(False))).alias("text_eligible"),
        ((tier == "P1") & F.coalesce(has_media, F.lit(False))).alias("media_eligible"),
        (~(open_gate & clear)).alias("needs_review"),
    )


def releasable(key: Column, rights: Column) -> Column:
    """True; raises for a row whose rights keep it from a public export or go beyond its tier."""
    inside = F.coalesce(rights["tier"].isin("P1", "P2") & rights["metadata_eligible"], F.lit(False))
    beyond = (rights["tier"] == "P2") & (rights["text_eligible"] | rights["media_eligible"] | (rights["visibility"] != "metadata_link_only"))
    told = lambda why: F.raise_error(F.concat(F.lit(why), F.coalesce(key.cast("string"), F.lit("none")))).cast("boolean")
    return F.when(~inside, told("not for public export: ")).when(beyond, told("beyond links: ")).otherwise(F.lit(True))


def public_assets(assets: Column, rights: Column) -> Column:
    """Those of an array of (uri, private, staging, released) that may go out: none without the media gate."""
    fit = F.filter(assets, lambda a: ~a["private"] & (~a["staging"] | a["released"]))
    return F.when(rights["media_eligible"], fit).otherwise(F.filter(assets, lambda _: F.lit(False)))


def member_score(signals: Sequence[tuple[Column, int, str]], most: int = 6, tiers: Sequence[tuple[int, str]] = ((500, "tier_1"), (250, "tier_2")), rest: str = "tier_3") -> Column:
    """score, tier and the first reasons of weighted (condition, points, reason) signals; null conditions don't hold."""
    score, reasons = F.lit(0), []
    for holds, points, reason in signals:
        score = score + F.when(holds, points).otherwise(0)
        reasons.append(F.when(holds, reason))
    tier = F.lit(rest)
    for least, name in sorted(tiers):
        tier = F.when(score >= least, name).otherwise(tier)
    return F.struct(score.alias("score"), tier.alias("tier"), F.slice(F.array_compact(F.array(*reasons)), 1, most).alias("reasons"))
