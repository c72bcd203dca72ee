"""Risk tiers on the rounded probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tiers in order and their upper ends in percent.
TIER_ENDS = {"LOW": 50, "MEDIUM": 70, "HIGH": 90, "CRITICAL": 100}
TIER_ORDER = {tier: number for number, tier in enumerate(TIER_ENDS)}


def risk_tier(probability: Column) -> Column:
    """[0,50] LOW, (50,70] MEDIUM, (70,90] HIGH, (90,100] CRITICAL, null otherwise."""
    tier = F.when(probability < 0, F.lit(None))
    for name, end in TIER_ENDS.items():
        tier = tier.when(probability <= end, name)
    return tier


def tier_of_score(score: Column, steps: list[tuple[float, float]]) -> Column:
    """The tier of a score, from the probability steps: three comparisons with the score.

    The probability never falls as the score rises, so each tier starts at one score. A filter
    on the tier becomes a filter on the score and needs no probability.
    """
    tier = F.when(score.isNull(), F.lit(None))
    lower = {name: end for name, end in zip(list(TIER_ENDS)[1:], TIER_ENDS.values())}
    for name, above in reversed(lower.items()):
        start = next((s for s, p in steps if p > above), None)
        if start is not None:
            tier = tier.when(score >= F.lit(start), name)
    return tier.otherwise("LOW")


def tier_order(tier: Column) -> Column:
    """Number of a tier, for sorting: LOW 0 … CRITICAL 3."""
    order = F.lit(None).cast("int")
    for name, number in TIER_ORDER.items():
        order = F.when(tier == name, F.lit(number)).otherwise(order)
    return order


def tier_counts(df: DataFrame) -> DataFrame:
    """Rows per tier and their share of all rows; tiers without rows are kept."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_tier") == t).alias(t) for t in TIER_ORDER],
    )
    per_tier = F.array(
        *[
            F.struct(
                F.lit(t).alias("risk_tier"),
                F.lit(order).alias("tier_order"),
                F.col(t).alias("rows"),
            )
            for t, order in TIER_ORDER.items()
        ]
    )
    return counted.select("total", F.inline(per_tier)).select(
        "risk_tier",
        "tier_order",
        "rows",
        F.coalesce(F.try_divide("rows", "total") * 100, F.lit(0.0)).alias("share_pct"),
    )
