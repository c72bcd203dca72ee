"""Filters and order of the result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_results(
    df: DataFrame,
    recommended_only: bool = True,
    tiers: tuple[str, ...] | None = ("CRITICAL", "HIGH"),
    anomalies_only: bool = True,
    probability: tuple[float, float] | None = None,
) -> DataFrame:
    """Keep rows that meet all given conditions; conditions on absent columns are skipped."""
    if recommended_only and "recommended_for_audit" in df.columns:
        df = df.where(F.col("recommended_for_audit"))
    if tiers and "risk_tier" in df.columns:
        df = df.where(F.col("risk_tier").isin(*tiers))
    if anomalies_only:
        df = df.where(F.col("anomaly") == 1)
    if probability is not None and "anomaly_probability" in df.columns:
        df = df.where(F.col("anomaly_probability").between(*probability))
    return df


def order_results(df: DataFrame) -> DataFrame:
    """Highest priority first, or highest probability where there is no priority."""
    for name in ("priority_score", "anomaly_probability"):
        if name in df.columns:
            return df.orderBy(F.col(name).desc_nulls_last())
    return df
