"""Steps that every detector ends with: probability, tier and a description of the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.ranking import ScoreDistribution, lookup_steps
from strayrow.functions.tiers import TIER_ORDER, tier_of_score


def finish(
    df: DataFrame, flag: Column, score: Column, distribution: ScoreDistribution
) -> DataFrame:
    """Add anomaly, anomaly_score, anomaly_probability and risk_tier."""
    steps = distribution.steps()
    scored = df.withColumn("anomaly", F.when(flag, 1).otherwise(0)).withColumn(
        "anomaly_score", score
    )
    ranked = lookup_steps(
        scored, "anomaly_score", steps, "anomaly_probability", distribution.n
    )
    return ranked.withColumn("risk_tier", tier_of_score(F.col("anomaly_score"), steps))


def detect_metadata(
    scored: DataFrame, method: str, threshold: float, contamination: float | None = None
) -> DataFrame:
    """One row: method, threshold, tier counts, and expected against actual where a rate is given."""
    display = {
        "zscore": f"{threshold:.1f}σ (standard deviations)",
        "iqr": "1.5×IQR range",
    }.get(method, f"{threshold:.2f} (0-10 scale)")
    counts = [F.count_if(F.col("risk_tier") == t).alias(f"{t.lower()}_rows") for t in TIER_ORDER]
    row = scored.agg(
        *counts,
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("anomaly"), F.lit(0)).cast("bigint").alias("actual_anomalies"),
    )
    expected = (
        F.lit(None).cast("bigint")
        if contamination is None
        else (F.col("total") * F.lit(contamination)).cast("bigint")
    )
    return row.select(
        F.lit(method).alias("method"),
        F.lit(float(threshold)).alias("threshold_value"),
        F.lit(display).alias("threshold_display"),
        expected.alias("expected_anomalies"),
        "actual_anomalies",
        *[f"{t.lower()}_rows" for t in TIER_ORDER],
    )


def expected_vs_actual(scored: DataFrame, contamination: float) -> DataFrame:
    """Expected and found anomalies; ``notable`` if they differ by more than a tenth."""
    row = scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("anomaly"), F.lit(0)).cast("bigint").alias("actual_anomalies"),
    ).withColumn("expected_anomalies", (F.col("total") * F.lit(contamination)).cast("bigint"))
    difference = F.col("actual_anomalies") - F.col("expected_anomalies")
    return row.select(
        "total",
        "expected_anomalies",
        "actual_anomalies",
        difference.alias("difference"),
        (F.try_divide(difference, F.col("expected_anomalies")) * 100).alias("difference_pct"),
        (
            (F.col("expected_anomalies") > 0)
            & (F.abs(difference) > F.col("expected_anomalies") * 0.1)
        ).alias("notable"),
    )
