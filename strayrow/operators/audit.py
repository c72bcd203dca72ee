"""Rank groups (or rows) for audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col, result_group_column
from strayrow.functions.materialize import pin
from strayrow.functions.skew import attach

# Weights of probability, frequency, severity and number of metrics.
CONSISTENCY_WEIGHTS = (0.40, 0.35, 0.15, 0.10)
SEVERITY_WEIGHTS = (0.35, 0.20, 0.35, 0.10)


def row_priority(df: DataFrame) -> DataFrame:
    """Priority of single rows, for tables without a group column."""
    score = F.col("anomaly_score") if "anomaly_score" in df.columns else F.lit(0.0)
    probability = (
        F.col("anomaly_probability") if "anomaly_probability" in df.columns else F.lit(50.0)
    )
    return df.withColumn("priority_score", score * probability / 100)


def _mean_probability() -> Column:
    # Probabilities have two decimals, so whole hundredths add up exactly in any order.
    hundredths = F.rint(F.col("anomaly_probability") * 100).cast("bigint")
    return F.try_divide(F.sum(hundredths) / 100, F.count("anomaly_probability"))


def group_priority(
    df: DataFrame, group: str, prioritize_consistency: bool = True
) -> DataFrame:
    """Priority of each group from probability, frequency, severity and number of metrics.

    Missing input columns fall back: flagged rows instead of tiers, probability 50, score 0.
    Rows without a group are left out.
    """
    has = set(df.columns)
    urgent = (
        F.col("risk_tier").isin("CRITICAL", "HIGH") if "risk_tier" in has else F.col("anomaly") == 1
    )
    probability = _mean_probability() if "anomaly_probability" in has else F.lit(50.0)
    severity = F.max("anomaly_score") if "anomaly_score" in has else F.lit(0.0)
    metrics = F.max("anomalous_metric_count") if "anomalous_metric_count" in has else F.lit(0)
    grouped = (
        df.where(col(group).isNotNull())
        .groupBy(col(group))
        .agg(
            F.count_if(urgent).alias("critical_days"),
            F.any_value(probability).alias("avg_probability")
            if "anomaly_probability" not in has
            else probability.alias("avg_probability"),
            severity.cast("double").alias("max_severity")
            if "anomaly_score" in has
            else F.any_value(severity).alias("max_severity"),
            metrics.alias("_metrics")
            if "anomalous_metric_count" in has
            else F.any_value(metrics).alias("_metrics"),
            F.count(F.lit(1)).alias("group_rows"),
        )
    )
    by_probability, by_frequency, by_severity, by_metrics = (
        CONSISTENCY_WEIGHTS if prioritize_consistency else SEVERITY_WEIGHTS
    )
    priority = (
        F.col("avg_probability") * by_probability
        + F.least(F.col("critical_days") * 10, F.lit(50)) * by_frequency
        + F.col("max_severity") / 10 * 30 * by_severity
        + F.least(F.col("_metrics") * 5, F.lit(20)) * by_metrics
    )
    return grouped.select(
        col(group),
        priority.alias("priority_score"),
        "critical_days",
        "avg_probability",
        "max_severity",
        "group_rows",
    )


def default_target(rows: int) -> int:
    """How many groups to audit if nothing is said: a tenth of the rows, at most 50."""
    return min(50, rows // 10)


def top_groups(priorities: DataFrame, group: str, n: int) -> DataFrame:
    """The ``n`` groups of highest priority, ties by group key; groups without one come last."""
    return priorities.orderBy(F.col("priority_score").desc_nulls_last(), col(group)).limit(n)


@dataclass
class Audit:
    """``rows`` with priority_score and recommended_for_audit, and how they came about."""

    rows: DataFrame
    mode: str
    group: str | None = None
    priorities: DataFrame | None = None
    top: DataFrame | None = None
    target: int = 0


def prioritize(
    df: DataFrame,
    target: int = 50,
    prioritize_consistency: bool = True,
    group: str | None = None,
) -> Audit:
    """Rank the groups of a scored table and mark the rows of the first ``target`` groups.

    Without any flagged row the table comes back unchanged; without a group column each row
    gets a priority of its own.
    """
    if "anomaly" not in df.columns or df.where(F.col("anomaly") == 1).isEmpty():
        return Audit(df, "no_anomalies")
    group = group or result_group_column(df)
    if group is None:
        return Audit(row_priority(df), "simple")

    priorities = pin(group_priority(df, group, prioritize_consistency))
    top = pin(top_groups(priorities, group, target))
    # The row set of ``top`` is bounded by ``target``; it marks the ranked groups once, so that
    # the detail rows need one join only.
    ranked = priorities.join(
        F.broadcast(top.select(col(group), F.lit(True).alias("_top"))), group, "left"
    )
    marked = attach(df, ranked, group, ["priority_score", "_top"], "group_rows")
    # The missing group ranks last: it is in only if every other group is in as well.
    room = priorities.count() < target
    rows = marked.select(
        *[col(c) for c in df.columns],
        F.coalesce("priority_score", F.lit(0.0)).alias("priority_score"),
        F.when(col(group).isNull(), F.lit(room))
        .otherwise(F.coalesce("_top", F.lit(False)))
        .alias("recommended_for_audit"),
    )
    return Audit(rows, "intelligent", group, priorities, top, target)


def mark_recommended(
    df: DataFrame, target: int = 50, prioritize_consistency: bool = True, group: str | None = None
) -> DataFrame:
    return prioritize(df, target, prioritize_consistency, group).rows


def audit_stats(df: DataFrame, audit: Audit, prioritize_consistency: bool = True) -> DataFrame:
    """One row: mode, groups with anomalies, target and number of recommended groups."""
    if audit.mode != "intelligent":
        return df.agg(
            F.lit(audit.mode).alias("mode"),
            F.count_if(F.col("anomaly") == 1).alias("anomalies"),
        )
    flagged = F.when(F.col("anomaly") == 1, col(audit.group))
    recommended = audit.top.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.agg(F.count_distinct(flagged).alias("initial_anomaly_groups")).select(
        F.lit(audit.mode).alias("mode"),
        F.lit(audit.group).alias("group_column"),
        "initial_anomaly_groups",
        F.lit(audit.target).alias("target_count"),
        recommended.alias("recommended_count"),
        F.lit(prioritize_consistency).alias("prioritize_consistency"),
    )


def audit_volume_plan(df: DataFrame) -> DataFrame:
    """Rows to audit per tier: all CRITICAL, half of HIGH, a fifth of MEDIUM, and the total."""
    counted = df.agg(
        *[F.count_if(F.col("risk_tier") == t).alias(t.lower()) for t in ("CRITICAL", "HIGH", "MEDIUM")]
    )
    plan = counted.select(
        "*",
        F.col("critical").alias("critical_audit"),
        F.floor(F.col("high") * 0.5).alias("high_audit"),
        F.floor(F.col("medium") * 0.2).alias("medium_audit"),
    )
    return plan.withColumn(
        "total_audit", F.col("critical_audit") + F.col("high_audit") + F.col("medium_audit")
    )
