"""Multi-stage audit funnel: frequent, severe, several metrics, then audit tiers.

Two variants. ``A`` has thresholds to choose and narrows *groups*; ``B`` has fixed thresholds and
narrows *rows*. Each pass over the detail rows serves all stages: one fits the metric moments,
one the score quantile, one counts per group; the group table is then attached by one join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col, feature, result_group_column
from strayrow.functions.materialize import pin
from strayrow.functions.quantiles import exact_quantiles
from strayrow.functions.skew import attach
from strayrow.operators.zscore import Moments, column_moments

# Fixed values.
MAX_METRICS = 10
METRIC_Z = 2
AUDIT_TIERS = ("TIER_1_CRITICAL", "TIER_2_HIGH", "TIER_3_MEDIUM", "TIER_4_LOW")
URGENT_TIERS = ("CRITICAL", "HIGH")


@dataclass(frozen=True)
class Settings:
    variant: str = "A"
    frequency: int = 3
    severity: float = 0.85
    metrics: int = 2

    @staticmethod
    def fixed(has_date: bool) -> Settings:
        """The settings of variant B."""
        return Settings("B", 3 if has_date else 1, 0.85, 2)


@dataclass
class Funnel:
    """``rows`` with the counts and tiers, one pinned row per group, and the cut-off score.

    ``wide`` are the same rows with every group value, also those that no stage uses.
    """

    rows: DataFrame
    wide: DataFrame
    groups: DataFrame
    group: str
    settings: Settings
    score_cut: float | None
    has_date: bool
    by_frequency: bool
    by_metrics: bool
    severe: Column
    final: Column


def _score_quantile(df: DataFrame, q: float) -> float | None:
    found = exact_quantiles(df, {"score": (F.col("anomaly_score"), [q])})["score"]
    return found[0] if found else None


def _at_least(score_cut: float | None) -> Column:
    if score_cut is None:
        return F.lit(False)
    return F.coalesce(F.col("anomaly_score") >= F.lit(score_cut), F.lit(False))


def funnel_simple(df: DataFrame, severity: float = 0.85) -> DataFrame:
    """Without a group column: flagged rows at or above a score quantile of all rows."""
    cut = _score_quantile(df, severity)
    return df.withColumn("simple_priority", (F.col("anomaly") == 1) & _at_least(cut))


def _usable_metrics(df: DataFrame, features: list[str]) -> Moments:
    present = [c for c in features[:MAX_METRICS] if c in df.columns]
    moments = column_moments(df, present) if present else {}
    return {c: ms for c, ms in moments.items() if ms[1] is not None and ms[1] > 0}


def _metric_z(name: str, moments: Moments) -> Column:
    mean, std = moments[name]
    return F.abs((feature(name) - F.lit(mean)) / F.lit(std))


def metric_zscores(df: DataFrame, features: list[str]) -> DataFrame:
    """Add ``<metric>_zscore`` for the first ten metrics; constant metrics are skipped."""
    moments = _usable_metrics(df, features)
    return df.withColumns({f"{c}_zscore": _metric_z(c, moments) for c in moments})


def _metric_hits(moments: Moments) -> Column:
    hits = [F.when(_metric_z(c, moments) > METRIC_Z, 1).otherwise(0) for c in moments]
    return sum(hits, F.lit(0))


def funnel_frequency(df: DataFrame, group: str, threshold: int = 3) -> DataFrame:
    """Groups with at least ``threshold`` rows in the CRITICAL and HIGH tiers."""
    return (
        df.where(col(group).isNotNull() & F.col("risk_tier").isin(*URGENT_TIERS))
        .groupBy(col(group))
        .agg(F.count(F.lit(1)).alias("critical_day_count"))
        .where(F.col("critical_day_count") >= threshold)
    )


def funnel_multi_metric(
    df: DataFrame, group: str, features: list[str], threshold: int = 2
) -> DataFrame:
    """Groups with at least ``threshold`` (row, metric) pairs more than 2 deviations out."""
    moments = _usable_metrics(df, features)
    return (
        df.where(col(group).isNotNull())
        .groupBy(col(group))
        .agg(F.sum(_metric_hits(moments)).alias("anomalous_metric_count"))
        .where(F.col("anomalous_metric_count") >= threshold)
    )


def audit_funnel(
    df: DataFrame,
    features: list[str],
    date: str | None = None,
    settings: Settings | None = None,
    group: str | None = None,
) -> Funnel | None:
    """Run all stages. ``None`` if no row is flagged or no group column is found."""
    settings = settings or Settings()
    if settings.variant == "B":
        settings = Settings.fixed(date is not None)
    group = group or result_group_column(df)
    if group is None or df.where(F.col("anomaly") == 1).isEmpty():
        return None

    moments = _usable_metrics(df, features)
    least_metrics = settings.metrics if settings.variant == "A" else 2
    by_metrics = len(features) >= least_metrics and bool(moments)
    cut = _score_quantile(df, settings.severity)
    severe_row = (F.col("anomaly") == 1) & _at_least(cut)

    # One row per group; rows without a group form one too, for the stage counts only.
    groups = pin(
        df.groupBy(col(group)).agg(
            F.count(F.lit(1)).alias("group_rows"),
            F.count_if(F.col("anomaly") == 1).alias("flagged_rows"),
            F.count_if(severe_row).alias("severe_rows"),
            F.count_if(F.col("risk_tier").isin(*URGENT_TIERS)).alias("critical_day_count"),
            F.sum(_metric_hits(moments)).alias("anomalous_metric_count"),
        )
    )
    named = col(group).isNotNull()
    any_urgent = not groups.where(F.col("critical_day_count") > 0).isEmpty()
    wanted = any_urgent and (settings.variant == "B" or date is not None)

    frequent = F.lit(True)
    if wanted and (settings.variant == "A" or date is not None):
        frequent = named & _is_frequent(settings)
    consensus = F.lit(True)
    if by_metrics:
        consensus = named & (F.col("anomalous_metric_count") >= settings.metrics)

    if settings.variant == "A":
        severe = (F.col("severe_rows") > 0) & frequent
        final = severe & consensus
        if not by_metrics and groups.where(severe).isEmpty():
            final = F.col("flagged_rows") > 0
    else:
        severe = severe_row & frequent
        final = severe & consensus

    values = ["flagged_rows", "severe_rows", "critical_day_count", "anomalous_metric_count"]
    rows = attach(df, groups.where(named), group, values, "group_rows").withColumns(
        {v: F.coalesce(v, F.lit(0)) for v in values}
    )
    rows = rows.withColumns({f"{c}_zscore": _metric_z(c, moments) for c in moments})
    if wanted and by_metrics:
        rows = rows.withColumn("audit_tier", _audit_tier(settings.variant, final))
    helpers = ["flagged_rows", "severe_rows"]
    if not wanted:
        helpers.append("critical_day_count")
    if not by_metrics:
        helpers.append("anomalous_metric_count")
    return Funnel(
        rows.drop(*helpers),
        rows,
        groups,
        group,
        settings,
        cut,
        date is not None,
        wanted,
        by_metrics,
        severe,
        final,
    )


def _audit_tier(variant: str, final: Column) -> Column:
    metrics, days = F.col("anomalous_metric_count"), F.col("critical_day_count")
    probability = F.coalesce("anomaly_probability", F.lit(float("-inf")))
    tier = F.when(F.col("anomaly") == 0, "NORMAL")
    if variant == "A":
        tier = tier.when(~F.coalesce(final, F.lit(False)), "FILTERED_OUT")
        third = (metrics >= 1) | (days >= 2) | (probability >= 60)
    else:
        third = (metrics >= 1) & (probability >= 50)
    return (
        tier.when((metrics >= 3) & (days >= 5) & (probability >= 90), AUDIT_TIERS[0])
        .when((metrics >= 2) & (days >= 3) & (probability >= 70), AUDIT_TIERS[1])
        .when(third, AUDIT_TIERS[2])
        .otherwise(AUDIT_TIERS[3])
    )


def funnel_severity(funnel: Funnel) -> DataFrame:
    """Groups left after the severity stage."""
    if funnel.settings.variant == "A":
        return funnel.groups.where(col(funnel.group).isNotNull() & funnel.severe).select(col(funnel.group))
    return funnel.wide.where(funnel.severe).select(col(funnel.group)).distinct()


def funnel_final(funnel: Funnel) -> DataFrame:
    """Flagged rows that pass every stage."""
    passed = (F.col("anomaly") == 1) & F.coalesce(funnel.final, F.lit(False))
    return funnel.wide.where(passed).select(*[col(c) for c in funnel.rows.columns])


def _is_frequent(settings: Settings) -> Column:
    # A group without a single urgent row is never listed as frequent.
    days = F.col("critical_day_count")
    return (days >= settings.frequency) & (days > 0)


def tier_group_counts(funnel: Funnel) -> DataFrame:
    """Distinct groups per audit tier (all four kept) and the groups to audit per tier."""
    per_group = (
        funnel.rows.where(col(funnel.group).isNotNull())
        .groupBy(col(funnel.group))
        .agg(*[F.max(F.when(F.col("audit_tier") == t, 1)).alias(t) for t in AUDIT_TIERS])
    )
    share = {AUDIT_TIERS[0]: 1.0, AUDIT_TIERS[1]: 0.5, AUDIT_TIERS[2]: 0.2, AUDIT_TIERS[3]: 0.0}
    listed = F.array(
        *[
            F.struct(
                F.lit(t).alias("audit_tier"),
                F.col(t).alias("group_count"),
                F.floor(F.col(t) * F.lit(share[t])).alias("audit_volume"),
            )
            for t in AUDIT_TIERS
        ]
    )
    return per_group.agg(*[F.count(t).alias(t) for t in AUDIT_TIERS]).select(F.inline(listed))


def funnel_stages(funnel: Funnel) -> DataFrame:
    """Groups and flagged rows left after each stage, from the group table alone.

    Rows without a group count as records as long as no stage has asked for group membership.
    """
    settings = funnel.settings
    named = col(funnel.group).isNotNull()
    frequent = named & _is_frequent(settings)
    use_frequency = funnel.by_frequency and (settings.variant == "A" or funnel.has_date)
    severe = frequent if use_frequency else F.lit(True)
    consensus = named & (F.col("anomalous_metric_count") >= settings.metrics)
    flagged, hits = F.col("flagged_rows"), F.col("severe_rows")

    stages = [("Initial", F.lit(True), flagged, flagged > 0)]
    if funnel.by_frequency:
        stages.append(("Frequency Filter", frequent, flagged, F.lit(True)))
    stages.append(("Severity Filter", severe, hits, hits > 0))
    if funnel.by_metrics:
        final = severe & consensus & (hits > 0)
        left = flagged if settings.variant == "A" else hits
        stages.append(("Multi-Metric Consensus", final, left, F.lit(True)))
    counted = funnel.groups.agg(
        *[F.count_if(named & kept & has).alias(f"g{i}") for i, (_, kept, _, has) in enumerate(stages)],
        *[
            F.coalesce(F.sum(F.when(kept, rows)), F.lit(0)).alias(f"r{i}")
            for i, (_, kept, rows, _) in enumerate(stages)
        ],
    )
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage"),
                F.lit(name).alias("name"),
                F.col(f"g{i}").alias("groups_remaining"),
                F.col(f"r{i}").alias("records_remaining"),
            )
            for i, (name, *_) in enumerate(stages)
        ]
    )
    return counted.select(F.inline(listed))
