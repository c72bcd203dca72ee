"""Insight tables on a scored DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrow.functions.columns import col, feature
from strayrow.functions.quantiles import exact_quantiles
from strayrow.functions.sampling import sample_rows


def _rate(part: Column | str, whole: Column | str) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    return F.coalesce(F.try_divide(part * 100, whole), F.lit(0.0))


def summary(df: DataFrame, method: str, threshold_display: str | None = None) -> DataFrame:
    """One row: rows, anomalies, rate in percent, method."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.sum("anomaly"), F.lit(0)).cast("bigint").alias("anomalies"),
    ).select(
        "total_records",
        "anomalies",
        _rate("anomalies", "total_records").alias("anomaly_rate"),
        F.lit(method).alias("method"),
        F.lit(threshold_display).alias("threshold_display"),
    )


def _category_counts(df: DataFrame, categories: list[str]) -> DataFrame:
    """Anomalies and rows per value of each category column; missing values are dropped."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("category_order"),
                F.lit(c).alias("category"),
                col(c).cast("string").alias("value"),
            )
            for i, c in enumerate(categories)
        ]
    )
    return (
        df.select("anomaly", F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("category_order", "category", "value")
        .agg(
            F.sum("anomaly").cast("bigint").alias("anomaly_count"),
            F.count("anomaly").alias("total_count"),
        )
        .withColumn("anomaly_rate", _rate("anomaly_count", "total_count"))
    )


def category_rates(df: DataFrame, categories: list[str], top: int = 10) -> DataFrame:
    """The ``top`` values per category column by anomaly rate; position 1 is the highest."""
    by_rate = Window.partitionBy("category_order").orderBy(F.desc("anomaly_rate"), "value")
    return (
        _category_counts(df, categories)
        .withColumn("position", F.row_number().over(by_rate))
        .where(F.col("position") <= top)
    )


def feature_contrast(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: mean and deviation of flagged rows, mean of the others, difference."""
    flagged = F.col("anomaly") == 1
    stats = df.agg(
        *[
            expr
            for i, c in enumerate(features)
            for expr in (
                F.avg(F.when(flagged, feature(c))).alias(f"a{i}"),
                F.avg(F.when(F.col("anomaly") == 0, feature(c))).alias(f"n{i}"),
                F.stddev_samp(F.when(flagged, feature(c))).alias(f"s{i}"),
            )
        ]
    )
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("feature_order"),
                F.lit(c).alias("feature"),
                F.col(f"a{i}").alias("anomaly_mean"),
                F.col(f"n{i}").alias("normal_mean"),
                F.col(f"s{i}").alias("anomaly_std"),
                F.abs(F.col(f"a{i}") - F.col(f"n{i}")).alias("difference"),
            )
            for i, c in enumerate(features)
        ]
    )
    return stats.select(F.inline(listed))


def top_anomalies(df: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """The rows with the largest scores, ties by key."""
    return (
        df.where(F.col("anomaly_score").isNotNull())
        .orderBy(F.desc("anomaly_score"), *[col(k) for k in key])
        .limit(n)
    )


def verdict(df: DataFrame, expected_rate: float | None = None) -> DataFrame:
    """How the number of anomalies compares with what was expected, or how high the rate is."""
    row = summary(df, "").select("total_records", "anomalies", "anomaly_rate")
    by_rate = (
        F.when(F.col("anomaly_rate") < 1, "excellent")
        .when(F.col("anomaly_rate") < 5, "good")
        .when(F.col("anomaly_rate") < 10, "moderate")
        .otherwise("high")
    )
    if not expected_rate:
        return row.withColumn("verdict", by_rate)
    expected = (F.col("total_records") * F.lit(expected_rate)).cast("bigint")
    row = row.withColumn("expected_anomalies", expected).withColumn(
        "difference", F.col("anomalies") - F.col("expected_anomalies")
    )
    row = row.withColumn("difference_pct", _rate("difference", "expected_anomalies"))
    by_difference = (
        F.when(F.abs("difference_pct") < 10, "on target")
        .when(F.col("difference") > 0, "high alert")
        .otherwise("cleaner than expected")
    )
    return row.withColumn("verdict", F.when(F.col("anomalies") > 0, by_difference).otherwise(by_rate))


def feature_ranking(df: DataFrame, features: list[str], n: int = 5) -> DataFrame:
    """Features by difference between flagged and other rows, largest first."""
    ranked = feature_contrast(df, features).orderBy(
        F.col("difference").desc_nulls_last(), "feature_order"
    )
    return ranked.limit(n)


def primary_feature(df: DataFrame, features: list[str]) -> DataFrame:
    """The feature that differs most, and how its flagged rows compare with the others."""
    ratio = F.when(F.col("normal_mean") == 0, F.lit(0.0)).otherwise(
        F.try_divide("anomaly_mean", "normal_mean")
    )
    level = (
        F.when(F.col("ratio") > 2, "higher")
        .when((F.col("ratio") > 0) & (F.col("ratio") < 0.5), "lower")
        .when(F.col("ratio") == 0, "zero")
        .otherwise("notable")
    )
    return (
        feature_ranking(df, features, 1)
        .where(F.col("anomaly_mean").isNotNull())
        .withColumn("ratio", ratio)
        .withColumn("finding", level)
    )


def hotspot(df: DataFrame, categories: list[str]) -> DataFrame:
    """The first category column whose highest rate is more than 1.5 times the overall one."""
    overall = summary(df, "").select("anomaly_rate").scalar()
    ratio = F.try_divide("anomaly_rate", "overall_rate")
    return (
        category_rates(df, categories, top=1)
        .withColumn("overall_rate", overall)
        .where(F.col("anomaly_rate") > F.col("overall_rate") * 1.5)
        .orderBy("category_order")
        .limit(1)
        .withColumn("ratio", ratio)
        .withColumn(
            "level",
            F.when(F.col("ratio") > 5, "critical")
            .when(F.col("ratio") > 3, "high")
            .otherwise("above average"),
        )
        .drop("position", "category_order")
    )


def extreme_count(df: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Rows whose score is above the score quantile."""
    found = exact_quantiles(df, {"score": (F.col("anomaly_score"), [quantile])})["score"]
    cut = F.lit(found[0] if found else None).cast("double")
    return df.agg(F.count_if(F.col("anomaly_score") > cut).alias("extreme_rows")).withColumn(
        "score_cut", cut
    )


def alert_threshold(df: DataFrame, factor: float = 1.5) -> DataFrame:
    return summary(df, "").select(
        "anomaly_rate", (F.col("anomaly_rate") * factor).alias("alert_rate")
    )


def review_sample(
    df: DataFrame, n: int = 20, key: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """Random flagged rows to look at by hand."""
    return sample_rows(df.where(F.col("anomaly") == 1), n, key, seed)
