"""The data behind each chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col, feature, role_of
from strayrow.functions.quantiles import exact_quantiles
from strayrow.functions.sampling import sample_rows
from strayrow.operators.insights import _rate, category_rates

CLASSES = (("normal", 0), ("anomaly", 1))
TIER_LINES = (50.0, 70.0, 90.0)  # fixed values


def class_counts(df: DataFrame) -> DataFrame:
    """Rows per class; a class without rows is kept."""
    counted = df.agg(*[F.count_if(F.col("anomaly") == v).alias(n) for n, v in CLASSES])
    listed = F.array(
        *[F.struct(F.lit(n).alias("class"), F.col(n).alias("rows")) for n, _ in CLASSES]
    )
    return counted.select(F.inline(listed))


def _histogram(df: DataFrame, value: str, by: list[str], bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum; the maximum falls into the last bin."""
    edge = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    low, high = edge["low"], edge["high"]
    width = (high - low) / bins if low is not None and high > low else 0.0
    position = (F.col(value) - F.lit(low)) / F.lit(width) if width else F.lit(0.0)
    start = F.lit(low) + F.col("bin") * F.lit(width)
    return (
        df.where(F.col(value).isNotNull())
        .select(*by, F.least(F.floor(position), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin", *by)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("bin_start", start.cast("double"))
        .withColumn("bin_end", (start + F.lit(width)).cast("double"))
    )


def score_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    return _histogram(df, "anomaly_score", ["anomaly"], bins)


def probability_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Bins of the probability; ``tier_line`` is the tier boundary that lies in the bin."""
    line = F.lit(None).cast("double")
    for edge in TIER_LINES:
        inside = (F.col("bin_start") <= edge) & (F.lit(edge) < F.col("bin_end"))
        line = F.when(inside, F.lit(edge)).otherwise(line)
    return _histogram(df, "anomaly_probability", [], bins).withColumn("tier_line", line)


def _day(df: DataFrame, date: str) -> Column:
    if role_of(df.schema[date].dataType) == "categorical":
        return F.to_date(F.try_to_timestamp(col(date)))
    return F.to_date(col(date))


def daily_series(df: DataFrame, date: str) -> DataFrame:
    """Anomalies, rows and rate per calendar day; days without rows are filled with zero."""
    days = (
        df.select(_day(df, date).alias("day"), "anomaly")
        .where(F.col("day").isNotNull())
        .groupBy("day")
        .agg(
            F.sum("anomaly").cast("bigint").alias("anomalies"),
            F.count("anomaly").alias("total"),
        )
    )
    return fill_days(days)


def fill_days(days: DataFrame) -> DataFrame:
    """``day``, ``anomalies``, ``total`` with zeros for the days between that have no row."""
    # One row per day from here on.
    spine = days.agg(F.min("day").alias("first"), F.max("day").alias("last")).select(
        F.explode(F.sequence("first", "last")).alias("day")
    )
    return (
        spine.join(days, "day", "left")
        .select(
            "day",
            F.coalesce("anomalies", F.lit(0)).alias("anomalies"),
            F.coalesce("total", F.lit(0)).alias("total"),
        )
        .withColumn("anomaly_rate", _rate("anomalies", "total"))
        .orderBy("day")
    )


def scatter_sample(
    df: DataFrame,
    features: list[str],
    n: int = 10_000,
    key: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Random rows of the first two features, up to three more for display, and the class."""
    shown = list(dict.fromkeys([*(key or []), *features[:5], "anomaly"]))
    return sample_rows(df.select(*[col(c) for c in shown]), n, key, seed)


def category_bars(df: DataFrame, categories: list[str], top: int = 15) -> DataFrame:
    """Highest rates of the first three category columns."""
    return category_rates(df, categories[:3], top)


def box_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """Quartiles, whiskers and number of outliers of the first three features per class."""
    parts = [(c, n, v) for c in features[:3] for n, v in CLASSES]
    members = [F.when(F.col("anomaly") == v, feature(c)) for c, _, v in parts]
    quartiles = exact_quantiles(
        df, {str(i): (m, [0.25, 0.5, 0.75]) for i, m in enumerate(members)}
    )
    stats, fitted = [], []
    for i, m in enumerate(members):
        q1, median, q3 = quartiles[str(i)] or (None, None, None)
        reach = 1.5 * (q3 - q1) if q1 is not None else None
        low = F.lit(q1 - reach if reach is not None else None).cast("double")
        high = F.lit(q3 + reach if reach is not None else None).cast("double")
        fitted.append((q1, median, q3))
        stats += [
            F.count(m).alias(f"n{i}"),
            F.min(m).alias(f"min{i}"),
            F.max(m).alias(f"max{i}"),
            F.min(F.when(m >= low, m)).alias(f"wl{i}"),
            F.max(F.when(m <= high, m)).alias(f"wh{i}"),
            F.count_if((m < low) | (m > high)).alias(f"o{i}"),
        ]
    listed = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(n).alias("class"),
                F.col(f"n{i}").alias("rows"),
                F.col(f"min{i}").alias("minimum"),
                *[
                    F.lit(v).cast("double").alias(name)
                    for name, v in zip(("q1", "median", "q3"), fitted[i])
                ],
                F.col(f"max{i}").alias("maximum"),
                F.col(f"wl{i}").alias("whisker_low"),
                F.col(f"wh{i}").alias("whisker_high"),
                F.col(f"o{i}").alias("outliers"),
            )
            for i, (c, n, _) in enumerate(parts)
        ]
    )
    return df.agg(*stats).select(F.inline(listed))
