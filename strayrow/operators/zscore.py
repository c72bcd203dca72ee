"""Z-score detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import feature, finite
from strayrow.functions.ranking import score_distribution
from strayrow.operators.scoring import finish

Moments = dict[str, tuple[float | None, float | None]]


def column_moments(df: DataFrame, features: list[str], sample: bool = True) -> Moments:
    """Mean and standard deviation of all features from one pass over these columns only."""
    spread = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(
        *[F.avg(feature(c)).alias(f"m{i}") for i, c in enumerate(features)],
        *[spread(feature(c)).alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(features)}


def z_name(name: str) -> str:
    return f"zscore_{name.replace(' ', '_')}"


def z_expression(name: str, moments: Moments) -> Column:
    mean, std = moments[name]
    if mean is None or not std:
        return F.lit(None).cast("double")
    return finite(F.abs((feature(name) - F.lit(mean)) / F.lit(std)))


def _largest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def zscore_columns(
    df: DataFrame, features: list[str], moments: Moments | None = None
) -> DataFrame:
    """Add ``zscore_<feature>``; a constant feature gives null."""
    moments = moments or column_moments(df, features)
    return df.withColumns({z_name(c): z_expression(c, moments) for c in features})


def zscore_max(df: DataFrame, features: list[str], moments: Moments | None = None) -> DataFrame:
    """The same plus ``max_zscore``, null only if all z-scores are null."""
    scored = zscore_columns(df, features, moments)
    return scored.withColumn(
        "max_zscore", _largest([F.col(f"`{z_name(c)}`") for c in features])
    )


def largest_zscore(features: list[str], moments: Moments) -> Column:
    """The largest z-score of a row, as one expression."""
    return _largest([z_expression(c, moments) for c in features])


def zscore_detect(df: DataFrame, features: list[str], threshold: float = 3.0) -> DataFrame:
    """Flag rows whose largest z-score is above ``threshold``.

    Two narrow passes fit the moments and the score steps; what is returned is one lazy
    projection over ``df`` without a shuffle.
    """
    moments = column_moments(df, features)
    distribution = score_distribution(df, largest_zscore(features, moments))
    scored = zscore_max(df, features, moments)
    score = F.col("max_zscore")
    return finish(scored, score > F.lit(float(threshold)), score, distribution)
