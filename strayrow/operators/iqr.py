"""Interquartile-range detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import feature
from strayrow.functions.quantiles import SMALL_ROWS, exact_quantiles
from strayrow.functions.ranking import score_distribution
from strayrow.operators.scoring import finish

FENCE_WIDTH = 1.5  # fixed value

Fences = dict[str, tuple[float, float]]


def fit_fences(df: DataFrame, features: list[str], small_rows: int = SMALL_ROWS) -> Fences:
    fences = {}
    quartiles = exact_quantiles(df, {c: (feature(c), [0.25, 0.75]) for c in features}, small_rows)
    for c in features:
        if quartiles[c] is None:
            raise ValueError(f"feature without values: {c}")
        q1, q3 = quartiles[c]
        reach = FENCE_WIDTH * (q3 - q1)
        fences[c] = (q1 - reach, q3 + reach)
    return fences


def iqr_fences(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature: exact quartiles and the fences around them."""
    quartiles = exact_quantiles(df, {c: (feature(c), [0.25, 0.75]) for c in features})
    rows = []
    for c in features:
        if quartiles[c] is None:
            raise ValueError(f"feature without values: {c}")
        q1, q3 = quartiles[c]
        reach = FENCE_WIDTH * (q3 - q1)
        rows.append((c, q1, q3, q1 - reach, q3 + reach))
    return df.sparkSession.createDataFrame(
        rows, "feature string, q1 double, q3 double, lower double, upper double"
    )


def outside(fences: Fences) -> Column:
    """Whether any feature lies outside its fences; missing values do not count."""
    hit = F.lit(False)
    for c, (lower, upper) in fences.items():
        x = feature(c)
        hit = hit | F.coalesce((x < F.lit(lower)) | (x > F.lit(upper)), F.lit(False))
    return hit


def distance(fences: Fences) -> Column:
    """Largest distance outside the fences in raw units; null if any feature is missing."""
    per_feature = [
        F.greatest(F.lit(lower) - feature(c), feature(c) - F.lit(upper), F.lit(0.0))
        for c, (lower, upper) in fences.items()
    ]
    complete = F.lit(True)
    for c in fences:
        complete = complete & feature(c).isNotNull()
    largest = F.greatest(*per_feature) if len(per_feature) > 1 else per_feature[0]
    return F.when(complete, largest)


def iqr_score(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumn("anomaly_score", distance(fit_fences(df, features)))


def iqr_detect(df: DataFrame, features: list[str]) -> DataFrame:
    """Flag rows outside any fence and score them by how far outside they are."""
    fences = fit_fences(df, features)
    score = distance(fences)
    distribution = score_distribution(df, score)
    return finish(df, outside(fences), score, distribution)
