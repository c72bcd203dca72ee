"""Preparation of features and of raw scores for the model-based detectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col, feature
from strayrow.functions.materialize import pin
from strayrow.functions.quantiles import SMALL_ROWS, exact_quantiles
from strayrow.functions.ranking import ScoreDistribution, distribution_of_counts
from strayrow.operators.scoring import finish
from strayrow.operators.zscore import Moments, column_moments

# Fixed values of the adaptive threshold and of the score scale.
THRESHOLD_FACTOR = 1.2
THRESHOLD_FLOOR = 6.0
SCORE_SCALE = 10.0

SPREAD_ROWS = 2_000_000


def fit_medians(
    df: DataFrame, features: list[str], small_rows: int = SMALL_ROWS
) -> dict[str, float]:
    found = exact_quantiles(df, {c: (feature(c), [0.5]) for c in features}, small_rows)
    empty = [c for c in features if found[c] is None]
    if empty:
        raise ValueError(f"features without values: {', '.join(empty)}")
    return {c: found[c][0] for c in features}


def median_impute(
    df: DataFrame, features: list[str], medians: dict[str, float] | None = None
) -> DataFrame:
    """Replace missing feature values by the column median; features become doubles."""
    medians = medians or fit_medians(df, features)
    return df.withColumns({c: F.coalesce(feature(c), F.lit(medians[c])) for c in features})


def scaled(name: str, moments: Moments) -> Column:
    mean, std = moments[name]
    if not std:
        return F.when(col(name).isNotNull(), F.lit(0.0))
    return (col(name) - F.lit(mean)) / F.lit(std)


def scaled_name(name: str) -> str:
    return f"scaled_{name}"


def standard_scale(
    df: DataFrame, features: list[str], moments: Moments | None = None
) -> DataFrame:
    """Add ``scaled_<feature>``: centred, divided by the population deviation."""
    moments = moments or column_moments(df, features, sample=False)
    return df.withColumns({scaled_name(c): scaled(c, moments) for c in features})


@dataclass
class Prepared:
    """Imputed rows and the expressions of their scaled features."""

    rows: DataFrame
    scaled: list[Column]
    n: int
    moments: Moments | None = None

    @property
    def names(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.scaled))]

    def vectors(self, *others: Column | str) -> DataFrame:
        """Only the scaled features, as ``x0``, ``x1`` …, and the other columns asked for."""
        named = [c.alias(n) for c, n in zip(self.scaled, self.names)]
        return self.rows.select(*named, *others)


def matrix(batch: pd.Series | tuple[pd.Series, ...]) -> np.ndarray:
    """Rows by features; Spark hands over a bare series where there is one feature."""
    return np.column_stack(batch if isinstance(batch, tuple) else (batch,)).astype(float)


def prepare(
    df: DataFrame, features: list[str], medians: dict[str, float] | None = None
) -> Prepared:
    rows = median_impute(df, features, medians)
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    moments = {c: (stats[f"m{i}"], stats[f"s{i}"]) for i, c in enumerate(features)}
    if stats["n"] <= SPREAD_ROWS:
        # Models need much time per row: a small table must not sit in one or two partitions.
        rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return Prepared(rows, [scaled(c, moments) for c in features], stats["n"], moments)


def normalized(score: Column, low: float | None, high: float | None) -> Column:
    """Scale a raw score to 0 … 10; all 0 if there is only one value."""
    if low is None or not high > low:
        return F.when(score.isNotNull(), F.lit(0.0))
    return F.lit(SCORE_SCALE) * (score - F.lit(low)) / F.lit(high - low)


def score_normalize(df: DataFrame, score: str, out: str = "anomaly_score") -> DataFrame:
    edge = df.agg(F.min(score).alias("low"), F.max(score).alias("high")).first()
    return df.withColumn(out, normalized(F.col(score), edge["low"], edge["high"]))


def threshold_for(percentile: float) -> float:
    return max(percentile * THRESHOLD_FACTOR, THRESHOLD_FLOOR)


def adaptive_threshold(df: DataFrame, score: str, contamination: float) -> DataFrame:
    """Flag scores above 1.2 times the (1 - contamination) quantile, but never below 6."""
    found = exact_quantiles(df, {"s": (F.col(score), [1 - contamination])})["s"]
    limit = threshold_for(found[0]) if found else THRESHOLD_FLOOR
    return df.withColumn("threshold_value", F.lit(limit)).withColumn(
        "anomaly", F.when(F.col(score) > F.lit(limit), 1).otherwise(0)
    )


@dataclass
class Fitted:
    """What turns a raw score into flag, probability and tier."""

    low: float | None
    high: float | None
    threshold: float
    distribution: ScoreDistribution


def score_counts(scored: DataFrame, score: str) -> DataFrame:
    return scored.select(F.col(score).alias("score"), F.lit(1).cast("bigint").alias("rows"))


def fit_scores(weighted: DataFrame, contamination: float) -> Fitted:
    """Range, threshold and ranks of a raw ``score`` that stands for a number of ``rows``.

    The score is evaluated once; everything else comes from the counts of its values.
    """
    counts = pin(
        weighted.where(F.col("score").isNotNull())
        .groupBy("score")
        .agg(F.sum("rows").alias("rows"))
    )
    edge = counts.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    rescaled = pin(
        counts.select(normalized(F.col("score"), edge["low"], edge["high"]).alias("score"), "rows")
        .groupBy("score")
        .agg(F.sum("rows").alias("rows"))
    )
    distribution = distribution_of_counts(rescaled)
    quantile = distribution.quantiles([1 - contamination])[0]
    limit = THRESHOLD_FLOOR if quantile is None else threshold_for(quantile)
    return Fitted(edge["low"], edge["high"], limit, distribution)


def finish_model(scored: DataFrame, score: str, fitted: Fitted) -> DataFrame:
    """Normalise the raw score, flag it, and add probability and tier."""
    result = scored.withColumn(
        "anomaly_score", normalized(F.col(score), fitted.low, fitted.high)
    ).drop(score)
    value = F.col("anomaly_score")
    return finish(result, value > F.lit(fitted.threshold), value, fitted.distribution)
