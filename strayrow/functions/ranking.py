"""Average-tie percentile rank of a score over a whole table.

A window without partitions would send every row through one task. Here only distinct scores
with their row counts are shuffled, so heavy ties shrink to one row before the exchange; score
ranges give the window its partitions. The rounded percentage takes at most 10,001 values and
never falls as the score rises, so the result is a short step function: looking it up in the
detail rows needs no shuffle of the detail rows at all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrow.functions.columns import finite
from strayrow.functions.materialize import pin
from strayrow.functions.quantiles import interpolate, positions

ROWS_PER_BUCKET = 500_000
MAX_BUCKETS = 4_096
FAST_LOOKUP_ROWS = 2_000_000


@dataclass
class ScoreDistribution:
    """Distinct scores in order: ``score``, ``rows`` with it, rows ``before`` it."""

    table: DataFrame
    n: int
    low: float | None
    high: float | None
    _steps: list = field(default=None, repr=False)

    def quantiles(self, probabilities: list[float]) -> list[float | None]:
        """Linear-interpolation quantiles, read off the running counts."""
        if self.n == 0:
            return [None] * len(probabilities)
        spots = [positions(p, self.n) for p in probabilities]
        indexes = sorted({i for lower, upper, _ in spots for i in (lower, upper)})
        hits = self.table.where(
            F.exists(
                F.array(*[F.lit(i) for i in indexes]),
                lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("rows")),
            )
        ).collect()
        at = {
            i: r["score"] for i in indexes for r in hits if r["before"] <= i < r["before"] + r["rows"]
        }
        return [interpolate(at[lower], at[upper], weight) for lower, upper, weight in spots]

    def steps(self) -> list[tuple[float, float]]:
        """(smallest score, probability) for each probability that occurs: at most 10,001."""
        if self._steps is None:
            rank = F.col("before") + (F.col("rows") + 1) / 2
            percent = F.rint(rank / F.lit(float(max(self.n, 1))) * 100 * 100) / 100
            found = (
                self.table.select("score", percent.alias("probability"))
                .groupBy("probability")
                .agg(F.min("score").alias("score"))
                .collect()
            )
            self._steps = sorted((r["score"], r["probability"]) for r in found)
        return self._steps


def score_distribution(
    df: DataFrame, score: Column, rows_per_bucket: int = ROWS_PER_BUCKET
) -> ScoreDistribution:
    """Count distinct scores of ``df`` and put running counts on them; nulls are left out."""
    counts = pin(
        df.select(finite(score.cast("double")).alias("score"))
        .where(F.col("score").isNotNull())
        .groupBy("score")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return distribution_of_counts(counts, rows_per_bucket)


def distribution_of_counts(
    counts: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET
) -> ScoreDistribution:
    """The same from a table of distinct ``score`` and ``rows`` that is already pinned."""
    size = counts.agg(
        F.count(F.lit(1)).alias("distinct"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
    ).first()
    buckets = min(MAX_BUCKETS, math.ceil(size["distinct"] / rows_per_bucket))
    if buckets <= 1:
        table = counts.withColumn("before", running_count(Window.partitionBy(F.lit(0))))
    else:
        table = pin(_ranked_in_buckets(counts, buckets))
    return ScoreDistribution(table, size["n"], size["low"], size["high"])


def running_count(window) -> Column:
    earlier = window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("rows").over(earlier), F.lit(0))


def _ranked_in_buckets(counts: DataFrame, buckets: int) -> DataFrame:
    edges = counts.approxQuantile(
        "score", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)
    )
    splits = [float("-inf"), *sorted(set(edges)), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="score", outputCol="bucket").transform(counts)
    totals = bucketed.groupBy("bucket").agg(F.sum("rows").alias("total"))
    # One row per bucket, at most MAX_BUCKETS: small enough for one task and for a broadcast.
    offsets = totals.select(
        "bucket",
        F.coalesce(
            F.sum("total").over(
                Window.partitionBy(F.lit(0))
                .orderBy("bucket")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("offset"),
    )
    return (
        bucketed.withColumn("within", running_count(Window.partitionBy("bucket")))
        .join(F.broadcast(offsets), "bucket")
        .select("score", "rows", (F.col("offset") + F.col("within")).alias("before"))
    )


def lookup_steps(
    df: DataFrame,
    score: str,
    steps: list[tuple[float, float]],
    out: str,
    rows: int,
) -> DataFrame:
    """Add ``out``: the value of the last step whose score is not above the row's score.

    Either way of finding the step is one expression, so filters on ``out`` can be pushed down
    without growing. Above FAST_LOOKUP_ROWS ``rows`` the search is ten times faster per row, but
    takes seconds to set up.
    """
    if not steps:
        return df.withColumn(out, F.lit(None).cast("double"))
    table = df.sparkSession.createDataFrame(
        pa.table(
            {
                "starts": pa.array([[float(s) for s, _ in steps]], pa.list_(pa.float64())),
                "levels": pa.array([[float(p) for _, p in steps]], pa.list_(pa.float64())),
            }
        )
    )
    arrays = {c: table.select(c[1:]).scalar() for c in ("_starts", "_levels")}
    if rows > FAST_LOOKUP_ROWS and len(steps) > 1:
        splits = [float("-inf"), *[float(s) for s, _ in steps[1:]], float("inf")]
        df = Bucketizer(
            splits=splits, inputCol=score, outputCol="_step", handleInvalid="keep"
        ).transform(df.withColumn("_levels", arrays["_levels"]))
        step = F.col("_step").cast("int")
    else:
        df = df.withColumns(arrays)
        step = F.greatest(steps_reached(F.col(score), len(steps)) - 1, F.lit(0))
    level = F.get("_levels", step)
    return df.withColumn(out, F.when(F.col(score).isNotNull(), level)).drop(*arrays, "_step")


def steps_reached(value: Column, count: int) -> Column:
    """Number of ``_starts`` at or below the value, found bit by bit."""
    spans = [1 << i for i in reversed(range(count.bit_length()))]
    return F.reduce(
        F.array(*[F.lit(s) for s in spans]),
        F.lit(0),
        lambda at, span: at + F.when(F.get("_starts", at + span - 1) <= value, span).otherwise(0),
    )


def percent_rank_avg(
    df: DataFrame, score: str, out: str = "anomaly_probability", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Average-tie rank / non-null rows * 100, rounded half-even to two decimals."""
    distribution = score_distribution(df, F.col(score), rows_per_bucket)
    return lookup_steps(df, score, distribution.steps(), out, distribution.n)
