"""Synthetic sample table with planted outliers."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.functions.sampling import unit_hash

# Shape of the sample.
ROWS = 10_000
PLANTED_SHARE = 0.05
CATEGORIES = ("A", "B", "C", "D", "E")
DEPARTMENTS = ("Sales", "Marketing", "Engineering", "Support")


def sample_dataset(spark: SparkSession, rows: int = ROWS, seed: int = 42) -> DataFrame:
    """Three normal features, two categories, hourly dates; exactly 5 % of rows are planted.

    ``planted`` marks them, for tests only. All values derive from the row number.
    """
    return add_sample_columns(spark.range(rows), "id", rows, seed)


def _uniform(key: str, seed: int, low: float, high: float):
    return F.lit(low) + unit_hash([key], seed) * F.lit(high - low)


def _normal(key: str, seed: int, mean: float, deviation: float):
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - unit_hash([key], seed)))
    angle = F.lit(6.283185307179586) * unit_hash([key], seed + 1)
    return F.lit(mean) + F.lit(deviation) * radius * F.cos(angle)


def _choice(key: str, seed: int, values: tuple[str, ...]):
    at = F.floor(unit_hash([key], seed) * len(values)).cast("int")
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def add_sample_columns(ids: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """Sample columns for numbered rows ``0 … rows-1`` of any table."""
    planted_rows = int(rows * PLANTED_SHARE)
    if planted_rows:
        # A permutation of the row numbers decides who is planted: exactly this many, no sort.
        step = _coprime_step(rows, seed)
        place = (F.col(key) * F.lit(step) + F.lit(seed)) % F.lit(rows)
        planted = place < planted_rows
    else:
        planted = F.lit(False)
    first = _normal(key, seed * 10 + 1, 100, 15)
    second = _normal(key, seed * 10 + 3, 200, 30)
    return ids.select(
        F.col(key).alias("id"),
        _choice(key, seed * 10 + 5, CATEGORIES).alias("Category"),
        _choice(key, seed * 10 + 6, DEPARTMENTS).alias("Department"),
        F.when(planted, first * _uniform(key, seed * 10 + 7, 2.0, 4.0)).otherwise(first).alias(
            "Feature_1"
        ),
        F.when(planted, second * _uniform(key, seed * 10 + 8, 0.2, 0.5)).otherwise(second).alias(
            "Feature_2"
        ),
        _normal(key, seed * 10 + 9, 50, 10).alias("Feature_3"),
        F.timestamp_add("HOUR", F.col(key), F.lit("2024-01-01").cast("timestamp")).alias("Date"),
        planted.alias("planted"),
    )


def _coprime_step(rows: int, seed: int) -> int:
    """A multiplier without a common factor with ``rows``, about 0.618 of it."""
    from math import gcd

    step = max(1, int(rows * 0.6180339887) + seed % 7)
    while gcd(step, rows) != 1:
        step += 1
    return step
