import datetime
import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayrow.functions.sampling import HALVES, PRIME, SHIFTS, portable_hash, row_hash, sample_rows


def plain(numbers, seed):
    out = []
    for fold, *rounds in HALVES:
        at = seed % PRIME
        for value in numbers:
            value = -1 if value is None else value
            for limb in (value % PRIME, (value >> 31) % PRIME):
                at = (at * fold + limb) % PRIME
        for ((a, p), (b, q)), (i, j) in zip(rounds, SHIFTS):
            at = ((at * a + i) % p) * ((at * b + j) % q) % PRIME
        out.append(at)
    return out[0] * PRIME + out[1]


def test_hash_is_the_same_arithmetic_anywhere(spark):
    rows = [(0, 1), (-1, 2), (2**63 - 1, -(2**63)), (PRIME, None), (None, None), (10**12, 7)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", portable_hash([F.col("a"), F.col("b")], 9).alias("h")).collect()
    assert [r["h"] for r in got] == [plain((r["a"], r["b"]), 9) for r in got]


@pytest.mark.parametrize("step", [1, 2, 1000, 1 << 31])
def test_hash_of_regular_keys_is_even_and_without_pattern(spark, step):
    df = spark.range(40_000).select((F.col("id") * step).alias("id"))
    found = df.select("id", row_hash(df, ["id"], 42).alias("u")).toPandas().sort_values("id")
    u = found["u"].to_numpy()
    assert len(set(u)) == len(u)
    for values in (u, u[::7], (u * 64) % 1):
        counts = np.histogram(values, bins=50, range=(0, 1))[0]
        expected = len(values) / 50
        assert ((counts - expected) ** 2 / expected).sum() < 110  # chi-square, 49 degrees of freedom
    for lag in (1, 2, 3, 10, 64, 1000):
        assert abs(np.corrcoef(u[:-lag], u[lag:])[0, 1]) < 0.03


def test_keys_of_all_types(spark):
    df = spark.range(500).select(
        "id", F.date_add(F.lit(datetime.date(2020, 1, 1)), F.col("id").cast("int")).alias("day"),
        F.concat(F.lit("é"), "id").alias("name"), (F.col("id") / 7).alias("part"), (F.col("id") % 2 == 0).alias("even"),
    )
    for key in (["id"], ["day"], ["name"], ["part"], ["even", "id"], ["day", "name"]):
        drawn = sample_rows(df, 60, key)
        assert drawn.count() == 60
        assert {r["id"] for r in drawn.collect()} == {r["id"] for r in sample_rows(df.repartition(7), 60, key).collect()}


def test_the_hash_is_computed_in_a_projection_not_in_filters(spark):
    df = spark.range(5_000).select("id", (F.col("id") % 7).alias("line"), F.lit(1).alias("a.b"))
    drawn = sample_rows(df, 100, ["id", "line"])
    text = io.StringIO()
    with redirect_stdout(text):
        drawn.explain("formatted")
    conditions = [line for line in text.getvalue().splitlines() if line.startswith("Condition")]
    assert conditions and not any("%" in line or "pmod" in line for line in conditions)
    assert drawn.columns == df.columns and drawn.count() == 100
