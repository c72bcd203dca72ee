import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayrow.functions import quantiles
from strayrow.functions.quantiles import exact_quantiles

RNG = np.random.default_rng(5)
CASES = {
    "smooth": RNG.lognormal(size=5000),
    "third_is_one_value": np.concatenate([np.full(2000, 7.0), RNG.normal(7, 3, 4000)]),
    "two_values": np.repeat([1.0, 2.0], [3001, 2000]),
    "far_apart": np.concatenate([RNG.normal(size=3000), 1e12 + RNG.normal(size=3000)]),
}
WANTED = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize("case", CASES)
def test_small_path(spark, case):
    df = spark.createDataFrame(pd.DataFrame({"x": CASES[case]}))
    found = exact_quantiles(df, {"x": (F.col("x"), WANTED)})["x"]
    assert np.allclose(found, np.quantile(CASES[case], WANTED), rtol=1e-12)


@pytest.mark.parametrize("case", CASES)
def test_narrowing_gives_the_same_bits(spark, case, monkeypatch):
    monkeypatch.setattr(quantiles, "_MAX_DISTINCT", 50)
    monkeypatch.setattr(quantiles, "_ACCURACY", 100)
    df = spark.createDataFrame(pd.DataFrame({"x": CASES[case]})).repartition(4)
    small = exact_quantiles(df, {"x": (F.col("x"), WANTED)})["x"]
    assert exact_quantiles(df, {"x": (F.col("x"), WANTED)}, small_rows=10)["x"] == small


def test_several_columns_nulls_and_empty(spark):
    df = spark.createDataFrame(
        [(1.0, None, None), (2.0, 5.0, None), (4.0, 7.0, None)], "a double, b double, c double"
    )
    wanted = {c: (F.col(c), [0.5]) for c in "abc"}
    assert exact_quantiles(df, wanted) == {"a": [2.0], "b": [6.0], "c": None}
