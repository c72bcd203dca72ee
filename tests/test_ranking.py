import io
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayrow.functions import ranking
from strayrow.functions.ranking import lookup_steps, percent_rank_avg, score_distribution
from strayrow.functions.tiers import risk_tier, tier_counts, tier_of_score


def scores(spark, values):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(values)), "s": values}))


def expected_rank(values):
    return (pd.Series(values).rank(pct=True) * 100).round(2)


CASES = {
    "smooth": np.random.default_rng(1).normal(size=3000),
    "ties": np.random.default_rng(2).integers(0, 12, 2000).astype(float),
    "mostly_zero": np.where(np.arange(2000) % 20, 0.0, np.arange(2000) / 7.0),
    "one_value": np.full(50, 2.5),
    "one_row": np.array([1.0]),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("bucket_rows, fast_rows", [(500_000, 2_000_000), (40, 0)])
def test_probability_equals_pandas(spark, case, bucket_rows, fast_rows, monkeypatch):
    monkeypatch.setattr(ranking, "FAST_LOOKUP_ROWS", fast_rows)
    values = CASES[case]
    found = percent_rank_avg(scores(spark, values), "s", "p", bucket_rows).orderBy("id").toPandas()
    assert (found["p"] == expected_rank(values)).all()


@pytest.mark.parametrize("fast_rows", [2_000_000, 0])
def test_missing_scores_stay_missing(spark, fast_rows, monkeypatch):
    monkeypatch.setattr(ranking, "FAST_LOOKUP_ROWS", fast_rows)
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, float("nan")), (4, 1.0)], "id int, s double")
    df = df.withColumn("s", F.when(~F.isnan("s"), F.col("s")))
    found = {r["id"]: r["p"] for r in percent_rank_avg(df, "s", "p").collect()}
    assert found == {1: 100.0, 2: None, 3: None, 4: 50.0}


def test_no_scores_at_all(spark):
    df = spark.createDataFrame([(1, None)], "id int, s double")
    assert percent_rank_avg(df, "s", "p").first()["p"] is None
    assert percent_rank_avg(df.limit(0), "s", "p").count() == 0


@pytest.mark.parametrize("bucket_rows", [500_000, 25])
def test_quantiles_of_a_distribution(spark, bucket_rows):
    for values in CASES.values():
        wanted = [0.0, 0.05, 0.5, 0.85, 0.95, 1.0]
        found = score_distribution(scores(spark, values), F.col("s"), bucket_rows).quantiles(wanted)
        assert np.allclose(found, np.quantile(values, wanted), rtol=1e-14)


def test_probability_does_not_fall_and_tiers_add_up(spark):
    df = percent_rank_avg(scores(spark, CASES["smooth"]), "s", "anomaly_probability")
    df = df.withColumn("risk_tier", risk_tier(F.col("anomaly_probability")))
    ordered = df.orderBy("s").toPandas()["anomaly_probability"]
    assert ordered.is_monotonic_increasing
    counts = tier_counts(df).collect()
    assert sum(r["rows"] for r in counts) == 3000
    assert [r["rows"] for r in counts] == [1500, 600, 600, 300]


@pytest.mark.parametrize("case", CASES)
def test_tier_by_score_equals_tier_by_probability(spark, case):
    df = scores(spark, CASES[case])
    steps = score_distribution(df, F.col("s")).steps()
    both = lookup_steps(df, "s", steps, "p", 0).select(
        risk_tier(F.col("p")).alias("a"), tier_of_score(F.col("s"), steps).alias("b")
    )
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def test_tier_edges(spark):
    edges = [0.0, 50.0, 50.01, 70.0, 70.01, 90.0, 90.01, 100.0, None]
    df = spark.createDataFrame([(e,) for e in edges], "p double")
    assert [r[0] for r in df.select(risk_tier(F.col("p"))).collect()] == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL", None,
    ]


def test_filter_on_the_result_stays_small(spark):
    df = percent_rank_avg(scores(spark, CASES["smooth"]), "s", "p").where("p > 90")
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    assert len(text.getvalue()) < 20_000
    assert df.count() == 300


def test_partitioning_does_not_matter(spark):
    df = scores(spark, CASES["smooth"])
    results = [
        percent_rank_avg(df.repartition(n), "s", "p").orderBy("id").toPandas()["p"] for n in (1, 5)
    ]
    assert (results[0] == results[1]).all()
