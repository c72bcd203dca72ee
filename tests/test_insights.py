import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayrow.functions.materialize import pin
from strayrow.functions.sampling import sample_rows
from strayrow.operators import insights, series, views


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    n = 400
    data = pd.DataFrame(
        {
            "id": range(n),
            "kind": [None if i % 40 == 0 else "abcde"[i % 5] for i in range(n)],
            "place": ["north" if i % 3 else "south" for i in range(n)],
            "x": rng.normal(size=n),
            "y": rng.exponential(size=n),
            "anomaly_score": np.round(rng.exponential(size=n), 1),
        }
    )
    data["anomaly"] = ((data["anomaly_score"] > 2) | (data["kind"] == "c")).astype(int)
    data["anomaly_probability"] = (data["anomaly_score"].rank(pct=True) * 100).round(2)
    return pin(spark.createDataFrame(data))


def test_category_rates_drop_missing_values(scored):
    got = insights.category_rates(scored, ["kind", "place"], 2).toPandas()
    data = scored.toPandas()
    want = data.groupby("kind")["anomaly"].agg(["sum", "count"])
    want["rate"] = want["sum"] / want["count"] * 100
    best = want.sort_values("rate", ascending=False).head(2)
    mine = got[got["category"] == "kind"].sort_values("position")
    assert list(mine["value"]) == list(best.index) and np.allclose(mine["anomaly_rate"], best["rate"])
    assert len(got) == 4


def test_feature_contrast_equals_pandas(scored):
    data = scored.toPandas()
    a, b = data[data["anomaly"] == 1], data[data["anomaly"] == 0]
    for r in insights.feature_contrast(scored, ["x", "y"]).collect():
        f = r["feature"]
        assert r["anomaly_mean"] == pytest.approx(a[f].mean())
        assert r["normal_mean"] == pytest.approx(b[f].mean())
        assert r["anomaly_std"] == pytest.approx(a[f].std())
        assert r["difference"] == pytest.approx(abs(a[f].mean() - b[f].mean()))


@pytest.mark.parametrize("flag", [0, 1])
def test_only_one_class(scored, flag):
    one = scored.withColumn("anomaly", F.lit(flag))
    assert all(r["difference"] is None for r in insights.feature_contrast(one, ["x"]).collect())
    assert insights.primary_feature(one, ["x"]).count() == flag
    assert insights.hotspot(one, ["kind"]).count() == 0
    counts = {r["class"]: r["rows"] for r in series.class_counts(one).collect()}
    assert counts == {"normal": 400 * (1 - flag), "anomaly": 400 * flag}


def test_empty_table(scored):
    none = scored.limit(0)
    assert insights.summary(none, "m").first()[:3] == (0, 0, 0.0)
    assert insights.verdict(none).first()["verdict"] == "excellent"
    assert series.score_histogram(none).count() == 0
    assert series.daily_series(none.withColumn("d", F.current_date()), "d").count() == 0
    assert insights.extreme_count(none).first()["extreme_rows"] == 0


@pytest.mark.parametrize(
    "anomalies, total, expected, want",
    [
        (0, 200, None, "excellent"),
        (4, 200, None, "good"),
        (10, 200, None, "moderate"),
        (20, 200, None, "high"),
        (21, 200, 0.1, "on target"),
        (22, 200, 0.1, "high alert"),
        (18, 200, 0.1, "cleaner than expected"),
        (0, 200, 0.1, "excellent"),
    ],
)
def test_verdicts(spark, anomalies, total, expected, want):
    df = spark.range(total).select((F.col("id") < anomalies).cast("int").alias("anomaly"))
    assert insights.verdict(df, expected).first()["verdict"] == want


@pytest.mark.parametrize(
    "flagged, normal, want", [(9, 3, "higher"), (1, 4, "lower"), (0, 4, "zero"), (5, 4, "notable"), (5, 0, "zero")]
)
def test_primary_feature_findings(spark, flagged, normal, want):
    df = spark.createDataFrame([(float(flagged), 1), (float(normal), 0)], "x double, anomaly int")
    assert insights.primary_feature(df, ["x"]).first()["finding"] == want


def test_hotspot_takes_the_first_category(scored):
    row = insights.hotspot(scored, ["place", "kind"]).first()
    assert (row["category"], row["value"], row["anomaly_rate"]) == ("kind", "c", 100.0)
    assert row["level"] == "high" and row["ratio"] == pytest.approx(100 / row["overall_rate"])


def test_top_and_extreme(scored):
    data = scored.toPandas()
    got = [r["anomaly_score"] for r in insights.top_anomalies(scored, ["id"]).collect()]
    assert got == sorted(data["anomaly_score"], reverse=True)[:5]
    cut = data["anomaly_score"].quantile(0.95)
    assert insights.extreme_count(scored).first()["extreme_rows"] == (data["anomaly_score"] > cut).sum()


def test_daily_gaps_are_filled(spark):
    rows = [("2024-01-01", 1), ("2024-01-01", 0), ("2024-01-04 10:00:00", 0), ("not a date", 1), (None, 1)]
    df = spark.createDataFrame(rows, "d string, anomaly int")
    got = [tuple(r) for r in series.daily_series(df, "d").collect()]
    day = datetime.date
    assert got == [
        (day(2024, 1, 1), 1, 2, 50.0),
        (day(2024, 1, 2), 0, 0, 0.0),
        (day(2024, 1, 3), 0, 0, 0.0),
        (day(2024, 1, 4), 0, 1, 0.0),
    ]


def test_histogram_counts_every_score_once(scored):
    rows = series.score_histogram(scored, 10).toPandas()
    want, _ = np.histogram(scored.toPandas()["anomaly_score"], 10)
    assert list(rows.groupby("bin")["rows"].sum().reindex(range(10), fill_value=0)) == list(want)
    flat = series.score_histogram(scored.withColumn("anomaly_score", F.lit(2.0)))
    assert set(r["bin"] for r in flat.collect()) == {0}


def test_box_summary_equals_numpy(scored):
    data = scored.toPandas()
    for r in series.box_summary(scored, ["x", "y"]).collect():
        v = data[data["anomaly"] == (r["class"] == "anomaly")][r["feature"]]
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, q2, q3))
        assert (r["whisker_low"], r["whisker_high"]) == (inside.min(), inside.max())
        assert r["outliers"] == len(v) - len(inside)


def test_views(scored):
    from strayrow.functions.tiers import risk_tier

    df = scored.withColumn("risk_tier", risk_tier(F.col("anomaly_probability")))
    assert views.filter_results(df).count() == df.where(
        "anomaly = 1 and risk_tier in ('CRITICAL', 'HIGH')"
    ).count()
    everything = views.filter_results(df, tiers=None, anomalies_only=False)
    assert everything.count() == 400
    edge = df.agg(F.max("anomaly_probability")).first()[0]
    assert views.filter_results(df, probability=(edge, edge), anomalies_only=False).count() >= 1
    ordered = [r["anomaly_probability"] for r in views.order_results(df).collect()]
    assert ordered == sorted(ordered, reverse=True)
    ranked = views.order_results(df.withColumn("priority_score", -F.col("anomaly_probability")))
    assert ranked.first()["anomaly_probability"] == min(ordered)


@pytest.mark.parametrize("n", [1, 100, 399, 400, 1000])
def test_sample_size_is_exact(scored, n):
    got = sample_rows(scored, n, ["id"])
    assert got.count() == min(n, 400) == got.select("id").distinct().count()
    again = sample_rows(scored.repartition(5), n, ["id"])
    assert got.select("id").exceptAll(again.select("id")).count() == 0


def test_large_samples_are_cut_at_a_hash_value(scored, monkeypatch):
    from strayrow.functions import sampling

    small = {r["id"] for r in sample_rows(scored, 150, ["id"]).collect()}
    monkeypatch.setattr(sampling, "TOP_K_ROWS", 10)
    assert {r["id"] for r in sample_rows(scored, 150, ["id"]).collect()} == small
    copies = scored.select(F.lit(7).alias("id"))
    assert sample_rows(copies, 150, ["id"]).count() == 150


def test_review_sample(scored):
    rows = insights.review_sample(scored, 20, ["id"]).collect()
    assert len(rows) == 20 and all(r["anomaly"] == 1 for r in rows)
    assert series.scatter_sample(scored, ["x", "y"], 50, ["id"]).columns == ["id", "x", "y", "anomaly"]
