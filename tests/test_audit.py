import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayrow.functions import skew
from strayrow.functions.materialize import pin
from strayrow.functions.skew import attach
from strayrow.operators.audit import (
    audit_stats,
    default_target,
    group_priority,
    prioritize,
    row_priority,
)
from strayrow.operators.funnel import (
    Settings,
    audit_funnel,
    funnel_final,
    funnel_severity,
    funnel_simple,
    funnel_stages,
    tier_group_counts,
)
from strayrow.operators.zscore import zscore_detect


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    n = 600
    data = pd.DataFrame(
        {
            "agent": [None if i % 50 == 0 else f"a{i % 13}" for i in range(n)],
            "day": pd.date_range("2024-01-01", periods=n, freq="h"),
            "x": rng.exponential(size=n),
            "y": rng.normal(size=n),
        }
    )
    return pin(zscore_detect(spark.createDataFrame(data), ["x", "y"], 2.0))


def test_group_priority_equals_a_loop_over_groups(scored):
    data = scored.toPandas()
    got = {r["agent"]: r for r in group_priority(scored, "agent").collect()}
    assert set(got) == set(data["agent"].dropna())
    for agent, part in data.dropna(subset="agent").groupby("agent"):
        days = part["risk_tier"].isin(["CRITICAL", "HIGH"]).sum()
        want = (
            part["anomaly_probability"].mean() * 0.4
            + min(days * 10, 50) * 0.35
            + part["anomaly_score"].max() / 10 * 30 * 0.15
        )
        assert got[agent]["priority_score"] == pytest.approx(want)
        assert got[agent]["critical_days"] == days


def test_metric_count_adds_to_the_priority(scored):
    plain = {r["agent"]: r["priority_score"] for r in group_priority(scored, "agent").collect()}
    more = scored.withColumn("anomalous_metric_count", F.lit(3))
    for r in group_priority(more, "agent").collect():
        assert r["priority_score"] == pytest.approx(plain[r["agent"]] + 1.5)


@pytest.mark.parametrize("target, null_group_in", [(5, False), (13, False), (14, True)])
def test_recommended_rows(scored, target, null_group_in):
    found = prioritize(scored, target)
    rows = found.rows.toPandas()
    assert found.mode == "intelligent" and found.group == "agent" and len(rows) == 600
    assert rows.dropna(subset="agent").query("recommended_for_audit")["agent"].nunique() == min(target, 13)
    nulls = rows[rows["agent"].isna()]
    assert (nulls["priority_score"] == 0).all() and (nulls["recommended_for_audit"] == null_group_in).all()
    assert audit_stats(scored, found).first()["recommended_count"] == min(target, 13)


def test_nothing_flagged_leaves_the_table_alone(scored):
    calm = scored.withColumn("anomaly", F.lit(0))
    found = prioritize(calm)
    assert found.mode == "no_anomalies" and found.rows.columns == calm.columns
    assert audit_funnel(calm, ["x", "y"]) is None


def test_without_group_column(scored):
    bare = scored.drop("agent")
    found = prioritize(bare)
    assert found.mode == "simple" and "recommended_for_audit" not in found.rows.columns
    row = row_priority(bare).first()
    assert row["priority_score"] == row["anomaly_score"] * row["anomaly_probability"] / 100
    simple = funnel_simple(bare, 0.95).toPandas()
    cut = simple["anomaly_score"].quantile(0.95)
    want = (simple["anomaly"] == 1) & (simple["anomaly_score"] >= cut)
    assert (simple["simple_priority"] == want).all() and want.any()


def test_default_target():
    assert (default_target(95), default_target(5000)) == (9, 50)


def test_attach_with_hot_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    keys = ["hot"] * 500 + [None] * 300 + [f"k{i % 90}" for i in range(400)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string").repartition(6)
    groups = pin(
        rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    )
    small = attach(rows, groups, "k", ["first"], "n")
    large = attach(rows, groups, "k", ["first"], "n", broadcast_rows=0)
    assert large.columns == ["id", "k", "first"] and small.count() == 1200
    a, b = ({r["id"]: r["first"] for r in d.collect()} for d in (small, large))
    assert a == b and a[0] == 0 and a[600] is None


def funnel_by_hand(data, settings, has_date, by_row):
    """The stages on a pandas table."""
    urgent = data[data["risk_tier"].isin(["CRITICAL", "HIGH"])]
    days = urgent.groupby("agent").size()
    often = set(days[days >= settings.frequency].index)
    cut = data["anomaly_score"].quantile(settings.severity)
    hits = sum(
        (((data[c] - data[c].mean()) / data[c].std()).abs() > 2).astype(int) for c in ("x", "y")
    )
    metrics = data.assign(h=hits).groupby("agent")["h"].sum()
    several = set(metrics[metrics >= settings.metrics].index)
    severe = (data["anomaly"] == 1) & (data["anomaly_score"] >= cut)
    if has_date:
        severe &= data["agent"].isin(often)
    if by_row:
        return severe & data["agent"].isin(several)
    return (data["anomaly"] == 1) & data["agent"].isin(set(data[severe]["agent"]) & several)


@pytest.mark.parametrize("variant", ["A", "B"])
@pytest.mark.parametrize("date", ["day", None])
def test_funnel_equals_pandas(scored, variant, date):
    settings = Settings("A", 14, 0.9, 2) if variant == "A" else Settings.fixed(date is not None)
    found = audit_funnel(scored, ["x", "y"], date, settings)
    data = scored.toPandas()
    want = funnel_by_hand(data, found.settings, date is not None, variant == "B")
    got = funnel_final(found).toPandas()
    if variant == "A":
        assert 0 < len(got)
    assert sorted(got["day"]) == sorted(data[want & data["agent"].notna()]["day"])
    stages = {r["name"]: r for r in funnel_stages(found).collect()}
    assert ("Frequency Filter" in stages) == (date is not None or variant == "B")
    assert stages["Multi-Metric Consensus"]["records_remaining"] == len(got)
    assert funnel_severity(found).where("agent is not null").count() == stages["Severity Filter"]["groups_remaining"]
    if date or variant == "B":
        assert sum(r["group_count"] for r in tier_group_counts(found).collect()) > 0
    else:
        assert "audit_tier" not in found.rows.columns


def test_funnel_with_too_few_metrics(scored):
    found = audit_funnel(scored, ["x"], "day", Settings("A", 1, 0.9, 2))
    assert not found.by_metrics and "anomalous_metric_count" not in found.rows.columns
    assert [r["name"] for r in funnel_stages(found).collect()] == [
        "Initial", "Frequency Filter", "Severity Filter",
    ]
