import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strayrow.functions.columns import (
    columns_with_role,
    default_features,
    detect_group_date,
    result_group_column,
)
from strayrow.operators.iqr import iqr_detect, iqr_fences
from strayrow.operators.profiling import column_profile, column_roles
from strayrow.operators.registry import DETECTORS, Detector, detect, register_detector
from strayrow.operators.rollup import group_date_rollup, metric_rules
from strayrow.operators.scaling import (
    adaptive_threshold,
    median_impute,
    score_normalize,
    standard_scale,
)
from strayrow.operators.scoring import detect_metadata
from strayrow.operators.zscore import zscore_columns, zscore_detect


def pandas_z(df, features, threshold):
    z = ((df[features] - df[features].mean()) / df[features].std()).abs()
    out = df.assign(max_z=z.max(axis=1))
    out["anomaly"] = (out["max_z"] > threshold).astype(int)
    out["p"] = (out["max_z"].rank(pct=True) * 100).round(2)
    return out


def test_zscore_equals_pandas(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"id": range(500), "a": rng.normal(size=500), "b": rng.exponential(size=500)})
    data.loc[3, "a"] = None
    want = pandas_z(data, ["a", "b"], 2.5)
    got = zscore_detect(spark.createDataFrame(data), ["a", "b"], 2.5).orderBy("id").toPandas()
    assert np.allclose(got["anomaly_score"], want["max_z"])
    assert (got["anomaly"] == want["anomaly"]).all() and got["anomaly"].sum() > 0
    assert (got["anomaly_probability"] == want["p"]).all()


def test_constant_feature_has_no_score(spark):
    df = spark.createDataFrame([(float(5),)] * 4, "x double")
    rows = zscore_detect(df, ["x"]).collect()
    assert {(r["max_zscore"], r["anomaly"], r["anomaly_probability"], r["risk_tier"]) for r in rows} == {
        (None, 0, None, None)
    }


def test_one_row_and_empty(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    assert zscore_detect(one, ["x"]).first()["anomaly_score"] is None
    assert zscore_detect(one.limit(0), ["x"]).count() == 0


def test_nan_and_infinity_count_as_missing(spark):
    values = [1.0, 2.0, 3.0, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    rows = {r["id"]: r for r in zscore_detect(df, ["x"]).collect()}
    assert math.isclose(rows[0]["anomaly_score"], 1.0)
    assert all(rows[i]["anomaly_score"] is None and rows[i]["anomaly"] == 0 for i in (3, 4, 5))


def test_odd_names(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0), (2.0, 3.0, 9.0), (9.0, 1.0, 1.0)], "`my col` double, `a.b` double, `Ünï` double"
    )
    names = ["my col", "a.b", "Ünï"]
    assert zscore_columns(df, names).columns[3:] == ["zscore_my_col", "zscore_a.b", "zscore_Ünï"]
    for method in ("zscore", "iqr"):
        assert detect(df, method, names).count() == 3
    assert median_impute(df, names).count() == 3


def test_iqr_flag_and_score_treat_missing_values_differently(spark):
    rows = [(i, float(i), float(i)) for i in range(20)] + [(20, 1000.0, None), (21, None, 5.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    got = {r["id"]: r for r in iqr_detect(df, ["x", "y"]).collect()}
    assert got[20]["anomaly"] == 1 and got[20]["anomaly_score"] is None
    assert got[20]["risk_tier"] is None
    assert got[21]["anomaly"] == 0 and got[21]["anomaly_score"] is None
    assert got[5]["anomaly_score"] == 0.0


def test_iqr_without_values_is_an_error(spark):
    df = spark.createDataFrame([(1.0, None)], "x double, y double")
    with pytest.raises(ValueError, match="without values: y"):
        iqr_detect(df, ["x", "y"])


def test_iqr_fences_by_hand(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double")
    assert iqr_fences(df, ["x"]).first()[1:] == (2.0, 4.0, -1.0, 7.0)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.integers(-1000, 1000), min_size=8, max_size=40),
    st.integers(1, 50),
    st.sampled_from([2.0, 0.5, 4.0]),
)
def test_shift_and_scale(spark, values, shift, scale):
    data = pd.DataFrame({"id": range(len(values)), "x": np.array(values, float)})
    df = spark.createDataFrame(data)
    moved = df.withColumn("x", F.col("x") * scale + shift)

    def run(detector, frame, name):
        return [r[name] for r in detector(frame, ["x"]).orderBy("id").collect()]

    a, b = (run(zscore_detect, f, "anomaly_score") for f in (df, moved))
    assert a == pytest.approx(b, abs=1e-9) if a[0] is not None else a == b
    assert run(iqr_detect, df, "anomaly") == run(iqr_detect, moved, "anomaly")


def test_normalised_scores_and_threshold(spark):
    df = spark.createDataFrame([(float(v),) for v in (2, 4, 6, 12)], "s double")
    scaled = score_normalize(df, "s")
    assert [r["anomaly_score"] for r in scaled.orderBy("s").collect()] == [0.0, 2.0, 4.0, 10.0]
    # 90 % quantile 8.2, so the limit is 9.84 and the largest score is flagged.
    found = adaptive_threshold(scaled, "anomaly_score", 0.1).orderBy("s").collect()
    assert [r["anomaly"] for r in found] == [0, 0, 0, 1]
    assert found[0]["threshold_value"] == pytest.approx(9.84)
    # From a quantile of 8.34 on, the limit lies beyond the scale: nothing is flagged.
    assert adaptive_threshold(scaled, "anomaly_score", 0.01).agg(F.sum("anomaly")).first()[0] == 0
    flat = score_normalize(spark.createDataFrame([(3.0,), (3.0,)], "s double"), "s")
    assert {r["anomaly_score"] for r in flat.collect()} == {0.0}


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1, 7), (3, 7), (None, 7), (8, 7)], "x int, c int")
    imputed = median_impute(df, ["x", "c"])
    assert sorted(r["x"] for r in imputed.collect()) == [1.0, 3.0, 3.0, 8.0]
    scaled = standard_scale(imputed, ["x", "c"]).toPandas()
    assert abs(scaled["scaled_x"].mean()) < 1e-12
    assert scaled["scaled_x"].std(ddof=0) == pytest.approx(1)
    assert (scaled["scaled_c"] == 0).all()


def test_metadata_counts(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    row = detect_metadata(zscore_detect(df, ["x"]), "zscore", 3.0, 0.25).first()
    assert row["expected_anomalies"] == 2 and row["actual_anomalies"] == 0
    assert row["low_rows"] + row["medium_rows"] + row["high_rows"] + row["critical_rows"] == 10


def test_registry_is_open(spark):
    register_detector("nothing", Detector(lambda df, features: df.withColumn("anomaly", F.lit(0)), "own"))
    try:
        df = spark.createDataFrame([(1.0,)], "x double")
        assert detect(df, "nothing", ["x"]).first()["anomaly"] == 0
    finally:
        del DETECTORS["nothing"]
    with pytest.raises(ValueError, match="unknown detector"):
        detect(df, "nothing", ["x"])


def test_roles_and_column_choice(spark):
    df = spark.createDataFrame(
        [], "id long, week_date date, user_name string, amount decimal(10,2), ok boolean, "
        "tags array<int>, order_date timestamp, x float"
    )
    assert columns_with_role(df, "numeric") == ["id", "amount", "x"]
    assert columns_with_role(df, "other") == ["ok", "tags"]
    assert default_features(df) == ["id", "amount", "x"]
    assert detect_group_date(df) == ("user_name", "order_date")
    assert result_group_column(df) == "user_name"
    assert result_group_column(df.select("id", "x")) is None


def test_rollup_rules_prefer_sum(spark):
    df = spark.createDataFrame(
        [], "emp string, date date, sales int, call_time int, nps int, discount int, other int, dept string"
    )
    assert metric_rules(df, "emp", "date") == {
        "sales": "sum", "call_time": "sum", "nps": "avg", "discount": "sum", "other": "sum",
        "dept": "first",
    }
    assert metric_rules(df, "emp", "date", {"other": "avg"})["other"] == "avg"


def test_rollup_keeps_null_keys(spark):
    df = spark.createDataFrame(
        [(None, "d", 1, "b"), (None, "d", 2, "a"), ("x", "d", 5, None)], "g string, d string, n int, s string"
    )
    rows = [tuple(r) for r in group_date_rollup(df, "g", "d").collect()]
    assert rows == [(None, "d", 3, "a"), ("x", "d", 5, None)]


def test_profile_of_an_empty_and_a_nested_table(spark):
    df = spark.createDataFrame(
        [(1, {"a": 1}, [1]), (1, {"a": 1}, None)], "x int, m map<string,int>, l array<int>"
    )
    rows = {r["column_name"]: r for r in column_profile(df).collect()}
    assert rows["m"]["distinct"] == 1 and rows["l"]["nulls"] == 1 and rows["l"]["null_pct"] == 50.0
    assert {r["null_pct"] for r in column_profile(df.limit(0)).collect()} == {0.0}
    assert {r["role"]: r["column_count"] for r in column_roles(df).collect()}["other"] == 2
    approximate = {r["column_name"]: r["distinct"] for r in column_profile(df, True).collect()}
    assert approximate == {"x": 1, "m": 1, "l": 1}


def test_wide_profile_keeps_column_order(spark):
    df = spark.range(5).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(23)])
    rows = column_profile(df).collect()
    assert [r["column_name"] for r in rows] == df.columns
    assert [r["distinct"] for r in rows[:6]] == [1, 2, 3, 4, 5, 5]
