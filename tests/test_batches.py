import io
from contextlib import redirect_stdout

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayrow.functions import grouped
from strayrow.functions.materialize import Scratch, new_path
from strayrow.operators import batches
from strayrow.operators.batches import batch_detect, batch_summary
from strayrow.operators.iqr import iqr_detect
from strayrow.operators.zscore import zscore_detect
from strayrow.sources.files import scan_batch

DETECTORS = {"zscore": zscore_detect, "iqr": iqr_detect}
ADDED = ["anomaly", "anomaly_score", "anomaly_probability", "risk_tier"]


def rows_of(df):
    plain = lambda v: "nan" if v != v else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    odd = F.when(F.col("id") % 41 == 0, F.lit(None)).when(F.col("id") % 43 == 0, float("nan"))
    df = spark.range(3_000).select(
        "id",
        odd.otherwise(F.round(F.randn(3) * 10 + F.col("id") % 4 * 50, 1)).alias("x"),
        F.floor(F.rand(4) * 6).alias("y"),
        # One group has two thirds of all rows, one a single row, one is missing.
        F.when(F.col("id") == 7, "alone").when(F.col("id") % 3 > 0, "big").when(F.col("id") % 5 > 0, F.concat(F.lit("g"), F.col("id") % 1)).alias("team"),
    )
    path = new_path(spark, "rows")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("method", DETECTORS)
@pytest.mark.parametrize("steps", [500_000, 0])
def test_each_group_as_if_alone(spark, rows, method, steps, monkeypatch):
    monkeypatch.setattr(grouped, "BROADCAST_STEPS", steps)
    got = batch_detect(rows, ["x", "y"], method, by="team")
    shown = ["id", "team", *ADDED]
    expected = []
    for team in [r["team"] for r in rows.select("team").distinct().collect()]:
        alone = rows.where(F.col("team").eqNullSafe(F.lit(team)))
        expected += rows_of(DETECTORS[method](alone, ["x", "y"]).select(*shown))
    assert rows_of(got.select(*shown)) == sorted(expected, key=str)
    assert got.columns == [*rows.columns, *ADDED]


def test_files_and_folders_are_keys(spark, rows):
    path = new_path(spark, "files")
    rows.where("team IS NOT NULL").repartition(3).write.partitionBy("team").option("header", True).csv(path)
    read = scan_batch(spark, f"{path}/*/*.csv", unit="folder", header=True, delimiter=",", schema="id long, x double, y long")
    found = batch_summary(batch_detect(read, ["y"]))
    names = {r["source_file"].rsplit("=", 1)[1]: r["total_records"] for r in found.collect()}
    assert names == {r["team"]: r["count"] for r in rows.where("team IS NOT NULL").groupBy("team").count().collect()}
    by_file = scan_batch(spark, f"{path}/*/*.csv", header=True, delimiter=",", schema="id long, x double, y long")
    assert by_file.select("source_file").distinct().count() > len(names)
    with pytest.raises(ValueError):
        scan_batch(spark, f"{path}/x.xlsx")
    with pytest.raises(ValueError):
        scan_batch(spark, f"{path}/x.csv", unit="line")


def test_group_without_values(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1.0), (4, "b", 5.0)], "id long, g string, v double")
    for method in DETECTORS:
        got = {r["id"]: (r["anomaly"], r["anomaly_score"], r["risk_tier"]) for r in batch_detect(df, ["v"], method, by="g").collect()}
        assert got[1] == got[2] == (0, None, None)
        assert got[3][1] is not None
    assert batch_detect(df.limit(0), ["v"], by="g").count() == 0
    with pytest.raises(ValueError):
        batch_detect(df, ["v"], "lof", by="g")


def test_quantiles_of_groups_over_several_partitions(spark, rows):
    usual = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scratch = Scratch(spark, "test")
        known = rows.where("team IS NOT NULL")
        found = grouped.grouped_distribution(known, ["team"], F.col("x"), scratch, "d")
        parts = spark.read.parquet(f"{scratch._folder}/d-counts").where("team = 'big'").select("part").distinct().count()
        assert parts > 1
        got = grouped.grouped_quantiles(found, ["team"], {"p": 0.1, "q": 0.5, "r": 0.93}).toPandas().set_index("team")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", usual)
    data = known.select("team", "x").toPandas().dropna()
    for name, p in (("p", 0.1), ("q", 0.5), ("r", 0.93)):
        expected = data.groupby("team")["x"].quantile(p)
        pd.testing.assert_series_equal(got[name].sort_index(), expected.sort_index(), check_names=False)


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_all_groups_are_fitted_in_one_scan(spark, rows):
    fit = plan(batches.group_moments(rows, ["x", "y"], "team"))
    assert fit.count("ReadSchema") == 1 and fit.count("hashpartitioning") == 1
    result = plan(batch_detect(rows, ["x", "y"], by="team"))
    # One scan of the rows, to which the numbers of the groups are attached; only steps are shuffled.
    assert result.count("y:bigint") == 1 and result.count("hashpartitioning") == 1
