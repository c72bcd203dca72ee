"""What the plans must and must not contain."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from strayrow.functions.materialize import pin
from strayrow.functions.skew import attach
from strayrow.operators.insights import category_rates
from strayrow.operators.iqr import iqr_detect
from strayrow.operators.profiling import column_profile
from strayrow.operators.rollup import group_date_rollup
from strayrow.operators.zscore import zscore_detect
from strayrow.plans.analysis import analyse, roll_up_if_possible


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def test_detection_adds_no_shuffle_to_the_rows(spark, sf):
    for detector in (zscore_detect, iqr_detect):
        text = plan(detector(events(spark, sf), ["value"]))
        assert "Exchange" not in text and "Window" not in text and "Join" not in text


def test_filter_on_the_tier_is_a_filter_on_the_score(spark, sf):
    found = zscore_detect(events(spark, sf), ["value"]).where("risk_tier = 'CRITICAL'").select("event_id")
    text = plan(found)
    assert "reduce" not in text and re.search(r"ReadSchema: struct<event_id:bigint,value:double>", text)


def test_scans_read_only_what_is_needed(spark, sf):
    text = plan(category_rates(zscore_detect(events(spark, sf), ["value"]), ["event_type"]))
    assert "ReadSchema: struct<event_type:string,value:double>" in text
    assert "Exchange SinglePartition" not in text


def test_lookup_of_many_groups_salts_the_shuffle(spark, sf):
    rows = events(spark, sf)
    groups = pin(rows.groupBy("user_id").agg(F.count("*").alias("n")))
    setting = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        text = plan(attach(rows, groups, "user_id", ["n"], "n", broadcast_rows=0))
    finally:
        spark.conf.set(setting, usual)
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", text)
    assert keys and all("user_id" in k and "_salt" in k for k in keys)
    assert "Exchange" not in plan(attach(rows, groups, "user_id", ["n"], "n")).replace("BroadcastExchange", "")


def test_rollup_combines_before_the_shuffle(spark, sf):
    daily = group_date_rollup(
        events(spark, sf).withColumn("day", F.to_date("ts")).select("user_id", "day", "value"),
        "user_id", "day", ordered=False,
    )
    text = plan(daily)
    assert text.count("hashpartitioning") == 1 and "partial_sum" in text


def test_profile_of_four_columns_is_one_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_tax", "l_discount", "l_returnflag", "l_shipdate")
    assert plan(column_profile(df)).count("Scan parquet") == 2  # listed in the tree and in detail


def test_whole_analysis(spark, sf):
    daily = roll_up_if_possible(events(spark, sf).withColumn("event_date", F.to_date("ts")).drop("ts"))
    assert daily.count() == 397
    found = analyse(daily, features=["value"], target=3)
    assert found.mode == "intelligent" and found.top.count() == 3
    assert found.rows.where("recommended_for_audit").select("user_id").distinct().count() == 3
