"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.functions import columns, ranking, sampling, tiers
from strayrow.functions.materialize import new_path, pin_table
from strayrow.operators import (
    audit,
    batches,
    dbscan as density,
    forest,
    funnel,
    insights,
    iqr,
    lof,
    models,
    profiling,
    registry,
    rollup,
    scaling,
    scoring,
    series,
    sketches,
    svm,
    views,
    zscore,
)
from strayrow.session import ship_package
from strayrow.sources import files
from strayrow.sources.sample import add_sample_columns
from strayrow.streaming import detection, sinks

FEATURES = ["value_sum", "event_count"]
KEY = ["user_id", "event_date"]
CATEGORIES = ["event_type", "activity"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(ship_package(spark), sf_dir)

    QUERIES[run.__name__] = shipped
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.scan_parquet(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("event_date", F.to_date("ts"))


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rolled up per user and day, written once, as every detector reads it twice."""
    events = dated_events(spark, sf_dir).select(
        *KEY, F.col("value").alias("value_sum"), F.lit(1).alias("event_count"), "event_type"
    )
    daily = rollup.group_date_rollup(events, *KEY, ordered=False)
    busy = F.when(F.col("event_count") >= 5, "busy").otherwise("quiet")
    return pin_table(rounded(daily, "value_sum", digits=2).withColumn("activity", busy))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zscore.zscore_detect(user_day(spark, sf_dir), FEATURES)


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return zscore.zscore_detect(events, ["value"])


# Sources and sinks


@query
def format_by_suffix(spark, sf_dir):
    endings = [".CSV", ".xlsx", ".xls", ".txt", ".Parquet", ".json", ""]
    ending = F.get(F.array(*map(F.lit, endings)), (F.col("doc_id") % len(endings)).cast("int"))
    named = table(spark, sf_dir, "documents").select(F.concat("source", ending).alias("name"))
    return named.groupBy(files.format_of(F.col("name")).alias("format")).agg(
        F.count(F.lit(1)).alias("files")
    )


@query
def scan_parquet(spark, sf_dir):
    return files.scan_parquet(spark, f"{sf_dir}/customer.parquet")


@query
def scan_csv(spark, sf_dir):
    path = new_path(spark, "customer") + ".csv"
    files.write_csv(table(spark, sf_dir, "customer"), path)
    return files.scan_csv(spark, path)


@query
def scan_txt(spark, sf_dir):
    path = new_path(spark, "orders") + ".txt"
    orders = table(spark, sf_dir, "orders").drop("o_orderdate")
    orders.write.options(header=True, sep="|").csv(path)
    return files.load(spark, path)


@query
def convert_to_parquet(spark, sf_dir):
    source = new_path(spark, "supplier") + ".csv"
    files.write_csv(table(spark, sf_dir, "supplier"), source)
    converted = files.convert_to_parquet(spark, source, new_path(spark, "supplier"))
    counts = F.lit(converted.row_count).cast("bigint").alias("row_count")
    return files.scan_parquet(spark, converted.path).select(
        counts, F.lit(converted.column_count).alias("column_count"), "s_suppkey", "s_name", "s_acctbal"
    )


@query
def write_parquet(spark, sf_dir):
    path = new_path(spark, "results")
    files.write_parquet(scored(spark, sf_dir), path)
    return rounded(files.scan_parquet(spark, path).drop("event_type", "activity"), *SCORE_COLUMNS)


@query
def write_csv(spark, sf_dir):
    path = new_path(spark, "results") + ".csv"
    results = scored(spark, sf_dir)
    files.write_csv(results, path)
    back = files.scan_csv(spark, path, results.schema.simpleString()[7:-1].replace(":", " "), ",", True)
    return rounded(back.drop("event_type", "activity"), *SCORE_COLUMNS)


SCORE_COLUMNS = ["zscore_value_sum", "zscore_event_count", "max_zscore", "anomaly_score"]


@query
def sample_dataset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    sample = add_sample_columns(orders, "o_orderkey", orders.count(), 42)
    return sample.groupBy("planted").agg(F.count(F.lit(1)).alias("rows"))


# Profiling


@query
def table_shape(spark, sf_dir):
    return profiling.table_shape(table(spark, sf_dir, "lineitem"))


@query
def column_profile(spark, sf_dir):
    return rounded(profiling.column_profile(table(spark, sf_dir, "lineitem")), "null_pct")


@query
def column_roles(spark, sf_dir):
    return profiling.column_roles(table(spark, sf_dir, "lineitem"))


@query
def default_features(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    chosen = columns.default_features(lines)
    listed = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in chosen]
    )
    means = lines.agg(*[F.round(F.avg(c), 4).alias(c) for c in chosen])
    return means.select(F.inline(listed))


@query
def preview(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return profiling.preview(table(spark, sf_dir, "lineitem").select(*order), 1000, order)


@query
def sample_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_rows(orders, 1000, ["o_orderkey"])


@query
def detect_group_date(spark, sf_dir):
    events = dated_events(spark, sf_dir).drop("ts")
    group, date = columns.detect_group_date(events)
    return events.agg(
        F.lit(group).alias("group_column"),
        F.lit(date).alias("date_column"),
        F.count_distinct(columns.col(group)).alias("groups"),
        F.count_distinct(columns.col(date)).alias("dates"),
    )


@query
def sensitivity_band(spark, sf_dir):
    rates = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
        .select("user_id", "events", (F.col("errors") / F.col("events")).alias("rate"))
    )
    return rounded(profiling.explain_sensitivity(rates, "rate", "events"), "rate")


# Rollup


@query
def rollup_metric_rule(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rules = rollup.metric_rules(lines, "l_orderkey", "l_shipdate")
    builders = {"sum": F.sum, "avg": F.avg, "first": lambda c: F.max(F.lit(None).cast("double"))}
    totals = lines.agg(*[builders[r](c).cast("double").alias(c) for c, r in rules.items()])
    listed = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(r).alias("rule"), F.round(c, 2).alias("value")
            )
            for c, r in rules.items()
        ]
    )
    return totals.select(F.inline(listed))


@query
def group_date_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rolled = rollup.group_date_rollup(
        lines, "l_suppkey", "l_shipdate", overrides={"l_tax": "avg"}, grain="day"
    )
    return rounded(rolled, "l_quantity", "l_extendedprice", "l_discount", "l_tax", digits=4)


@query
def rollup_reduction(spark, sf_dir):
    return rounded(rollup.rollup_reduction(dated_events(spark, sf_dir), *KEY), "reduction_pct")


# Statistical detectors


@query
def zscore_columns(spark, sf_dir):
    found = zscore.zscore_columns(user_day(spark, sf_dir), FEATURES)
    return rounded(found, *SCORE_COLUMNS[:2]).drop("activity", "event_type")


@query
def zscore_max(spark, sf_dir):
    found = zscore.zscore_max(user_day(spark, sf_dir), FEATURES)
    return rounded(found, *SCORE_COLUMNS[:3]).drop("activity", "event_type")


@query
def zscore_detect(spark, sf_dir):
    return rounded(scored(spark, sf_dir), *SCORE_COLUMNS)


@query
def iqr_fences(spark, sf_dir):
    found = iqr.iqr_fences(user_day(spark, sf_dir), FEATURES)
    return rounded(found, "q1", "q3", "lower", "upper")


@query
def iqr_score(spark, sf_dir):
    found = iqr.iqr_score(user_day(spark, sf_dir), FEATURES)
    return rounded(found, "anomaly_score").drop("activity", "event_type")


@query
def iqr_detect(spark, sf_dir):
    return rounded(iqr.iqr_detect(user_day(spark, sf_dir), FEATURES), "anomaly_score")


@query
def detect_metadata(spark, sf_dir):
    return scoring.detect_metadata(scored(spark, sf_dir), "zscore", 3.0)


# Model-based detectors


@query
def median_impute(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return scaling.median_impute(documents.join(labels, "doc_id", "left"), ["n_chars", "quality"])


@query
def standard_scale(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    found = scaling.standard_scale(customers, ["c_nationkey", "c_acctbal"])
    return rounded(found, "scaled_c_nationkey", "scaled_c_acctbal")


@query
def isolation_forest(spark, sf_dir):
    return rounded(forest.isolation_forest(user_day(spark, sf_dir), FEATURES, 0.1, KEY), "anomaly_score")


@query
def local_outlier_factor(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    found = lof.local_outlier_factor(customers, ["c_nationkey", "c_acctbal"], 0.1)
    return rounded(found, "anomaly_score", digits=4).select("c_custkey", "anomaly_score", "anomaly")


@query
def one_class_svm(spark, sf_dir):
    return svm.one_class_svm(user_day(spark, sf_dir), FEATURES, 0.1, KEY)


def _normalized(spark, sf_dir):
    largest = zscore.zscore_max(user_day(spark, sf_dir), FEATURES).select(*KEY, "max_zscore")
    return scaling.score_normalize(largest, "max_zscore")


@query
def score_normalize(spark, sf_dir):
    return rounded(_normalized(spark, sf_dir), "max_zscore", "anomaly_score")


@query
def adaptive_threshold(spark, sf_dir):
    found = scaling.adaptive_threshold(_normalized(spark, sf_dir), "anomaly_score", 0.01)
    return rounded(found, "max_zscore", "anomaly_score", "threshold_value")


@query
def expected_vs_actual(spark, sf_dir):
    return rounded(scoring.expected_vs_actual(scored(spark, sf_dir), 0.05), "difference_pct")


@query
def ml_sample_policy(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    key = ["l_orderkey", "l_linenumber"]
    sizes = [
        registry.ml_sample_policy(lines, method, key).agg(
            F.lit(method).alias("method"), F.count(F.lit(1)).alias("rows")
        )
        for method in ("isolation_forest", "lof", "one_class_svm")
    ]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query
def detector_registry(spark, sf_dir):
    days = user_day(spark, sf_dir)
    found = None
    for method, detector in registry.DETECTORS.items():
        flagged = registry.detect(days, method, FEATURES, KEY).agg(
            F.lit(method).alias("method"),
            F.lit(detector.kind).alias("kind"),
            F.count(F.lit(1)).alias("rows"),
            F.sum("anomaly").alias("anomalies"),
        )
        found = flagged if found is None else found.unionByName(flagged)
    return found


# Probability and tiers


def _ranked_events(spark, sf_dir):
    whole = table(spark, sf_dir, "events").select("event_id", F.rint("value").alias("whole_value"))
    return ranking.percent_rank_avg(whole, "whole_value")


@query
def percent_rank_avg(spark, sf_dir):
    return _ranked_events(spark, sf_dir)


@query
def risk_tier(spark, sf_dir):
    tier = tiers.risk_tier(F.col("anomaly_probability"))
    named = _ranked_events(spark, sf_dir).withColumn("risk_tier", tier)
    return named.withColumn("tier_order", tiers.tier_order(F.col("risk_tier")))


@query
def tier_counts(spark, sf_dir):
    return rounded(tiers.tier_counts(scored(spark, sf_dir)), "share_pct")


# Audit


@query
def result_group_column(spark, sf_dir):
    found = scored(spark, sf_dir)
    group = columns.result_group_column(found)
    return found.agg(
        F.lit(group).alias("group_column"), F.count_distinct(columns.col(group)).alias("groups")
    )


@query
def row_priority(spark, sf_dir):
    found = audit.prioritize(scored_events(spark, sf_dir)).rows
    return rounded(found.select("event_id", "priority_score"), "priority_score")


def _rounded_priorities(df):
    return rounded(df, "priority_score", "avg_probability", "max_severity")


@query
def group_priority(spark, sf_dir):
    return _rounded_priorities(audit.group_priority(scored(spark, sf_dir), "user_id"))


@query
def group_priority_by_severity(spark, sf_dir):
    return _rounded_priorities(audit.group_priority(scored(spark, sf_dir), "user_id", False))


@query
def group_priority_fallback(spark, sf_dir):
    bare = scored(spark, sf_dir).select("user_id", "anomaly")
    return _rounded_priorities(audit.group_priority(bare, "user_id"))


@query
def top_groups(spark, sf_dir):
    priorities = audit.group_priority(scored(spark, sf_dir), "user_id")
    return _rounded_priorities(audit.top_groups(priorities, "user_id", 20))


def _audited(spark, sf_dir):
    found = scored(spark, sf_dir)
    return found, audit.prioritize(found, 20)


@query
def mark_recommended(spark, sf_dir):
    marked = _audited(spark, sf_dir)[1].rows
    return rounded(
        marked.select(*KEY, "anomaly", "risk_tier", "priority_score", "recommended_for_audit"),
        "priority_score",
    )


@query
def audit_stats(spark, sf_dir):
    return audit.audit_stats(*_audited(spark, sf_dir))


@query
def audit_volume_plan(spark, sf_dir):
    return audit.audit_volume_plan(scored(spark, sf_dir))


# Audit funnel


def _funnel(spark, sf_dir, variant):
    return funnel.audit_funnel(
        scored(spark, sf_dir), FEATURES, "event_date", funnel.Settings(variant)
    )


_FUNNEL_COLUMNS = [*KEY, "anomaly", "risk_tier", "critical_day_count", "anomalous_metric_count"]


@query
def funnel_simple(spark, sf_dir):
    found = funnel.funnel_simple(scored_events(spark, sf_dir), 0.95)
    return found.select("event_id", "anomaly", "simple_priority")


@query
def funnel_frequency(spark, sf_dir):
    return funnel.funnel_frequency(scored(spark, sf_dir), "user_id", 7)


@query
def funnel_severity(spark, sf_dir):
    return funnel.funnel_severity(_funnel(spark, sf_dir, "A"))


@query
def funnel_severity_b(spark, sf_dir):
    return funnel.funnel_severity(_funnel(spark, sf_dir, "B"))


@query
def metric_zscores(spark, sf_dir):
    found = funnel.metric_zscores(user_day(spark, sf_dir), FEATURES)
    names = [f"{c}_zscore" for c in FEATURES]
    return rounded(found, *names).select(*KEY, *names)


@query
def funnel_multi_metric(spark, sf_dir):
    return funnel.funnel_multi_metric(scored(spark, sf_dir), "user_id", FEATURES, 2)


@query
def funnel_final(spark, sf_dir):
    return funnel.funnel_final(_funnel(spark, sf_dir, "A")).select(*_FUNNEL_COLUMNS)


@query
def funnel_final_b(spark, sf_dir):
    return funnel.funnel_final(_funnel(spark, sf_dir, "B")).select(*_FUNNEL_COLUMNS)


@query
def audit_tier(spark, sf_dir):
    return _funnel(spark, sf_dir, "A").rows.select(*_FUNNEL_COLUMNS, "audit_tier")


@query
def audit_tier_b(spark, sf_dir):
    return _funnel(spark, sf_dir, "B").rows.select(*_FUNNEL_COLUMNS, "audit_tier")


@query
def tier_group_counts(spark, sf_dir):
    return funnel.tier_group_counts(_funnel(spark, sf_dir, "A"))


@query
def tier_group_counts_b(spark, sf_dir):
    return funnel.tier_group_counts(_funnel(spark, sf_dir, "B"))


@query
def funnel_stages(spark, sf_dir):
    return funnel.funnel_stages(_funnel(spark, sf_dir, "A"))


@query
def funnel_stages_b(spark, sf_dir):
    return funnel.funnel_stages(_funnel(spark, sf_dir, "B"))


# Insights


@query
def summary(spark, sf_dir):
    found = insights.summary(scored(spark, sf_dir), "Z-Score", "3.0σ (standard deviations)")
    return rounded(found, "anomaly_rate")


@query
def category_rates(spark, sf_dir):
    return rounded(insights.category_rates(scored(spark, sf_dir), CATEGORIES), "anomaly_rate")


_CONTRAST = ["anomaly_mean", "normal_mean", "anomaly_std", "difference"]


@query
def feature_contrast(spark, sf_dir):
    return rounded(insights.feature_contrast(scored(spark, sf_dir), FEATURES), *_CONTRAST)


@query
def top_anomalies(spark, sf_dir):
    found = insights.top_anomalies(scored(spark, sf_dir), KEY)
    return rounded(found, "anomaly_score").select(*KEY, *FEATURES, "anomaly_score", "risk_tier")


@query
def verdict(spark, sf_dir):
    return rounded(insights.verdict(scored(spark, sf_dir)), "anomaly_rate")


@query
def verdict_expected(spark, sf_dir):
    found = insights.verdict(scored(spark, sf_dir), 0.02)
    return rounded(found, "anomaly_rate", "difference_pct")


@query
def primary_feature(spark, sf_dir):
    return rounded(insights.primary_feature(scored(spark, sf_dir), FEATURES), *_CONTRAST, "ratio")


@query
def hotspot(spark, sf_dir):
    found = insights.hotspot(scored(spark, sf_dir), CATEGORIES)
    return rounded(found, "anomaly_rate", "overall_rate", "ratio")


@query
def feature_ranking(spark, sf_dir):
    return rounded(insights.feature_ranking(scored(spark, sf_dir), FEATURES), *_CONTRAST)


@query
def extreme_count(spark, sf_dir):
    return rounded(insights.extreme_count(scored(spark, sf_dir)), "score_cut")


@query
def alert_threshold(spark, sf_dir):
    return rounded(insights.alert_threshold(scored(spark, sf_dir)), "anomaly_rate", "alert_rate")


@query
def review_sample(spark, sf_dir):
    found = insights.review_sample(scored(spark, sf_dir), 20, KEY)
    return found.select(*KEY, *FEATURES, "anomaly", "risk_tier")


# Chart series and views


@query
def class_counts(spark, sf_dir):
    return series.class_counts(scored(spark, sf_dir))


@query
def score_histogram(spark, sf_dir):
    return rounded(series.score_histogram(scored(spark, sf_dir)), "bin_start", "bin_end")


@query
def probability_histogram(spark, sf_dir):
    found = series.probability_histogram(scored(spark, sf_dir))
    return rounded(found, "bin_start", "bin_end")


@query
def daily_series(spark, sf_dir):
    return rounded(series.daily_series(scored(spark, sf_dir), "event_date"), "anomaly_rate")


@query
def scatter_sample(spark, sf_dir):
    return series.scatter_sample(scored(spark, sf_dir), FEATURES, 10_000, KEY)


@query
def category_bars(spark, sf_dir):
    return rounded(series.category_bars(scored(spark, sf_dir), CATEGORIES), "anomaly_rate")


@query
def box_summary(spark, sf_dir):
    found = series.box_summary(scored(spark, sf_dir), FEATURES)
    return rounded(found, "q1", "median", "q3")


@query
def filter_results(spark, sf_dir):
    marked = _audited(spark, sf_dir)[1].rows
    found = views.filter_results(marked, probability=(95.0, 100.0))
    return found.select(*KEY, "anomaly_probability", "risk_tier", "recommended_for_audit")


@query
def order_results(spark, sf_dir):
    marked = _audited(spark, sf_dir)[1].rows
    found = views.order_results(views.filter_results(marked, recommended_only=False))
    return rounded(found, "priority_score").select(*KEY, "priority_score", "anomaly_probability")


# Streams


def saved_model(spark, df, method, features, **params):
    """A model as tomorrow's job finds it: fitted, written and read back."""
    path = new_path(spark, "model")
    models.fit_model(df, method, features, **params).save(spark, path)
    return models.load_model(spark, path)


def arriving(spark, sf_dir, folder, parts=3):
    """Write the events into a folder in the order of their time; yields after each part of it.

    Gives the stream its input only: ranges of equal length of the time they cover.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(micros).alias("first"), F.max(micros).alias("last")).first()
    share = F.try_divide(micros - F.lit(ends["first"]), F.lit(ends["last"]) - F.lit(ends["first"]))
    number = F.coalesce(F.least(F.floor(share * parts), F.lit(parts - 1)), F.lit(0))
    for i in range(parts):
        events.where(number == i).write.mode("append").parquet(folder)
        yield events


def event_model(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return saved_model(spark, events, "zscore", ["value"])


@query
def stream_score(spark, sf_dir):
    model, folder, out = event_model(spark, sf_dir), new_path(spark, "events"), new_path(spark, "scored")
    log = new_path(spark, "log")
    for events in arriving(spark, sf_dir, folder):
        stream = sinks.read_files(spark, folder, events.schema)
        sinks.append_to(detection.stream_score(stream, model), out, log).awaitTermination()
    scores = ["anomaly_score", "zscore_value", "max_zscore"]
    return rounded(files.scan_parquet(spark, out).drop("ts"), *scores)


@query
def stream_daily_rate(spark, sf_dir):
    model, folder, log = event_model(spark, sf_dir), new_path(spark, "events"), new_path(spark, "log")
    rates = sinks.BatchTable(new_path(spark, "rates"))
    for events in arriving(spark, sf_dir, folder):
        scored = detection.stream_score(sinks.read_files(spark, folder, events.schema), model)
        daily = detection.stream_daily_rate(scored, "ts")
        rates.start(daily, log, "update").awaitTermination()
    return rounded(series.fill_days(rates.latest(spark, daily.schema, ["day"])), "anomaly_rate")


@query
def stream_alert(spark, sf_dir):
    model, folder, log = event_model(spark, sf_dir), new_path(spark, "events"), new_path(spark, "log")
    history = model.score(table(spark, sf_dir, "events").select("event_id", "value"))
    baseline = insights.alert_threshold(history).first()["anomaly_rate"]
    sink = sinks.BatchTable(new_path(spark, "alerts"))
    for events in arriving(spark, sf_dir, folder):
        scored = detection.stream_score(sinks.read_files(spark, folder, events.schema), model)
        alerts = detection.stream_alert(scored, "ts", baseline)
        sink.start(alerts, log).awaitTermination()
    found = sink.read(spark, alerts.schema).drop(sinks.BATCH)
    return rounded(found, "anomaly_rate", "baseline_rate", "alert_rate", "ratio")


# Density


@query
def dbscan(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    found = density.dbscan(customers, ["c_acctbal", "c_nationkey"], eps=0.1, min_rows=4, key=["c_custkey"])
    return rounded(
        found.select("c_custkey", "cluster", "core", "anomaly", "anomaly_score", "anomaly_probability", "risk_tier"),
        "anomaly_score",
    )


# Many files


def event_files(spark, sf_dir):
    """The events as files in one folder for each type, read back with the folder they came from."""
    path = new_path(spark, "batches")
    events = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    events.withColumnRenamed("event_type", "batch").write.partitionBy("batch").parquet(path)
    rows = files.scan_batch(spark, f"{path}/*/*.parquet", unit="folder")
    return rows.withColumn("source_file", F.regexp_extract("source_file", "([^=/]*)$", 1))


@query
def batch_detect(spark, sf_dir):
    return rounded(batches.batch_detect(event_files(spark, sf_dir), ["value"]), "anomaly_score")


@query
def batch_detect_iqr(spark, sf_dir):
    return rounded(batches.batch_detect(event_files(spark, sf_dir), ["value"], "iqr"), "anomaly_score")


@query
def batch_summary(spark, sf_dir):
    found = batches.batch_summary(batches.batch_detect(event_files(spark, sf_dir), ["value"]))
    return rounded(found, "highest_score", "anomaly_rate")


# Rules and registry, once more where SQL can follow


@query
def rollup_metric_rule_avg(spark, sf_dir):
    """Names that ask for an average, and one that asks for both and is summed."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("l_shipdate"), F.col("l_tax").alias("tax_rate"),
        F.col("l_discount").alias("discount_pct"), F.col("l_extendedprice").alias("avg_price"),
        F.col("l_linenumber").alias("line"),
    )
    daily = rollup.group_date_rollup(lines, "l_suppkey", "l_shipdate", ordered=False)
    rules = rollup.metric_rules(lines, "l_suppkey", "l_shipdate")
    named = ",".join(f"{c}:{r}" for c, r in sorted(rules.items()))
    return rounded(daily, "tax_rate", "discount_pct", "avg_price").withColumn("rules", F.lit(named))


@query
def detector_registry_exact(spark, sf_dir):
    """The registry's detectors without random parts."""
    days = user_day(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    found = None
    for method, df, features in (
        ("zscore", days, FEATURES), ("iqr", days, FEATURES), ("lof", customers, ["c_nationkey", "c_acctbal"]),
    ):
        flagged = registry.detect(df, method, features).agg(
            F.lit(method).alias("method"),
            F.lit(registry.DETECTORS[method].kind).alias("kind"),
            F.count(F.lit(1)).alias("rows"),
            F.sum("anomaly").cast("bigint").alias("anomalies"),
        )
        found = flagged if found is None else found.unionByName(flagged)
    return found


# Profiles of files


@query
def profile_sketches(spark, sf_dir):
    """Sketches by file, merged, and whether each estimate is within 5 % of the count."""
    path, store = new_path(spark, "lineitem"), new_path(spark, "sketches")
    lines = table(spark, sf_dir, "lineitem")
    # A file for each part of the scan, at least four: no task writes more than such a part.
    lines.repartition(max(4, lines.rdd.getNumPartitions())).write.parquet(path)
    merged = sketches.merged_profile(sketches.sketch_new_files(spark, f"{path}/*.parquet", store))
    counted = profiling.column_profile(lines).select("column_name", F.col("distinct").alias("counted"))
    close = F.abs(F.col("distinct") - F.col("counted")) <= F.col("counted") * 0.05
    joined = merged.join(counted, "column_name")
    return rounded(
        joined.select(
            "position", "column_name", "type", "role", "total", "nulls", "null_pct",
            F.col("counted").alias("distinct"), close.alias("estimate_is_close"),
        ),
        "null_pct",
    )
