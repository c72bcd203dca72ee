import datetime
import os

import pytest
from pyspark.sql import functions as F

from strayrow.functions.materialize import new_path
from strayrow.operators import registry, series
from strayrow.operators.models import fit_model, load_model
from strayrow.operators.zscore import zscore_detect
from strayrow.sources.sample import sample_dataset
from strayrow.streaming import detection, sinks

FEATURES = ["Feature_1", "Feature_2"]


@pytest.fixture(scope="module")
def sample(spark):
    path = new_path(spark, "sample")
    rows = sample_dataset(spark, 1500).select("id", "Category", "Date", *FEATURES)
    odd = F.when(F.col("id") % 97 == 0, F.lit(None)).when(F.col("id") % 89 == 0, float("nan"))
    rows.withColumn("Feature_1", odd.otherwise(F.col("Feature_1"))).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    plain = lambda v: "nan" if v != v else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=str)


def saved(spark, model):
    path = new_path(spark, "model")
    model.save(spark, path)
    return load_model(spark, path)


MODELS = {
    "zscore": {"threshold": 2.5},
    "iqr": {},
    "isolation_forest": {"contamination": 0.05, "key": ["id"], "trees": 20},
    "one_class_svm": {"contamination": 0.05, "key": ["id"], "waves": 32, "steps": 3},
}


@pytest.mark.parametrize("method", MODELS)
def test_model_gives_what_the_detector_gives(spark, sample, method):
    detector = registry.DETECTORS[method].run
    model = saved(spark, fit_model(sample, method, FEATURES, **MODELS[method]))
    again, found = model.score(sample), detector(sample, FEATURES, **MODELS[method])
    assert again.dtypes == found.dtypes
    if method != "one_class_svm":
        assert rows_of(again) == rows_of(found)
        return
    # Two fits add up single-precision numbers in different orders.
    mine, theirs = (df.select("id", "anomaly_score").toPandas().sort_values("id") for df in (again, found))
    assert (mine["id"].to_numpy() == theirs["id"].to_numpy()).all()
    assert abs(mine["anomaly_score"].to_numpy() - theirs["anomaly_score"].to_numpy()).max() < 1e-3


@pytest.mark.parametrize("method", ["zscore", "iqr", "isolation_forest"])
def test_stream_equals_batch(spark, sample, method):
    model = saved(spark, fit_model(sample, method, FEATURES, **MODELS[method]))
    folder, out, log = (new_path(spark, n) for n in ("in", "out", "log"))
    sample.repartition(5).write.parquet(folder)
    stream = sinks.read_files(spark, folder, sample.schema, files_per_batch=2)
    query = sinks.append_to(detection.stream_score(stream, model), out, log)
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress}) >= 3
    assert rows_of(spark.read.parquet(out)) == rows_of(model.score(sample))


def test_scores_beyond_those_seen_get_the_last_probability(spark, sample):
    model = fit_model(sample, "zscore", FEATURES)
    new = spark.createDataFrame([(1e9, 1.0), (None, None), (float("inf"), None)], "Feature_1 double, Feature_2 double")
    got = {r["Feature_1"]: (r["anomaly"], r["anomaly_probability"], r["risk_tier"]) for r in model.score(new).collect()}
    assert got == {1e9: (1, 100.0, "CRITICAL"), None: (0, None, None), float("inf"): (0, None, None)}


def test_unknown_model_is_refused(sample):
    with pytest.raises(ValueError):
        fit_model(sample, "lof", FEATURES)


def test_model_is_not_overwritten(spark, sample):
    model, path = fit_model(sample, "iqr", FEATURES), new_path(spark, "model")
    model.save(spark, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        model.save(spark, path)


# Days

ROWS = "time timestamp_ntz, anomaly int, team string"


def at(day, hour=0, minute=0):
    return datetime.datetime(2024, 3, 1, hour, minute) + datetime.timedelta(days=day - 1)


class Feed:
    """A folder that files come to, and a query that is run after each."""

    def __init__(self, spark, build, mode):
        self.spark, self.build, self.mode = spark, build, mode
        self.folder, self.log = new_path(spark, "in"), new_path(spark, "log")
        self.table = sinks.BatchTable(new_path(spark, "table"))

    def add(self, *rows):
        self.spark.createDataFrame([(*r, None)[:3] if len(r) == 2 else r for r in rows], ROWS).coalesce(1).write.mode("append").parquet(self.folder)
        stream = self.build(sinks.read_files(self.spark, self.folder, self.spark.createDataFrame([], ROWS).schema))
        self.schema = stream.schema
        self.table.start(stream, self.log, self.mode).awaitTermination()

    def rows(self):
        return sorted(tuple(r) for r in self.table.read(self.spark, self.schema).drop(sinks.BATCH).collect())

    def latest(self, *key):
        return sorted(tuple(r) for r in self.table.latest(self.spark, self.schema, list(key)).collect())


def test_late_rows_count_within_the_delay_and_not_beyond(spark):
    feed = Feed(spark, lambda s: detection.stream_daily_rate(s, "time", delay="12 hours"), "append")
    feed.add((at(1, 3), 1), (at(1, 9), 0), (at(2, 11), 0))
    assert feed.rows() == []  # day 1 may still get rows
    feed.add((at(1, 23, 30), 1), (at(2, 13), 1), (None, 1))
    assert feed.rows() == [(at(1).date(), 2, 3, 200 / 3)]
    feed.add((at(1, 4), 1), (at(2, 2), 0), (at(4, 0), 0))  # the first is too late
    assert feed.rows() == [(at(1).date(), 2, 3, 200 / 3), (at(2).date(), 1, 3, 100 / 3)]


def test_updates_show_open_days(spark):
    feed = Feed(spark, lambda s: detection.stream_daily_rate(s, "time", by=["team"], delay="1 day"), "update")
    feed.add((at(1, 3), 1, "a"), (at(1, 9), 0, "b"))
    feed.add((at(1, 4), 0, "a"), (at(2, 9), 1, None))
    got = {(r[0].day, r[1]): r[2:] for r in feed.table.latest(spark, feed.schema, ["day", "team"]).collect()}
    assert got == {(1, "a"): (1, 2, 50.0), (1, "b"): (0, 1, 0.0), (2, None): (1, 1, 100.0)}


def test_batch_rates_equal_the_daily_series(spark, sample):
    scored = zscore_detect(sample, FEATURES, 2.0)
    days = detection.stream_daily_rate(scored, "Date").select("day", "anomalies", "total")
    assert rows_of(series.fill_days(days)) == rows_of(series.daily_series(scored, "Date"))


def test_days_are_those_of_the_session(spark):
    rows = [(at(1, 1), 0, None), (at(1, 23), 1, None), (at(2, 0), 1, None)]
    df = spark.createDataFrame(rows, ROWS)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "Asia/Tokyo", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = detection.stream_daily_rate(df, "time").select("day", "anomalies", "total")
            assert rows_of(got) == [(at(1).date(), 1, 2), (at(2).date(), 1, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_alerts_are_days_over_the_limit(spark):
    feed = Feed(spark, lambda s: detection.stream_alert(s, "time", baseline=20.0, delay="1 hour"), "append")
    feed.add((at(1, 3), 1), (at(1, 9), 0), (at(2, 11), 1), (at(2, 12), 0), (at(2, 13), 0), (at(2, 14), 0))
    feed.add((at(3, 1), 1), (at(4, 12), 0))
    assert feed.rows() == [
        (at(1).date(), 1, 2, 50.0, 20.0, 30.0, 2.5), (at(3).date(), 1, 1, 100.0, 20.0, 30.0, 5.0),
    ]


def test_replayed_batch_adds_nothing(spark):
    table = sinks.BatchTable(new_path(spark, "table"))
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    for batch in (0, 1, 1, 0):
        table.write(rows.where(F.col("id") == batch + 1), batch)
    assert rows_of(table.read(spark, rows.schema)) == [(1, "x", 0), (2, "y", 1)]


def test_batch_that_failed_after_its_write_counts_once(spark):
    folder, log = new_path(spark, "in"), new_path(spark, "log")
    spark.createDataFrame([(at(1, 3), 1, None), (at(1, 4), 0, None), (at(9), 0, None)], ROWS).write.parquet(folder)
    table = sinks.BatchTable(new_path(spark, "alerts"))
    stream = detection.stream_alert(
        sinks.read_files(spark, folder, spark.createDataFrame([], ROWS).schema), "time", 10.0
    )

    def fails(rows, batch):
        table.write(rows, batch)
        raise RuntimeError("lost after the write")

    query = stream.writeStream.option("checkpointLocation", log).foreachBatch(fails).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost after the write"):
        query.awaitTermination()
    table.start(stream, log).awaitTermination()
    got = table.read(spark, stream.schema).drop(sinks.BATCH)
    assert rows_of(got) == [(at(1).date(), 1, 2, 50.0, 10.0, 15.0, 5.0)]
    table.start(stream, log).awaitTermination()  # nothing new
    assert got.count() == 1


def test_empty_folder_gives_an_empty_table(spark):
    folder = new_path(spark, "in")
    spark.createDataFrame([], ROWS).write.parquet(folder)
    table = sinks.BatchTable(new_path(spark, "table"))
    stream = detection.stream_daily_rate(sinks.read_files(spark, folder, spark.createDataFrame([], ROWS).schema), "time")
    table.start(stream, new_path(spark, "log")).awaitTermination()
    assert not os.path.isdir(table.path) or table.read(spark, stream.schema).count() == 0
