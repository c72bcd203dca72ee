import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from strayrow.functions.materialize import new_path
from strayrow.operators.profiling import column_profile
from strayrow.operators.sketches import known_sketches, merged_profile, sketch_columns, sketch_new_files, sketched_profile
from strayrow.sources.files import scan_batch


@pytest.fixture(scope="module")
def rows(spark):
    path = new_path(spark, "rows")
    spark.range(20_000).select(
        "id", (F.col("id") % 7).cast("tinyint").alias("few"), F.when(F.col("id") % 10 > 0, F.col("id") / 3).alias("a.b"),
        F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zero"), F.concat(F.lit("n"), F.col("id") % 3_000).alias("name"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("day"),
        F.create_map(F.lit("k"), F.col("id") % 50).alias("m"), F.array("id").alias("list"), F.lit(None).cast("string").alias("none"),
        (F.col("id") % 2 == 0).alias("even"), F.lit(1.5).cast("decimal(5,2)").alias("price"),
    ).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def test_counts_are_exact_and_distincts_close(rows):
    exact, found = as_rows(column_profile(rows)), as_rows(sketched_profile(rows))
    assert [r[:5] + r[6:] for r in found] == [r[:5] + r[6:] for r in exact]
    for mine, true in zip(found, exact):
        assert abs(mine[5] - true[5]) <= 0.05 * true[5]
        if true[5] <= 7:
            assert mine[5] == true[5]


def test_asked_columns_are_counted(rows):
    exact = {r["column_name"]: r["distinct"] for r in column_profile(rows).collect()}
    found = {r["column_name"]: r["distinct"] for r in sketched_profile(rows, exact=["id", "a.b"]).collect()}
    assert found["id"] == exact["id"] and found["a.b"] == exact["a.b"]


def test_merged_halves_equal_the_whole(rows):
    whole = as_rows(merged_profile(sketch_columns(rows)))
    parts = sketch_columns(rows.withColumn("part", F.col("id") % 5), by="part")
    assert parts.count() == 5 * len(rows.columns)
    assert as_rows(merged_profile(parts)) == whole
    assert as_rows(merged_profile(sketch_columns(rows.repartition(13)))) == whole


def test_two_hundred_columns_are_one_scan(spark):
    wide = spark.range(500).select("id", *[(F.col("id") * i % 97).alias(f"c{i}") for i in range(200)])
    path = new_path(spark, "wide")
    wide.write.parquet(path)
    profile = sketched_profile(spark.read.parquet(path))
    text = io.StringIO()
    with redirect_stdout(text):
        profile.explain("formatted")
    assert text.getvalue().count("ReadSchema") == 1 and "Expand" not in text.getvalue()
    assert profile.count() == 201


def test_new_files_are_added_to_the_store(spark, rows):
    path, store = new_path(spark, "files"), new_path(spark, "store")
    assert known_sketches(spark, store) is None
    rows.where("id < 5000").repartition(2).write.parquet(path)
    assert sketch_new_files(spark, f"{path}/*.parquet", store).select("source_file").distinct().count() == 2
    rows.where("id >= 5000").repartition(3).write.mode("append").parquet(path)
    kept = sketch_new_files(spark, f"{path}/*.parquet", store)
    assert kept.count() == 5 * len(rows.columns)
    assert kept.groupBy("source_file", "position").count().where("count > 1").isEmpty()
    assert as_rows(merged_profile(kept)) == as_rows(sketched_profile(rows))
    again = sketch_new_files(spark, f"{path}/*.parquet", store)
    assert again.count() == kept.count()


def test_scan_of_known_files_is_left_out(spark, rows):
    path = new_path(spark, "files")
    rows.repartition(4).write.parquet(path)
    read = scan_batch(spark, f"{path}/*.parquet")
    one = read.select("source_file").first()[0]
    got = read.where(F.col("source_file") == one).select("id")
    assert 0 < got.count() < rows.count()
    assert got.rdd.getNumPartitions() < read.select("id").rdd.getNumPartitions()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a long, b string")
    assert as_rows(sketched_profile(empty)) == []


def test_profiled_files_are_as_many_as_the_parts_of_the_scan(spark, tmp_path, monkeypatch):
    from strayrow.operators import sketches
    from strayrow.plans.queries import QUERIES

    lines = spark.range(900).select("id", (F.col("id") % 5).alias("few"))
    lines.repartition(9).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []

    def counting(spark, path, store):
        seen.append(len(spark.read.parquet(path).inputFiles()))
        return sketch_new_files(spark, path, store)

    monkeypatch.setattr(sketches, "sketch_new_files", counting)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, files in (("1k", 9), (before, 4)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            parts = max(4, spark.read.parquet(str(tmp_path / "lineitem.parquet")).rdd.getNumPartitions())
            profile = QUERIES["profile_sketches"](spark, str(tmp_path)).orderBy("position").collect()
            assert parts >= files and seen.pop() == parts
            assert [(r["total"], r["distinct"], r["estimate_is_close"]) for r in profile] == [(900, 900, True), (900, 5, True)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
