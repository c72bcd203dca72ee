import pytest
from pyspark.sql import functions as F

from strayrow.functions.materialize import new_path
from strayrow.sources import files
from strayrow.sources.sample import sample_dataset


@pytest.mark.parametrize(
    "name, want",
    [
        ("a.CSV", "csv"), ("b/c.Parquet", "parquet"), ("x.tar.txt", "txt"), ("s.xls", "xls"),
        ("s.XLSX", "xlsx"), ("s.json", None), ("none", None), (".csv", None), ("d.csv/x", None),
    ],
)
def test_format_by_suffix(spark, name, want):
    assert files.format_by_suffix(name) == want
    assert spark.range(1).select(files.format_of(F.lit(name))).first()[0] == want


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "|", "\t"])
@pytest.mark.parametrize("header", [True, False])
def test_delimiter_and_header_are_detected(spark, tmp_path, sep, header):
    lines = ["name", "n", "x"], ["a", "1", "1.5"], ["b", "2", "2.5"]
    text = "\n".join(sep.join(row) for row in (lines if header else lines[1:]))
    df = files.scan_csv(spark, write(tmp_path, "t.txt", text))
    assert [t for _, t in df.dtypes] == ["string", "int", "double"]
    assert df.columns == (lines[0] if header else ["_c0", "_c1", "_c2"])
    assert df.count() == 2


def test_quotes_and_types_from_all_rows(spark, tmp_path):
    text = 'name,n\n"a, b",1\n"say ""hi""",2\n' + "".join(f"r{i},{i}\n" for i in range(50)) + "last,x\n"
    df = files.scan_csv(spark, write(tmp_path, "q.csv", text))
    assert df.dtypes == [("name", "string"), ("n", "string")]
    assert {r["name"] for r in df.limit(2).collect()} == {"a, b", 'say "hi"'}


def test_bad_rows_are_dropped_and_counted_after_writing(spark, tmp_path):
    path = write(tmp_path, "messy.csv", "a,b\n1,2\nx,3\n\n4,5\n6,seven\n")
    done = files.convert_to_parquet(spark, path, new_path(spark, "messy"), schema="a int, b int")
    assert (done.row_count, done.column_count) == (2, 2)
    assert sorted(map(tuple, files.load(spark, path, schema="a int, b int").collect())) == [(1, 2), (4, 5)]


def test_parquet_round_trip_and_unsupported(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä"), (2, None)], "x int, s string")
    path = new_path(spark, "t") + ".parquet"
    files.write_parquet(df, path)
    assert sorted(files.load(spark, path).collect()) == sorted(df.collect())
    for name in ("a.xlsx", "a.json"):
        with pytest.raises(ValueError, match="unsupported"):
            files.load(spark, name)


@pytest.mark.parametrize("rows", [0, 19, 1000, 10_000])
def test_sample_plants_exactly_five_percent(spark, rows):
    df = sample_dataset(spark, rows)
    assert df.count() == rows and df.where("planted").count() == int(rows * 0.05)


def test_sample_shape(spark):
    df = sample_dataset(spark)
    row = df.where("not planted").agg(
        F.avg("Feature_1"), F.stddev("Feature_1"), F.avg("Feature_2"), F.stddev("Feature_2"),
        F.avg("Feature_3"), F.stddev("Feature_3"),
    ).first()
    assert tuple(row) == pytest.approx((100, 15, 200, 30, 50, 10), rel=0.03)
    assert {r[0] for r in df.select("Category").distinct().collect()} == set("ABCDE")
    assert df.select("Department").distinct().count() == 4
    planted = df.where("planted").agg(F.min("Feature_1"), F.max("Feature_2")).first()
    assert planted[0] > 90 and planted[1] < 170
