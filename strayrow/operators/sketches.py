"""Column profiles from sketches that are kept for each file and merged later.

One scan makes, for every file, the counts of each column and a HyperLogLog sketch of its values, all
columns at once and combined on the map side. Profiles of any set of files are merged from these
rows, which do not grow with the files' sizes, so new files cost one scan of themselves. Distinct
counts are estimates, about 1.6 % off at the usual precision; ``exact`` asks for a count of some
columns, in a pass over those alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.functions.columns import col, role_of
from strayrow.operators.profiling import _countable, column_profile
from strayrow.sources.files import scan_batch

PRECISION = 12
SCHEMA = (
    "source_file string, position int, column_name string, type string, role string, total bigint, "
    "nulls bigint, sketch binary"
)


def _hashable(field: T.StructField) -> Column:
    """What a sketch takes: whole numbers, texts and bytes as they are, anything else as text."""
    if isinstance(field.dataType, T.IntegralType):
        return col(field.name).cast("bigint")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return (col(field.name) + F.lit(0.0)).cast("string")  # the two zeros are one value
    return _countable(field).cast("string")


def sketch_columns(df: DataFrame, by: str | None = None, precision: int = PRECISION) -> DataFrame:
    """A row for each column of ``df``, or of each group ``by``, with counts and a sketch."""
    fields = [f for f in df.schema.fields if f.name != by]
    group = F.lit(None).cast("string") if by is None else col(by).cast("string")
    stats = df.groupBy(group.alias("source_file")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)],
        *[F.hll_sketch_agg(_hashable(f), precision).alias(f"s{i}") for i, f in enumerate(fields)],
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(role_of(f.dataType)).alias("role"),
                F.col("total"),
                (F.col("total") - F.col(f"c{i}")).alias("nulls"),
                F.col(f"s{i}").alias("sketch"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return stats.select("source_file", F.inline(per_column))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """The profile of all rows that the sketches stand for, one row per column.

    How a sketch came about shows in its estimate, unless it was merged with another full one; so it
    is merged with itself, and the result depends on the values alone, not on how they were split.
    """
    merged = sketches.groupBy("position", "column_name", "type", "role").agg(
        F.sum("total").alias("total"),
        F.sum("nulls").alias("nulls"),
        F.hll_union_agg("sketch", True).alias("sketch"),
    )
    return merged.select(
        "position", "column_name", "type", "role", "total",
        F.hll_sketch_estimate(F.hll_union("sketch", "sketch")).alias("distinct"),
        "nulls",
        F.coalesce(F.try_divide("nulls", "total") * 100, F.lit(0.0)).alias("null_pct"),
    ).orderBy("position")


def sketched_profile(df: DataFrame, exact: list[str] | None = None, precision: int = PRECISION) -> DataFrame:
    """``column_profile`` in one scan; the columns ``exact`` are counted instead of estimated."""
    profile = merged_profile(sketch_columns(df, precision=precision))
    if not exact:
        return profile
    counted = column_profile(df.select(*map(col, exact))).select(
        "column_name", F.col("distinct").alias("counted")
    )
    joined = profile.join(F.broadcast(counted), "column_name", "left")
    return joined.withColumn("distinct", F.coalesce("counted", "distinct")).select(profile.columns).orderBy("position")


def sketch_new_files(spark: SparkSession, path: str, store: str, kind: str | None = None, **options) -> DataFrame:
    """Add the sketches of files that the table ``store`` does not have yet; returns all of them.

    Files are known by their paths: one that changes in place must be dropped from the store first.
    """
    rows = scan_batch(spark, path, kind, **options)
    kept = known_sketches(spark, store)
    if kept is not None:
        seen = {_plain(r[0]) for r in kept.select("source_file").distinct().collect()}  # a row a file
        new = [name for name in rows.inputFiles() if _plain(name) not in seen]
        if not new:
            return kept
        # A filter on the path leaves the other files out of the scan. Both spellings are in use.
        rows = rows.where(F.col("source_file").isin([*new, *map(_plain, new)]))
    sketch_columns(rows, "source_file").write.mode("append").parquet(store)
    return known_sketches(spark, store)


def _plain(name: str) -> str:
    return name.replace("file:///", "file:/")


def known_sketches(spark: SparkSession, store: str) -> DataFrame | None:
    """The sketches in ``store``, or None if there is no such table."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(SCHEMA).parquet(store)
