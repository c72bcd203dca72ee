"""Shape, column statistics, roles, previews and sensitivity labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.functions.columns import ROLES, col, role_of

DISTINCTS_PER_PASS = 4


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns))
    )


def _countable(field: T.StructField) -> Column:
    # Maps cannot be grouped; their sorted entries can.
    if isinstance(field.dataType, T.MapType):
        return F.array_sort(F.map_entries(col(field.name)))
    return col(field.name)


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, role, total, distinct, nulls, null_pct.

    Each exact distinct count multiplies the rows of its pass, so four columns share one, which
    reads these columns only; ``approximate`` counts all columns in a single pass and shuffles
    sketches instead of values.
    """
    fields = df.schema.fields
    size = len(fields) if approximate else DISTINCTS_PER_PASS
    count_distinct = F.approx_count_distinct if approximate else F.count_distinct
    parts = []
    for start in range(0, len(fields), max(size, 1)):
        batch = list(enumerate(fields[start : start + size], start))
        stats = df.agg(
            F.count(F.lit(1)).alias("total"),
            *[count_distinct(_countable(f)).alias(f"d{i}") for i, f in batch],
            *[F.count(col(f.name)).alias(f"c{i}") for i, f in batch],
        )
        per_column = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("type"),
                    F.lit(role_of(f.dataType)).alias("role"),
                    F.col(f"d{i}").alias("distinct"),
                    (F.col("total") - F.col(f"c{i}")).alias("nulls"),
                )
                for i, f in batch
            ]
        )
        parts.append(stats.select("total", F.inline(per_column)))
    profile = parts[0]
    for part in parts[1:]:
        profile = profile.unionByName(part)
    return profile.select(
        "position",
        "column_name",
        "type",
        "role",
        "total",
        "distinct",
        "nulls",
        F.coalesce(F.try_divide("nulls", "total") * 100, F.lit(0.0)).alias("null_pct"),
    ).orderBy("position")


def column_roles(df: DataFrame) -> DataFrame:
    """Columns per role, and how many of their cells hold a value; all roles are kept."""
    members = {r: [f.name for f in df.schema.fields if role_of(f.dataType) == r] for r in ROLES}
    filled = {
        r: sum((F.count(col(c)) for c in names), F.lit(0).cast("bigint"))
        for r, names in members.items()
    }
    per_role = F.array(
        *[
            F.struct(
                F.lit(r).alias("role"),
                F.lit(len(members[r])).alias("column_count"),
                F.lit(",".join(members[r])).alias("column_names"),
                F.col(r).alias("filled_cells"),
            )
            for r in ROLES
        ]
    )
    return df.agg(*[filled[r].alias(r) for r in ROLES]).select(F.inline(per_role))


def preview(df: DataFrame, n: int = 1000, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows; ``order_by`` makes the choice repeatable."""
    if order_by:
        df = df.orderBy(*[col(c) for c in order_by])
    return df.limit(n)


def sensitivity_band(rate: Column) -> Column:
    """Label of an expected anomaly rate."""
    return (
        F.when(rate <= 0.01, "very strict")
        .when(rate <= 0.05, "strict")
        .when(rate <= 0.10, "balanced")
        .when(rate <= 0.20, "lenient")
        .when(rate.isNotNull(), "very lenient")
    )


def explain_sensitivity(rates: DataFrame, rate: str, rows: str) -> DataFrame:
    """Add the label and the expected number of anomalies of each rate."""
    return rates.withColumn("sensitivity", sensitivity_band(col(rate))).withColumn(
        "expected_anomalies", (col(rows) * col(rate)).cast("bigint")
    )
