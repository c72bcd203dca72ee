"""Roll a table up to one row per group and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.functions.columns import col, rollup_rule


def metric_rules(
    df: DataFrame, group: str, date: str, overrides: dict[str, str] | None = None
) -> dict[str, str]:
    """Aggregate per remaining column, chosen by its name unless overridden."""
    chosen = {
        f.name: rollup_rule(f.name, f.dataType)
        for f in df.schema.fields
        if f.name not in (group, date)
    }
    return chosen | (overrides or {})


def _first(field: T.StructField) -> Column:
    # Any value of the group is a legal choice; the smallest one does not depend on row order.
    if isinstance(field.dataType, T.MapType):
        return F.any_value(col(field.name), ignoreNulls=False)
    return F.min(col(field.name))


def group_date_rollup(
    df: DataFrame,
    group: str,
    date: str,
    overrides: dict[str, str] | None = None,
    grain: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Sum, average or one value per column, grouped by ``group`` and ``date``.

    ``grain="day"`` truncates timestamps first. Null keys form groups of their own.
    """
    if grain == "day":
        df = df.withColumn(date, F.to_date(col(date)))
    elif grain is not None:
        raise ValueError(f"unknown grain: {grain}")
    rules = metric_rules(df, group, date, overrides)
    fields = {f.name: f for f in df.schema.fields}
    builders = {"sum": F.sum, "avg": F.avg}
    aggregates = [
        (_first(fields[c]) if rule == "first" else builders[rule](col(c))).alias(c)
        for c, rule in rules.items()
    ]
    rolled = df.groupBy(col(group), col(date)).agg(*aggregates)
    return rolled.orderBy(col(group), col(date)) if ordered else rolled


def rollup_reduction(df: DataFrame, group: str, date: str) -> DataFrame:
    """Rows before and after, and the reduction in percent, from one pass over the keys."""
    per_key = df.groupBy(col(group), col(date)).agg(F.count(F.lit(1)).alias("rows"))
    sizes = per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("rolled_up_rows"),
    )
    return sizes.withColumn(
        "reduction_pct", (1 - F.try_divide("rolled_up_rows", "row_count")) * 100
    )
