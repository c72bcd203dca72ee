"""Column names, column roles and the name rules that hang on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name fragments that decide how a column is treated.
SUM_WORDS = ("sales", "order", "count", "volume", "quantity", "contact", "call", "inbound", "outbound")
AVG_WORDS = ("time", "rate", "score", "avg", "average", "pct", "percent", "ratio", "nps", "aht", "asa")
GROUP_WORDS = (
    "agent", "rep", "representative", "employee", "emp_", "user", "department",
    "team", "category", "location", "channel", "region", "type",
)
RESULT_GROUP_WORDS = ("agent", "rep", "employee", "user")

ROLES = ("numeric", "categorical", "temporal", "other")


def col(name: str) -> Column:
    """Reference a column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def role_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "other"


def columns_with_role(df: DataFrame, role: str) -> list[str]:
    return [f.name for f in df.schema.fields if role_of(f.dataType) == role]


def default_features(df: DataFrame, limit: int = 3) -> list[str]:
    """The first three numeric columns, or all of them if there are fewer."""
    return columns_with_role(df, "numeric")[:limit]


def _has_word(name: str, words: Iterable[str]) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in words)


def detect_group_date(df: DataFrame) -> tuple[str | None, str | None]:
    """First column named like a group, first temporal column named like a plain date."""
    group = next((c for c in df.columns if _has_word(c, GROUP_WORDS)), None)
    date = next(
        (
            c
            for c in columns_with_role(df, "temporal")
            if "date" in c.lower() and not _has_word(c, ("week", "month"))
        ),
        None,
    )
    return group, date


def result_group_column(df: DataFrame) -> str | None:
    """The column audit ranking groups by: a narrower word list than at load time."""
    return next((c for c in df.columns if _has_word(c, RESULT_GROUP_WORDS)), None)


def rollup_rule(name: str, dtype: T.DataType) -> str:
    """How a column is combined per group and date: ``sum``, ``avg`` or ``first``."""
    if role_of(dtype) != "numeric":
        return "first"
    if _has_word(name, SUM_WORDS):
        return "sum"
    return "avg" if _has_word(name, AVG_WORDS) else "sum"


def feature(name: str) -> Column:
    """A feature as double in which NaN and infinity are missing values."""
    value = col(name).cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite(value: Column) -> Column:
    """Null instead of NaN, so that comparisons behave as they do for missing values."""
    return F.when(~F.isnan(value), value)
