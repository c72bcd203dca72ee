"""Load, roll up, detect and rank in one call."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from strayrow.functions.columns import default_features, detect_group_date
from strayrow.functions.materialize import pin_table
from strayrow.operators.audit import Audit, prioritize
from strayrow.operators.registry import detect
from strayrow.operators.rollup import group_date_rollup


def roll_up_if_possible(df: DataFrame) -> DataFrame:
    """One row per group and date where both columns are found, else the table as it is."""
    group, date = detect_group_date(df)
    if group is None or date is None:
        return df
    return pin_table(group_date_rollup(df, group, date, ordered=False), "rollup")


def analyse(
    df: DataFrame,
    method: str = "zscore",
    features: list[str] | None = None,
    target: int = 50,
    prioritize_consistency: bool = True,
    **params: Any,
) -> Audit:
    """Score a table and rank its groups for audit."""
    scored = detect(df, method, features or default_features(df), **params)
    return prioritize(scored, target, prioritize_consistency)
