"""Exact quantiles without a global sort and without a large buffer in one task.

Small columns use the built-in ``percentile``. Above ``small_rows`` a few column-pruned scans
narrow a value bracket around each wanted order statistic: a sketch proposes the next bracket,
an exact count accepts or rejects it, and only the few distinct values left in the bracket are
fetched in the end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 500_000
_MAX_DISTINCT = 20_000
_ACCURACY = 10_000
_MAX_PASSES = 12


def positions(probability: float, n: int) -> tuple[int, int, float]:
    """Lower index, upper index and weight of the upper one, for linear interpolation."""
    position = probability * (n - 1)
    lower = math.floor(position)
    return lower, math.ceil(position), position - lower


def interpolate(lower: float, upper: float, weight: float) -> float:
    if lower == upper:
        return lower
    return (1 - weight) * lower + weight * upper


@dataclass
class _Bracket:
    """All values of a column whose sorted index is ``first`` … ``last`` lie in [low, high]."""

    name: str
    first: int
    last: int
    low: float
    high: float
    below: int
    inside: int
    distinct: int
    found: tuple[float, float] | None = None


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, tuple[Column, list[float]]],
    small_rows: int = SMALL_ROWS,
) -> dict[str, list[float] | None]:
    """Linear-interpolation quantiles of several expressions, over their non-null values.

    ``wanted`` maps a result name to (expression, probabilities). A column without any
    value gives ``None``.
    """
    names = list(wanted)
    values = df.select(*[wanted[n][0].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    alias = {n: f"v{i}" for i, n in enumerate(names)}

    first = values.agg(
        *[
            expr
            for v in alias.values()
            for expr in (
                F.count(v).alias(f"{v}_n"),
                F.min(v).alias(f"{v}_min"),
                F.max(v).alias(f"{v}_max"),
                F.approx_count_distinct(v).alias(f"{v}_d"),
            )
        ]
    ).first()

    small = [n for n in names if 0 < first[f"{alias[n]}_n"] <= small_rows]
    out: dict[str, list[float] | None] = {n: None for n in names}
    if small:
        row = values.agg(
            *[
                F.percentile(alias[n], F.array(*[F.lit(float(p)) for p in wanted[n][1]])).alias(alias[n])
                for n in small
            ]
        ).first()
        out.update({n: list(row[alias[n]]) for n in small})

    large = [n for n in names if first[f"{alias[n]}_n"] > small_rows]
    if large:
        brackets = {}
        for n in large:
            v, count = alias[n], first[f"{alias[n]}_n"]
            for p in wanted[n][1]:
                lower, upper, _ = positions(p, count)
                brackets[n, p] = _Bracket(
                    v, lower, upper, first[f"{v}_min"], first[f"{v}_max"], 0, count, first[f"{v}_d"]
                )
        _narrow(values, list(brackets.values()))
        for n in large:
            count = first[f"{alias[n]}_n"]
            out[n] = [
                interpolate(*brackets[n, p].found, positions(p, count)[2]) for p in wanted[n][1]
            ]
    return out


def _inside(b: _Bracket) -> Column:
    return F.when(F.col(b.name).between(b.low, b.high), F.col(b.name))


def _narrow(values: DataFrame, brackets: list[_Bracket]) -> None:
    for _ in range(_MAX_PASSES):
        for b in brackets:
            if b.found is None and b.low == b.high:
                b.found = (b.low, b.low)
        todo = [b for b in brackets if b.found is None]
        ready = [b for b in todo if b.distinct <= _MAX_DISTINCT]
        if ready:
            _fetch(values, ready)
        wide = [b for b in todo if b.found is None]
        if not wide:
            return
        _tighten(values, wide)
    raise RuntimeError("quantile brackets did not converge")


def _tighten(values: DataFrame, brackets: list[_Bracket]) -> None:
    margin = 2.0 / _ACCURACY
    sketches = []
    for i, b in enumerate(brackets):
        at = [
            max(0.0, (b.first - b.below) / b.inside - margin),
            min(1.0, (b.last - b.below + 1) / b.inside + margin),
        ]
        sketches.append(F.percentile_approx(_inside(b), at, _ACCURACY).alias(f"s{i}"))
    proposal = values.agg(*sketches).first()

    checks = []
    for i, b in enumerate(brackets):
        low, high = proposal[f"s{i}"]
        x = F.col(b.name)
        checks += [
            F.count_if(x < low).alias(f"below{i}"),
            F.count_if(x <= high).alias(f"upto{i}"),
            F.count_if(x < b.low).alias(f"old_below{i}"),
            F.count_if(x <= b.high).alias(f"old_upto{i}"),
            F.approx_count_distinct(F.when(x.between(low, high), x)).alias(f"d{i}"),
        ]
    seen = values.agg(*checks).first()
    for i, b in enumerate(brackets):
        low, high = proposal[f"s{i}"]
        good_low = seen[f"below{i}"] <= b.first
        good_high = seen[f"upto{i}"] > b.last
        below = seen[f"below{i}"] if good_low else seen[f"old_below{i}"]
        upto = seen[f"upto{i}"] if good_high else seen[f"old_upto{i}"]
        if good_low:
            b.low = low
        if good_high:
            b.high = high
        b.below, b.inside = below, upto - below
        if good_low and good_high:
            b.distinct = seen[f"d{i}"]


def _fetch(values: DataFrame, brackets: list[_Bracket]) -> None:
    """Read the few distinct values of finished brackets; their number was checked before."""
    tagged = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(b.name).between(b.low, b.high),
                    F.struct(F.lit(i).alias("target"), F.col(b.name).alias("value")),
                )
                for i, b in enumerate(brackets)
            ]
        )
    )
    rows = (
        values.select(F.explode(tagged).alias("hit"))
        .groupBy("hit.target", "hit.value")
        .count()
        .collect()
    )
    for i, b in enumerate(brackets):
        seen, at = b.below, {}
        for value, count in sorted((r["value"], r["count"]) for r in rows if r["target"] == i):
            for index in (b.first, b.last):
                if seen <= index < seen + count:
                    at[index] = value
            seen += count
        b.found = (at[b.first], at[b.last])
