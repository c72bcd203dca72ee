"""Detection over many files or other groups of rows at once, each judged by its own rows.

All groups are fitted together: one pass for the moments of every group, or one for the counts of
all their values, and one more for the ranks of the scores, however many files there are. Per-group
numbers are attached by broadcast where they are few and by a join that is safe for hot groups
elsewhere, so one file may hold most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col, feature, finite
from strayrow.functions.grouped import grouped_distribution, grouped_percent_rank, grouped_quantiles
from strayrow.functions.materialize import Scratch
from strayrow.functions.skew import attach
from strayrow.functions.tiers import TIER_ORDER, risk_tier
from strayrow.operators.insights import _rate
from strayrow.operators.iqr import FENCE_WIDTH

BY = "source_file"


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def group_moments(df: DataFrame, features: list[str], by: str = BY) -> DataFrame:
    """Rows, and mean and sample deviation of each feature (``m0``, ``s0`` …), of every group."""
    stats = [
        e
        for i, c in enumerate(features)
        for e in (F.avg(feature(c)).alias(f"m{i}"), F.stddev_samp(feature(c)).alias(f"s{i}"))
    ]
    return df.groupBy(col(by)).agg(F.count(F.lit(1)).alias("group_rows"), *stats)


def group_fences(df: DataFrame, features: list[str], by: str, scratch: Scratch) -> DataFrame:
    """Rows, and fences of each feature (``l0``, ``h0`` …), of every group; null without values.

    Rows without a group are left out.
    """
    values = F.posexplode(F.array(*[feature(c) for c in features])).alias("number", "value")
    long = df.select(col(by), values)
    distribution = grouped_distribution(long, [by, "number"], F.col("value"), scratch, "values")
    quartiles = grouped_quantiles(distribution, [by, "number"], {"q1": 0.25, "q3": 0.75})
    reach = F.lit(FENCE_WIDTH) * (F.col("q3") - F.col("q1"))
    fences = quartiles.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    sides = [
        F.max(F.when(F.col("number") == i, F.col(side))).alias(f"{short}{i}")
        for i in range(len(features))
        for short, side in (("l", "low"), ("h", "high"))
    ]
    return fences.groupBy(col(by)).agg(F.max("n").alias("group_rows"), *sides)


def batch_detect(
    df: DataFrame,
    features: list[str],
    method: str = "zscore",
    by: str = BY,
    threshold: float = 3.0,
) -> DataFrame:
    """Flag, score, probability and tier of each row among the rows of its group.

    The same as the detector ``zscore`` or ``iqr`` run on each group alone, except that a feature
    without values in a group is no error there: it flags nothing, and for ``iqr`` the group's rows
    have no score. Rows without a group are a group.
    """
    scratch = Scratch(df.sparkSession, "batches")
    numbers = range(len(features))
    # A missing group meets itself: joins compare a text that says so.
    key = F.coalesce(F.concat(F.lit("="), col(by).cast("string")), F.lit(""))
    keyed = df.withColumn("_group", key)
    slim = keyed.select("_group", *[col(c) for c in features])
    if method == "zscore":
        fit, names = group_moments(slim, features, "_group"), [f"{k}{i}" for i in numbers for k in "ms"]
        spread = [F.when(F.col(f"_s{i}") != 0, F.col(f"_s{i}")) for i in numbers]
        each = [finite(F.abs((feature(c) - F.col(f"_m{i}")) / spread[i])) for i, c in enumerate(features)]
        score = _greatest(each)
        flag = score > F.lit(float(threshold))
    elif method == "iqr":
        fit, names = group_fences(slim, features, "_group", scratch), [f"{k}{i}" for i in numbers for k in "lh"]
        low, high = ([F.col(f"_{k}{i}") for i in numbers] for k in "lh")
        values = [feature(c) for c in features]
        hits = [F.coalesce((x < a) | (x > b), F.lit(False)) for x, a, b in zip(values, low, high)]
        far = [F.greatest(a - x, x - b, F.lit(0.0)) for x, a, b in zip(values, low, high)]
        whole, flag = F.lit(True), F.lit(False)
        for x, a, hit in zip(values, low, hits):
            whole, flag = whole & x.isNotNull() & a.isNotNull(), flag | hit
        score = F.when(whole, _greatest(far))
    else:
        raise ValueError(f"no batch detector of this name: {method}")
    fit = scratch.keep(
        fit.select("_group", "group_rows", *[F.col(n).alias(f"_{n}") for n in names]), "fit"
    )
    fitted = [f"_{n}" for n in names]
    scored = attach(keyed, fit, "_group", fitted, "group_rows").withColumns(
        {"anomaly": F.when(flag, 1).otherwise(0), "anomaly_score": score}
    ).drop(*fitted)
    slim = attach(slim, fit, "_group", fitted, "group_rows")
    distribution = grouped_distribution(slim, ["_group"], score, scratch, "scores")
    ranked = grouped_percent_rank(
        scored, ["_group"], "anomaly_score", distribution, "anomaly_probability", scratch, "steps"
    )
    return ranked.drop("_group").withColumn("risk_tier", risk_tier(F.col("anomaly_probability")))


def batch_summary(scored: DataFrame, by: str = BY) -> DataFrame:
    """One row for each group: rows, anomalies, rate in percent, rows of each tier, highest score."""
    tiers = [F.count_if(F.col("risk_tier") == t).alias(f"{t.lower()}_rows") for t in TIER_ORDER]
    return (
        scored.groupBy(col(by))
        .agg(
            F.count(F.lit(1)).alias("total_records"),
            F.sum("anomaly").cast("bigint").alias("anomalies"),
            *tiers,
            F.max("anomaly_score").alias("highest_score"),
        )
        .withColumn("anomaly_rate", _rate("anomalies", "total_records"))
    )
