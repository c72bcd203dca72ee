"""Ranks, quantiles and probabilities within each of many groups, some of which may be huge.

Values are counted before anything is shuffled by range, so that a group's values lie in as many
partitions as they need: running counts are taken inside a partition, and offsets added for the
partitions of the group before it. No window and no buffer holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrow.functions.columns import col, finite
from strayrow.functions.materialize import Scratch
from strayrow.functions.ranking import running_count, steps_reached
from strayrow.functions.skew import attach

BROADCAST_STEPS = 500_000


def grouped_distribution(
    df: DataFrame, group: list[str], value: Column, scratch: Scratch, name: str
) -> DataFrame:
    """Distinct values of each group in order: ``score``, ``rows`` with it, rows ``before`` it and
    ``n`` of the group; nulls and NaN are left out."""
    counts = (
        df.select(*map(col, group), finite(value.cast("double")).alias("score"))
        .where(F.col("score").isNotNull())
        .groupBy(*map(col, group), "score")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    ranged = counts.repartitionByRange(*map(col, group), F.col("score"))
    placed = scratch.keep(ranged.select("*", F.spark_partition_id().alias("part")), f"{name}-counts")
    totals = placed.groupBy(*map(col, group), "part").agg(F.sum("rows").alias("total"))
    # A row for each partition of a group: at most as many as there are partitions.
    own = Window.partitionBy(*map(col, group))
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *map(col, group), "part",
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"),
        F.sum("total").over(own).alias("n"),
    )
    inside = placed.withColumn("inside", running_count(Window.partitionBy(*map(col, group), "part")))
    found = inside.join(offsets, [*group, "part"]).select(
        *map(col, group), "score", "rows", (F.col("offset") + F.col("inside")).alias("before"), "n"
    )
    return scratch.keep(found, name)


def grouped_quantiles(distribution: DataFrame, group: list[str], wanted: dict[str, float]) -> DataFrame:
    """A row for each group with its linear-interpolation quantiles."""
    found = []
    for i, p in enumerate(wanted.values()):
        spot = F.lit(float(p)) * (F.col("n") - 1)
        for end, at in (("l", F.floor(spot)), ("u", F.ceil(spot))):
            holds = (F.col("before") <= at) & (at < F.col("before") + F.col("rows"))
            found.append(F.max(F.when(holds, F.col("score"))).alias(f"{end}{i}"))
    rows = distribution.groupBy(*map(col, group)).agg(F.max("n").alias("n"), *found)
    out = []
    for i, (name, p) in enumerate(wanted.items()):
        spot, low, high = F.lit(float(p)) * (F.col("n") - 1), F.col(f"l{i}"), F.col(f"u{i}")
        weight = spot - F.floor(spot)
        out.append(F.when(low == high, low).otherwise((1 - weight) * low + weight * high).alias(name))
    return rows.select(*map(col, group), "n", *out)


def grouped_percent_rank(
    df: DataFrame, group: list[str], score: str, distribution: DataFrame, out: str, scratch: Scratch, name: str
) -> DataFrame:
    """Add ``out``: the average-tie rank of ``score`` in its group, in percent with two decimals.

    Each group has at most 10,001 of these, and they never fall as the score rises. If all groups
    together have few, they are broadcast as steps to look up; else rows meet the distinct scores
    in a join that attaches hot scores by broadcast.
    """
    rank = F.col("before") + (F.col("rows") + 1) / 2
    percent = (F.rint(rank / F.col("n").cast("double") * 100 * 100) / 100).alias("probability")
    ranked = distribution.select(*map(col, group), "score", "rows", percent)
    steps = ranked.groupBy(*map(col, group), "probability").agg(F.min("score").alias("score"))
    steps = scratch.keep(steps, name)
    size = steps.groupBy(*map(col, group)).count().agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    size = size.first()
    if not size["all"]:
        return df.withColumn(out, F.lit(None).cast("double"))
    if size["all"] <= BROADCAST_STEPS:
        listed = F.array_sort(F.collect_list(F.struct("score", "probability")))
        tables = steps.groupBy(*map(col, group)).agg(listed.alias("_steps")).select(
            *map(col, group), F.col("_steps.score").alias("_starts"), F.col("_steps.probability").alias("_levels")
        )
        step = F.greatest(steps_reached(col(score), size["most"]) - 1, F.lit(0))
        level = F.when(col(score).isNotNull(), F.get("_levels", step))
        return df.join(F.broadcast(tables), group, "left").withColumn(out, level).drop("_starts", "_levels")
    pinned = scratch.keep(ranked.withColumnsRenamed({"score": score, "probability": out}), f"{name}-ranked")
    return attach(df, pinned, [*group, score], [out], "rows").select(*map(col, df.columns), col(out))
