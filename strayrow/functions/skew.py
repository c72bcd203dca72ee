"""Attach per-group values to detail rows, whatever the sizes and however skewed the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col, role_of

BROADCAST_ROWS = 500_000
HOT_SHARE = 1_000
SALTS = 256


def attach(
    rows: DataFrame,
    groups: DataFrame,
    key: str | list[str],
    values: list[str],
    weight: str,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join of ``values`` from ``groups`` (one pinned row per key) onto ``rows``.

    A counted small table is broadcast. Otherwise the keys with more than 1/1000 of all rows
    (so fewer than 1000 of them; ``weight`` holds the row counts) are broadcast and the rest
    is joined by shuffle, where rows already served go to salted empty keys instead of one
    hot partition.
    """
    keys = [key] if isinstance(key, str) else key
    slim = groups.select(*map(col, keys), *map(col, values), col(weight).alias("_weight"))
    size = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("_weight").alias("rows")).first()
    if size["n"] <= broadcast_rows:
        return rows.join(F.broadcast(slim.drop("_weight")), keys, "left")

    is_hot = F.col("_weight") > size["rows"] / HOT_SHARE
    hot = slim.where(is_hot).select(
        *map(col, keys), F.lit(True).alias("_hot"), *[col(v).alias(f"_hot_{v}") for v in values]
    )
    # The salt of a key is computed from the key: a constant would be folded out of the join.
    salt_of_key = F.pmod(F.xxhash64(*map(col, keys)), F.lit(SALTS))
    cold = slim.where(~is_hot).select(
        *map(col, keys), salt_of_key.alias("_salt"), *map(col, values)
    )
    served = F.col("_hot").isNotNull()
    for k in keys:
        served = served | col(k).isNull()
    varied = [f.name for f in rows.schema.fields if role_of(f.dataType) != "other"]
    spread = SALTS + F.pmod(
        F.xxhash64(F.spark_partition_id(), *map(col, varied)), F.lit(SALTS)
    )
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(served, spread).otherwise(salt_of_key))
        .join(cold, [*keys, "_salt"], "left")
    )
    return joined.select(
        *map(col, rows.columns),
        *[F.when(F.col("_hot"), col(f"_hot_{v}")).otherwise(col(v)).alias(v) for v in values],
    )
