"""Random rows by hash order: repeatable, and no full sort.

Keys of whole numbers, dates and texts are hashed by arithmetic that any SQL engine has, so that the
same rows can be drawn elsewhere: two numbers below a prime make one of 62 bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from strayrow.functions.columns import col
from strayrow.functions.quantiles import exact_quantiles

TOP_K_ROWS = 200_000
PRIME = 2_147_483_647  # products of two remainders fit into 63 bits
#: For the upper and the lower half: the multiplier that folds the key, then (multiplier, prime) of two
#: remainders whose product leaves no linear trace of the key, then those of a second such product.
HALVES = (
    (1_103_515_245, ((1_664_525, 1_610_612_741), (742_938_285, 2_147_483_629)), ((1_566_083_941, 1_999_999_973), (1_664_525, 1_610_612_741))),
    (1_220_703_125, ((950_706_376, 1_999_999_973), (69_069_069, 1_610_612_741)), ((1_343_714_438, 1_500_450_271), (950_706_376, 1_999_999_973))),
)
SHIFTS = ((12_345, 54_321), (1, 7))


def portable_hash(numbers: list[Column], seed: int) -> Column:
    """A whole number below PRIME * PRIME from 64-bit numbers; null counts as -1."""
    out = []
    for fold, *rounds in HALVES:
        at = F.lit(seed % PRIME).cast("bigint")
        for number in numbers:
            value = F.coalesce(number, F.lit(-1)).cast("bigint")
            for limb in (F.pmod(value, F.lit(PRIME)), F.pmod(F.shiftright(value, 31), F.lit(PRIME))):
                at = (at * F.lit(fold) + limb) % F.lit(PRIME)
        for (one, other), (shift, too) in zip(rounds, SHIFTS):
            first = (at * F.lit(one[0]) + F.lit(shift)) % F.lit(one[1])
            second = (at * F.lit(other[0]) + F.lit(too)) % F.lit(other[1])
            at = (first * second) % F.lit(PRIME)
        out.append(at)
    return out[0] * F.lit(PRIME) + out[1]


def hashed_number(numbers: list[int], seed: int) -> int:
    """``portable_hash`` of numbers that are at hand."""
    out = []
    for fold, *rounds in HALVES:
        at = seed % PRIME
        for value in numbers:
            for limb in (value % PRIME, (value >> 31) % PRIME):
                at = (at * fold + limb) % PRIME
        for (one, other), (shift, too) in zip(rounds, SHIFTS):
            at = ((at * one[0] + shift) % one[1]) * ((at * other[0] + too) % other[1]) % PRIME
        out.append(at)
    return out[0] * PRIME + out[1]


def key_number(name: str, dtype: T.DataType) -> Column | None:
    """A key column as a whole number, or nothing if engines would not agree on it."""
    value = col(name)
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return value.cast("bigint")
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("bigint")
    return None


def row_number(df: DataFrame, key: list[str] | None, seed: int) -> Column:
    """A whole number for each row: ``portable_hash`` where the key's types allow it."""
    numbers = [key_number(k, df.schema[k].dataType) for k in key or []]
    if not numbers or any(n is None for n in numbers):
        return F.floor(unit_hash(key, seed) * F.lit(float(1 << 53))).cast("bigint")
    return portable_hash(numbers, seed)


def row_hash(df: DataFrame, key: list[str] | None, seed: int) -> Column:
    """``unit_hash`` of a table's rows, by ``portable_hash`` where the key's types allow it."""
    numbers = [key_number(k, df.schema[k].dataType) for k in key or []]
    if not numbers or any(n is None for n in numbers):
        return unit_hash(key, seed)
    return portable_hash(numbers, seed).cast("double") / F.lit(float(PRIME) * PRIME)


def unit_hash(key: list[str] | None, seed: int) -> Column:
    """A number in [0,1) per row, from the key columns or else from the row's position."""
    source = [col(k) for k in key] if key else [F.monotonically_increasing_id()]
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *source), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def sample_rows(
    df: DataFrame, n: int, key: list[str] | None = None, seed: int = 42, total: int | None = None
) -> DataFrame:
    """Exactly ``n`` random rows, or all rows if there are not more.

    With ``key`` the choice depends on the data alone; without it, on where rows are stored.
    Up to TOP_K_ROWS rows are taken by a bounded top-k after a hash filter has thinned the
    table; more rows are cut at the exact hash value of the n-th one.
    """
    total = df.count() if total is None else total
    if total <= n:
        return df
    # Filters are not pushed below the explode: the hash repeats its parts, which a projection
    # computes once, but a filter anew each time, in code too long to be compiled.
    hashed = df.withColumn("_h", row_hash(df, key, seed)).withColumn("_u", F.explode(F.array("_h"))).drop("_h")
    ties = [F.col("_u"), *[col(k) for k in key or []]]
    if n <= TOP_K_ROWS:
        # Six standard deviations of slack: the filter practically never keeps too few. A key
        # with many copies makes hashes cluster, so a short result falls back to no filter.
        rate = (n + 6 * math.sqrt(n) + 50) / total
        thinned = hashed.where(F.col("_u") < rate)
        if rate < 0.5 and thinned.limit(n).count() == n:
            hashed = thinned
        return hashed.orderBy(*ties).limit(n).drop("_u")
    edge = exact_quantiles(hashed, {"u": (F.col("_u"), [(n - 1) / (total - 1)])})["u"][0]
    below = hashed.where(F.col("_u") < edge)
    missing = n - below.count()
    at_edge = hashed.where(F.col("_u") >= edge)
    return below.unionByName(at_edge.orderBy(*ties).limit(missing)).drop("_u")
