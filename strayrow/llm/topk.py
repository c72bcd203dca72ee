"""Exact top-k by inner product, with a table of distances to pivots.

Vectors are scaled and floored to integers. With M the greatest norm, a vector x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0); then |q|^2 + M^2 - 2 q.x is a squared
distance, so the greatest inner products are the nearest neighbours. The distances of all vectors
to many pivots are computed once; the greatest difference |d(q, p) - d(x, p)| over the pivots is a
lower bound of d(q, x), so it bounds the score from above. A query evaluates candidates in the
order of their bounds and stops when the next bound is below the k-th score found.

Vectors and queries are dealt into buckets of bounded size by a hash; each pair of a bucket of
vectors and a bucket of queries is one task that returns at most k rows for each query, from which
the best k are taken.

Edge cases: vectors that are null, or hold a null or a number that is not finite, take no part;
shorter vectors count as filled up with zeros; repeated rows are candidates of their own, and only
a query's own row is left out; ties go to the smaller id, rows without an id first; fewer rows than
k give them all; an empty table gives an empty table; other columns are ignored. Scaled components
must stay below 2^25 in size, so that scores are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrow.functions.materialize import pin

PIVOTS = 24
PIVOT_SAMPLE = 1_000
BUCKET = 16_384
QUERY_BUCKET = 1_024
STEP = 512


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next one has the greatest distance to those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def lifted(rows: np.ndarray, most: float, query: bool) -> np.ndarray:
    rest = np.zeros(len(rows)) if query else np.sqrt(np.maximum(0, most - (rows**2).sum(1)))
    return np.column_stack([rows, rest])


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (rows**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(0, squared))


def search(
    data: np.ndarray,
    table: np.ndarray,
    order: np.ndarray,
    query: np.ndarray,
    to_pivots: np.ndarray,
    most: float,
    own: int | None,
    k: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the best k rows of ``data``, and how many rows were evaluated.

    ``table`` holds the rows' distances to the pivots, one pivot after the other. ``order`` ranks
    rows of equal score. ``own`` is left out.
    """
    low = np.zeros(len(data))
    for mine, theirs in zip(table, to_pivots):
        np.maximum(low, np.abs(mine - theirs), out=low)
    base = float(query @ query) + most
    bound = (base - low**2) / 2 + 1 + 1e-6 * base  # with room for rounding
    if own is not None:
        bound[own] = -np.inf
    places, scores = np.zeros(0, np.int64), np.zeros(0)
    floor, evaluated = -np.inf, 0
    left = np.flatnonzero(bound > -np.inf)
    while len(left):
        if len(left) > STEP:
            split = np.argpartition(-bound[left], STEP)
            now, left = left[split[:STEP]], left[split[STEP:]]
        else:
            now, left = left, left[:0]
        evaluated += len(now)
        places = np.concatenate([places, now])
        scores = np.concatenate([scores, data[now] @ query])
        best = np.lexsort((order[places], -scores))[:k]
        places, scores = places[best], scores[best]
        if len(places) == k:
            floor = scores[-1]
            left = left[bound[left] >= floor]
    return places, scores, evaluated


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, id and ``score`` of each query's best k other rows."""
    sound = (
        vectors.select(
            F.col(id_col).alias("id"),
            F.coalesce(is_query, F.lit(False)).alias("query"),
            F.transform(vector_col, lambda x: x.cast("double") * F.lit(scale)).alias("v"),
        )
        .where(F.col("v").isNotNull())
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .withColumn("v", F.transform("v", lambda x: F.floor(x).cast("double")))
        .withColumn("row", F.monotonically_increasing_id())
    )
    rows = pin(sound)
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("query").alias("queries"),
        F.max(F.size("v")).alias("dims"),
        F.max(squared).alias("most"),
    ).first()
    dims, most = max(1, facts["dims"] or 1), float(facts["most"] or 0)
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(PIVOT_SAMPLE).select("v").collect()
    vectors_sampled = np.array([r["v"] + [0.0] * (dims - len(r["v"])) for r in sample]).reshape(-1, dims)
    chosen = choose_pivots(lifted(vectors_sampled, most, False), pivots)

    def matrix(column) -> np.ndarray:
        values = column.combine_chunks()
        lengths = np.diff(values.offsets.to_numpy())
        filled = np.zeros((len(values), dims))
        filled[np.arange(dims) < lengths[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
        return filled

    def measured(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            v, query = matrix(table["v"]), batch.column(1).to_numpy(zero_copy_only=False)
            near = distances(lifted(v, most, False), chosen) if len(chosen) else np.zeros((len(v), 0))
            asking = distances(lifted(v, most, True), chosen) if len(chosen) else near
            pick = lambda x: pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pick(near), pick(asking)],
                names=[*batch.schema.names, "near", "asking"],
            )

    kind = dict(rows.dtypes)["id"]
    prepared = pin(
        rows.mapInArrow(
            measured,
            f"id {kind}, query boolean, v array<double>, row long, near array<double>, asking array<double>",
        )
    )
    buckets = max(1, -(-facts["n"] // BUCKET))
    query_buckets = max(1, -(-facts["queries"] // QUERY_BUCKET))
    # Both sides' keys must have one type, or equal keys would meet in different partitions.
    bucket = F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket")
    query_bucket = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_buckets)).cast("int").alias("query_bucket")
    data = prepared.select(
        bucket, F.explode(F.sequence(F.lit(0), F.lit(query_buckets - 1))).alias("query_bucket"),
        "id", "row", "v", "near",
    )
    queries = prepared.where("query").select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), query_bucket,
        "id", "row", "v", "asking",
    )
    exact = np.float32 if most < 1 << 24 else np.float64  # no partial sum exceeds the norms' product

    def tile(data: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query": [], "place": [], "asked": [], "score": []}
        if len(data) and len(queries):
            rows = data["row"].to_numpy()
            by_id = np.lexsort((rows, data["id"].fill_null(0).to_numpy(), ~data["id"].is_null().to_numpy()))
            order = np.empty(len(rows), np.int64)
            order[by_id] = np.arange(len(rows))
            x = matrix(data["v"]).astype(exact)
            near = data["near"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1).T.copy()
            place_of = {int(r): i for i, r in enumerate(rows)}
            own_rows = queries["row"].to_numpy()
            asked = matrix(queries["v"]).astype(exact)
            asking = queries["asking"].combine_chunks().flatten().to_numpy().reshape(len(own_rows), -1)
            for i, own in enumerate(own_rows):
                places, scores, _ = search(
                    x, near, order, asked[i], asking[i], most, place_of.get(int(own)), k
                )
                found["asked"].append(np.full(len(places), i))
                found["place"].append(places)
                found["score"].append(scores)
        at = {n: np.concatenate([np.zeros(0, np.int64), *found[n]]) for n in ("asked", "place", "score")}
        asked_at, place_at = at["asked"].astype(np.int64), at["place"].astype(np.int64)
        return pa.table(
            {
                "query_row": queries["row"].take(pa.array(asked_at)),
                "query_id": queries["id"].take(pa.array(asked_at)),
                "row": data["row"].take(pa.array(place_at)),
                "id": data["id"].take(pa.array(place_at)),
                "score": pa.array(np.rint(at["score"]).astype(np.int64)),
            }
        )

    keys = ["bucket", "query_bucket"]
    found = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(
        tile, f"query_row long, query_id {kind}, row long, id {kind}, score long"
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_first("id"), "row")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
