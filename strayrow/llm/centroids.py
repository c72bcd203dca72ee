"""Centroid clustering (Lloyd's rounds) with ns-bounds.

Newling, Fleuret: Fast k-means with accurate bounds, ICML 2016. Each vector keeps, for every
centroid, its distance when it was last evaluated and the round in which that was. The centroids of
all rounds are kept. A stored distance is loosened by the norm of the centroid's total displacement
since that round, |c(now) - c(then)|, which is never more than the sum of the drifts of the rounds
between. Centroids whose loosened lower bound lies above the loosened distance to the vector's own
centroid cannot be nearest; if any other one is left, the distance to the own centroid is evaluated
anew, and then those that the tighter bound leaves. All comparisons that decide are made on whole
numbers; bounds only exclude, with room for rounding, so ties go to the smaller centroid.

Vectors with their bounds are a table that each round writes anew and whose predecessor it drops.
New centroids come from running sums: a round adds only the vectors that changed their cluster.
The driver sees sums, displacements and centroids (k x dimensions x rounds numbers) and no vectors
but the k seeds.

Edge cases: vectors that are null, have another number of components, or hold a null or a number
that is not finite are left out; repeated rows are vectors of their own; rows without an id are
clustered, but are seeds only if there are too few others; seeds of equal hash (a repeated id) are
taken in the order of their components; fewer vectors than k give fewer centroids; an empty table
gives an empty table; other columns are ignored, whatever their names. Scaled components must stay
so small that squared distances fit into 62 bits, else ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col
from strayrow.functions.materialize import Scratch

ROOM = 1e-9
CHUNK = 8_192
_STATE = "id {id}, v array<int>, was int, cluster int, near long, since short, low array<float>, at array<short>"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` and ``c``, as whole numbers."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if most * most * max(1, x.shape[1]) < 1 << 52:  # then no partial sum is rounded
        a, b = x.astype(float), c.astype(float)
        return np.rint((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def _floor32(values: np.ndarray) -> np.ndarray:
    return np.nextafter(values.astype(np.float32), np.float32(-np.inf))


class Bounds:
    """What a batch of vectors knows: own cluster and exact squared distance to it in round
    ``since``; lower bounds ``low`` of the distances to all centroids in the rounds ``at``."""

    def __init__(self, x: np.ndarray, centroids: np.ndarray):
        exact = squared(x, centroids)
        self.cluster = exact.argmin(1).astype(np.int32)
        self.near = exact[np.arange(len(x)), self.cluster]
        self.since = np.zeros(len(x), np.int16)
        self.low = _floor32(np.sqrt(exact))
        self.at = np.zeros(exact.shape, np.int16)
        self.evaluated = exact.size

    @classmethod
    def of(cls, cluster, near, since, low, at) -> Bounds:
        self = cls.__new__(cls)
        self.cluster, self.near, self.since, self.low, self.at = cluster, near, since, low, at
        self.evaluated = 0
        return self

    def advance(self, x: np.ndarray, history: np.ndarray, moved: np.ndarray) -> None:
        """To the newest round; ``moved[t, j]`` is how far centroid j has come since round t."""
        now, centroids = len(history) - 1, history[-1]
        every, numbers = np.arange(len(x)), np.arange(len(centroids))
        lower = self.low - moved[self.at, numbers] * (1 + ROOM) - ROOM
        upper = np.sqrt(self.near) + moved[self.since, self.cluster]
        lower[every, self.cluster] = np.inf
        failed = np.flatnonzero((lower <= (upper * (1 + ROOM) + ROOM)[:, None]).any(1))
        if not len(failed):
            return
        own = self.cluster[failed]
        exact = self._evaluate(x, centroids, failed, own, now)
        self.near[failed], self.since[failed] = exact, now
        bound = np.sqrt(exact) * (1 + ROOM) + ROOM
        at, rival = np.nonzero(lower[failed] <= bound[:, None])
        rows = failed[at]
        found = self._evaluate(x, centroids, rows, rival, now)
        # The best of a row's rivals, then of it and the row's own centroid; ties: smaller number.
        best = np.lexsort((rival, found, rows))
        best = best[np.unique(rows[best], return_index=True)[1]] if len(best) else best
        rows, rival, found = rows[best], rival[best], found[best]
        wins = (found < self.near[rows]) | ((found == self.near[rows]) & (rival < self.cluster[rows]))
        self.cluster[rows[wins]], self.near[rows[wins]] = rival[wins], found[wins]

    def _evaluate(self, x, centroids, rows, numbers, now) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), CHUNK):
            part = slice(i, i + CHUNK)
            out[part] = ((x[rows[part]] - centroids[numbers[part]]) ** 2).sum(1)
        self.low[rows, numbers] = _floor32(np.sqrt(out))
        self.at[rows, numbers] = now
        self.evaluated += len(rows)
        return out


def displacement(history: np.ndarray) -> np.ndarray:
    """Norm of each centroid's total displacement since every round of ``history``."""
    return np.sqrt(((history[-1] - history).astype(float) ** 2).sum(2))


def _lists(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _as_lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _pass(history: np.ndarray, first: bool):
    """Assign batch after batch to the newest centroids of ``history``."""
    moved = displacement(history)
    k, dims = history.shape[1:]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(i, CHUNK)
                x = _lists(batch["v"], dims, np.int64)
                if first:
                    bounds, was = Bounds(x, history[0]), np.full(len(x), -1, np.int32)
                else:
                    was = batch["cluster"].to_numpy().copy()
                    bounds = Bounds.of(
                        was.copy(), batch["near"].to_numpy().copy(), batch["since"].to_numpy().copy(),
                        _lists(batch["low"], k, np.float32), _lists(batch["at"], k, np.int16),
                    )
                    bounds.advance(x, history, moved)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"], batch["v"], pa.array(was), pa.array(bounds.cluster), pa.array(bounds.near),
                        pa.array(bounds.since), _as_lists(bounds.low, pa.float32()), _as_lists(bounds.at, pa.int16()),
                    ],
                    names=["id", "v", "was", "cluster", "near", "since", "low", "at"],
                )

    return run


def _changes(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their cluster add to its sums and counts."""

    def partial(batches):
        sums, rows = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _lists(batch["v"], dims, np.int64)
            to, left = batch["cluster"].to_numpy(), batch["was"].to_numpy()
            came = left >= 0
            np.add.at(sums, to, x)
            np.add.at(rows, to, 1)
            np.subtract.at(sums, left[came], x[came])
            np.subtract.at(rows, left[came], 1)
        used = np.flatnonzero(rows.astype(bool) | sums.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), _as_lists(np.column_stack([rows, sums])[used], pa.int64())],
            names=["cluster", "sums"],
        )

    parts = state.where("cluster <> was").select("v", "was", "cluster").mapInArrow(
        partial, "cluster int, sums array<long>"
    )
    # At most k x (dimensions + 1) numbers, added up before and after the shuffle.
    total = np.zeros((k, dims + 1), np.int64)
    spread = parts.select("cluster", F.posexplode("sums").alias("place", "number"))
    for row in spread.groupBy("cluster", "place").agg(F.sum("number").alias("number")).collect():
        total[row["cluster"], row["place"]] = row["number"]
    return total[:, 1:], total[:, 0]


def cluster_vectors(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    scale: float = 256.0,
    dims: int = 64,
    salt: str = "2",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` of each vector, in units of 1/``scale``.

    Seeds are the ``k`` vectors with the smallest sha256 of ``<salt>:<id>``. Each of the ``rounds``
    assigns all vectors and moves every centroid that has some to the floor of their mean; then they
    are assigned once more.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    kind = dict(vectors.select(col(id_col).alias("id")).dtypes)["id"]
    sound = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    scaled = vectors.select(
        col(id_col).alias("id"), F.transform(col(vector_col), lambda c: c.cast("double")).alias("x")
    ).where((F.size("x") == dims) & F.coalesce(sound, F.lit(False)))
    scaled = scaled.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    edge = scaled.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most")
    ).first()
    if edge["n"] and (2 * max(1, edge["most"])) ** 2 * dims >= 1 << 62:
        raise ValueError("components are too large for exact squared distances")
    start = scaled.select("id", F.col("v").cast("array<int>").alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    seeds = start.orderBy(F.asc_nulls_last(digest), "v").limit(k).select("v").collect()
    history = np.array([r["v"] for r in seeds], np.int64).reshape(1, len(seeds), dims)
    count = len(seeds)
    if not count:
        found = start.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("near"))
        facts = []
    else:
        state_type = _STATE.format(id=kind)
        state = scratch.keep(start.mapInArrow(_pass(history, True), state_type), "round0")
        sums, members = np.zeros((count, dims), np.int64), np.zeros(count, np.int64)
        for done in range(rounds):
            more, rows = _changes(state, count, dims)
            sums, members = sums + more, members + rows
            means = sums // np.maximum(members, 1)[:, None]
            newest = np.where(members[:, None] > 0, means, history[-1])
            history = np.concatenate([history, newest[None]])
            state = scratch.keep(state.mapInArrow(_pass(history, False), state_type), f"round{done + 1}")
            scratch.drop(f"round{done}")
        found = _final(state.select("id", "v", "cluster"), history[-1], kind)
        found = scratch.keep(found, "assigned")
        scratch.drop(f"round{rounds}")
        inertia = found.groupBy("cluster").agg(F.sum("near").alias("inertia")).collect()
        total = sum(r["inertia"] for r in inertia)
        facts = [(r["cluster"], r["inertia"], total, _sha(history[-1][r["cluster"]])) for r in inertia]
    of_cluster = spark.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(of_cluster), "cluster").select(
        F.col("id").alias(id_col), "cluster", F.col("near").alias("distance"),
        "cluster_inertia", "inertia", "centroid_sha256",
    )


def _final(state: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """Exact distances to the clusters that bounds alone have confirmed."""

    def run(batches):
        for batch in batches:
            x, cluster = _lists(batch["v"], centroids.shape[1], np.int64), batch["cluster"].to_numpy()
            near = np.concatenate([
                np.zeros(0, np.int64),
                *[((x[i : i + CHUNK] - centroids[cluster[i : i + CHUNK]]) ** 2).sum(1) for i in range(0, len(x), CHUNK)],
            ])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["cluster"], pa.array(near)], names=["id", "cluster", "near"])

    return state.mapInArrow(run, f"id {kind}, cluster int, near long")


def _sha(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
