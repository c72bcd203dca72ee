"""Local Outlier Factor with exact neighbours.

Breunig, Kriegel, Ng, Sander: LOF, SIGMOD 2000. Rows with equal features are one weighted point,
so a mass of copies costs one row. Points are split into boxes of about equal size by a k-d tree
grown on a sample. A first pass finds neighbours inside each box and with them an upper bound of
the k-distance; a second pass visits only the other boxes that the bound cannot rule out. Each
task holds one box, or one box and a bounded part of its visitors.

The neighbours of a row are exactly k other rows; equal distances are resolved by the order of
the feature values. All copies of a point share one score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayrow.functions.columns import col
from strayrow.functions.materialize import pin
from strayrow.functions.sampling import sample_rows
from strayrow.functions.skew import attach
from strayrow.operators.scaling import Prepared, finish_model, fit_scores, matrix, prepare

NEIGHBORS = 20  # fixed value
EPSILON = 1e-10  # keeps the density of identical points finite

BOX_POINTS = 1_500
MAX_BOXES = 32_768
VISITORS_PER_TASK = 50_000
_SAMPLE_PER_BOX = 32
_MATRIX_CELLS = 4_000_000
_BOUND_CHUNK = 256


@dataclass
class Boxes:
    """A k-d tree in flat arrays. Inner nodes have ``dim`` >= 0; leaves carry their number."""

    dim: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    number: np.ndarray
    depth: int

    @staticmethod
    def grow(sample: np.ndarray, boxes: int) -> Boxes:
        dim, split, left, right, number = [], [], [], [], []
        per_box = max(1.0, len(sample) / boxes)
        deepest, leaves = 0, 0

        def add() -> int:
            for part, empty in ((dim, -1), (split, 0.0), (left, 0), (right, 0), (number, -1)):
                part.append(empty)
            return len(dim) - 1

        waiting = [(add(), np.arange(len(sample)), 0)]
        while waiting:
            node, members, depth = waiting.pop()
            deepest = max(deepest, depth)
            values = sample[members]
            spread = values.max(axis=0) - values.min(axis=0) if len(members) else np.zeros(1)
            if len(members) <= per_box or not spread.max() > 0:
                number[node] = leaves
                leaves += 1
                left[node] = right[node] = node
                continue
            widest = int(spread.argmax())
            axis = np.sort(values[:, widest])
            cut = axis[(len(axis) - 1) // 2]
            if cut == axis[-1]:
                cut = axis[axis < cut][-1]
            goes_left = values[:, widest] <= cut
            dim[node], split[node] = widest, float(cut)
            left[node], right[node] = add(), add()
            waiting.append((left[node], members[goes_left], depth + 1))
            waiting.append((right[node], members[~goes_left], depth + 1))
        return Boxes(*map(np.asarray, (dim, split, left, right, number)), deepest)

    def locate(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            inner = self.dim[at] >= 0
            goes_left = x[rows, np.maximum(self.dim[at], 0)] <= self.split[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
        return self.number[at]


def _nearest(
    x: np.ndarray,
    y: np.ndarray,
    ids: np.ndarray,
    weights: np.ndarray,
    k: int,
    own: bool,
    bound: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Nearest points of ``y`` per row of ``x`` until their weights add up to ``k``.

    Yields (row, position in y, squared distance, weight), blocks of rows at a time. With
    ``own``, x and y are the same points and a point is a neighbour of itself once less often
    than it occurs. ``bound`` limits the squared distance.
    """
    step = max(1, _MATRIX_CELLS // max(len(y), 1))
    for start in range(0, len(x), step):
        block = x[start : start + step]
        distance = np.zeros((len(block), len(y)))
        for j in range(x.shape[1]):
            distance += (block[:, j, None] - y[None, :, j]) ** 2
        if own:
            diagonal = np.arange(len(block))
            lonely = weights[start + diagonal] <= 1
            distance[diagonal[lonely], start + diagonal[lonely]] = np.inf
        if len(y) > k:
            limit = np.partition(distance, k - 1, axis=1)[:, k - 1]
        else:
            limit = np.full(len(block), np.finfo(float).max)
        if bound is not None:
            limit = np.minimum(limit, bound[start : start + step])
        row, at = np.nonzero((distance <= limit[:, None]) & np.isfinite(distance))
        d2 = distance[row, at]
        order = np.lexsort((ids[at], d2, row))
        row, at, d2 = row[order], at[order], d2[order]
        weight = weights[at] - ((at == row + start) if own else 0)
        running = np.cumsum(weight) - weight
        first = np.searchsorted(row, row)
        before = running - running[first] if len(row) else running
        keep = before < k
        yield row[keep] + start, at[keep], d2[keep], weight[keep]


def _neighbors(prepared: Prepared, k: int, points: DataFrame, n_points: int) -> DataFrame:
    """(p, o, d, share): ``share`` of the k neighbours of point ``p`` lie at point ``o``."""
    spark = points.sparkSession
    names = prepared.names
    boxes = min(MAX_BOXES, max(1, math.ceil(n_points / BOX_POINTS)))
    sample = sample_rows(points, boxes * _SAMPLE_PER_BOX, ["p"], total=n_points)
    tree = Boxes.grow(sample.select(*names).toPandas().to_numpy(float), boxes)

    @F.pandas_udf("bigint")
    def locate(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(tree.locate(matrix(batch)))

    boxed = points.withColumn("box", locate(*names))
    # One row per box, at most 2 * MAX_BOXES: the tree was grown to that size.
    outline = (
        boxed.groupBy("box")
        .agg(*[F.min(c).alias(f"l_{c}") for c in names], *[F.max(c).alias(f"h_{c}") for c in names])
        .toPandas()
        .sort_values("box")
    )
    number = outline["box"].to_numpy()
    low = outline[[f"l_{c}" for c in names]].to_numpy(float)
    high = outline[[f"h_{c}" for c in names]].to_numpy(float)
    columns = ["p", "o", "d2", "weight", "box", *names]
    schema = "p bigint, o bigint, d2 double, weight bigint, box bigint, " + ", ".join(
        f"{c} double" for c in names
    )

    def inside(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Neighbours in the own box, then one row per other box that must be visited."""
        x, ids, weights = pdf[names].to_numpy(float), pdf["p"].to_numpy(), pdf["weight"].to_numpy()
        parts = list(_nearest(x, x, ids, weights, k, own=True))
        row, at, d2, weight = (np.concatenate([p[i] for p in parts]) for i in range(4))
        reached = np.bincount(row, weights=weight, minlength=len(x)) >= k
        bound = np.zeros(len(x))
        np.maximum.at(bound, row, d2)
        bound = np.where(reached, bound, np.finfo(float).max)
        found = pd.DataFrame({"p": ids[row], "o": ids[at], "d2": d2, "weight": weight})

        other = number != group[0]
        their_low, their_high, theirs = low[other], high[other], number[other]
        by_bound = np.argsort(bound)
        visits = []
        for start in range(0, len(x), _BOUND_CHUNK):
            chunk = by_bound[start : start + _BOUND_CHUNK]
            lo, hi = x[chunk].min(axis=0), x[chunk].max(axis=0)
            gap = np.zeros(len(theirs))
            for j in range(x.shape[1]):
                gap += np.maximum(np.maximum(their_low[:, j] - hi[j], lo[j] - their_high[:, j]), 0) ** 2
            near = np.flatnonzero(gap <= bound[chunk].max())
            distance = np.zeros((len(chunk), len(near)))
            for j in range(x.shape[1]):
                v = x[chunk, j][:, None]
                distance += (
                    np.maximum(np.maximum(their_low[near, j] - v, v - their_high[near, j]), 0) ** 2
                )
            who, where = np.nonzero(distance <= bound[chunk][:, None])
            visits.append((chunk[who], theirs[near[where]]))
        who = np.concatenate([v[0] for v in visits])
        asked = pd.DataFrame({"p": ids[who], "d2": bound[who]})
        asked["box"] = np.concatenate([v[1] for v in visits])
        asked[names] = x[who]
        return pd.concat([found, asked], ignore_index=True).reindex(columns=columns).astype(
            {c: "Int64" for c in ("p", "o", "weight", "box")}
        )

    first = pin(boxed.groupBy("box").applyInPandas(inside, schema))
    found = first.where(F.col("o").isNotNull()).select("p", "o", "d2", "weight")
    visits = first.where(F.col("o").isNull()).select("p", "d2", "box", *names)

    # A box with many visitors is served by several tasks, each with a copy of the box.
    crowd = pin(
        visits.groupBy("box").agg(
            F.ceil(F.count(F.lit(1)) / VISITORS_PER_TASK).cast("int").alias("tasks")
        )
    )
    if not crowd.isEmpty():
        crowd = F.broadcast(crowd)
        asking = visits.join(crowd, "box").withColumn(
            "task", F.pmod(F.xxhash64("p"), F.col("tasks")).cast("int")
        )
        asked = boxed.join(crowd, "box").withColumn(
            "task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))
        )

        def across(visitors: pd.DataFrame, box: pd.DataFrame) -> pd.DataFrame:
            ids = box["p"].to_numpy()
            parts = list(
                _nearest(
                    visitors[names].to_numpy(float),
                    box[names].to_numpy(float),
                    ids,
                    box["weight"].to_numpy(),
                    k,
                    own=False,
                    bound=visitors["d2"].to_numpy(),
                )
            )
            if not parts:
                return pd.DataFrame({"p": [], "o": [], "d2": [], "weight": []})
            row, at, d2, weight = (np.concatenate([p[i] for p in parts]) for i in range(4))
            return pd.DataFrame(
                {"p": visitors["p"].to_numpy()[row], "o": ids[at], "d2": d2, "weight": weight}
            )

        more = (
            asking.groupBy("box", "task")
            .cogroup(asked.groupBy("box", "task"))
            .applyInPandas(across, "p bigint, o bigint, d2 double, weight bigint")
        )
        found = found.unionByName(more)

    nearer = Window.partitionBy("p").orderBy("d2", "o").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(nearer), F.lit(0))
    return (
        found.withColumn("before", before)
        .where(F.col("before") < k)
        .select(
            "p",
            "o",
            F.sqrt("d2").alias("d"),
            F.least(F.col("weight"), F.lit(k) - F.col("before")).alias("share"),
        )
    )


def _points(prepared: Prepared) -> DataFrame:
    """Distinct feature vectors with their number of rows, numbered in the order of values."""
    names = prepared.names
    return pin(
        prepared.vectors()
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("weight"))
        .orderBy(*names)
        .withColumn("p", F.monotonically_increasing_id())
    )


def point_scores(prepared: Prepared, neighbors: int = NEIGHBORS) -> DataFrame:
    """Distinct feature vectors with ``weight`` rows each and their ``raw_score``."""
    points = _points(prepared)
    size = points.agg(F.count(F.lit(1)).alias("points"), F.sum("weight").alias("rows")).first()
    k = min(neighbors, (size["rows"] or 0) - 1)
    if k < 1:
        raise ValueError("a local outlier factor needs at least two rows")

    pairs = pin(_neighbors(prepared, k, points, size["points"]))
    reach_of = pairs.groupBy(F.col("p").alias("o")).agg(F.max("d").alias("k_distance"))
    density = pin(
        pairs.join(reach_of, "o")
        .groupBy("p")
        .agg(F.sum(F.col("share") * F.greatest("k_distance", "d")).alias("reach"))
        .select("p", (1 / (F.col("reach") / k + EPSILON)).alias("density"))
    )
    of_neighbors = (
        pairs.join(density.select(F.col("p").alias("o"), F.col("density").alias("theirs")), "o")
        .groupBy("p")
        .agg((F.sum(F.col("share") * F.col("theirs")) / k).alias("theirs"))
    )
    scores = of_neighbors.join(density, "p").select(
        "p", (F.col("theirs") / F.col("density")).alias("raw_score")
    )
    return pin(points.join(scores, "p").drop("p"))


def local_outlier_factor(
    df: DataFrame,
    features: list[str],
    contamination: float = 0.1,
    neighbors: int = NEIGHBORS,
) -> DataFrame:
    prepared = prepare(df, features)
    points = point_scores(prepared, neighbors)
    names = [f"_{c}" for c in prepared.names]
    keyed = prepared.rows.withColumns(dict(zip(names, prepared.scaled)))
    renamed = points.withColumnsRenamed(dict(zip(prepared.names, names)))
    scored = attach(keyed, renamed, names, ["raw_score"], "weight")
    scored = scored.select(*map(col, df.columns), "raw_score")
    fitted = fit_scores(
        points.select(F.col("raw_score").alias("score"), F.col("weight").alias("rows")),
        contamination,
    )
    return finish_model(scored, "raw_score", fitted)

