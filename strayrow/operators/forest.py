"""Isolation Forest.

Liu, Ting, Zhou: Isolation Forest, ICDM 2008. Each tree sees a small random sample, so the whole
forest is built from one bounded pool of rows: one hash per row selects the pool in a single
scan. Trees are grown in parallel, one group per tree; the finished forest has a size that does
not depend on the data and is applied batch by batch.

Which rows a tree sees, and where a node splits, come from a hash of plain arithmetic over the row's
key, the tree and the node, so a forest can be grown again elsewhere. Path lengths are rounded to
steps of 2^-24, so that their sums do not depend on the order of the trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.functions.materialize import pin
from strayrow.functions.sampling import PRIME, hashed_number, portable_hash, row_number, sample_rows
from strayrow.operators.scaling import Prepared, finish_model, fit_scores, matrix, prepare, score_counts

# Default size of the forest and its seed.
TREES = 100
TREE_ROWS = 256
SEED = 42

_EULER = 0.5772156649015329
_POOL_PER_TREE_ROW = 64
_PATH_STEPS = 1 << 24
_CHUNK = 16_384
_NODE_SCHEMA = (
    "tree int, node int, feature int, split double, left int, right int, path double"
)


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    length = 2 * (np.log(safe - 1) + _EULER) - 2 * (safe - 1) / safe
    return np.where(n > 2, length, np.where(n == 2, 1.0, 0.0))


def path_length(depth: int, rows: int) -> float:
    return depth + round(float(average_path(rows)) * _PATH_STEPS) / _PATH_STEPS


def grow_tree(x: np.ndarray, tree: int, seed: int = SEED) -> pd.DataFrame:
    """Nodes of one tree; ``path`` is the expected path length of a row that ends in a leaf.

    ``place`` numbers nodes from 1 at the root, the children of i being 2 i and 2 i + 1.
    """
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple] = []
    waiting = [(0, 1, np.arange(len(x)), 0)]
    reserved = 1
    while waiting:
        node, place, members, depth = waiting.pop()
        low, high = x[members].min(axis=0), x[members].max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or not len(varied):
            nodes.append((node, -1, 0.0, node, node, path_length(depth, len(members))))
            continue
        feature = int(varied[hashed_number([tree, place], seed + 2) % len(varied)])
        # The split lies in [low, high): rows equal to the minimum go left, the maximum right.
        share = float(hashed_number([tree, place], seed + 3)) / (float(PRIME) * PRIME)
        split = float(low[feature] + share * (high[feature] - low[feature]))
        if not low[feature] <= split < high[feature]:
            split = float(low[feature])
        goes_left = x[members, feature] <= split
        left, right = reserved, reserved + 1
        reserved += 2
        nodes.append((node, feature, split, left, right, 0.0))
        waiting.append((left, 2 * place, members[goes_left], depth + 1))
        waiting.append((right, 2 * place + 1, members[~goes_left], depth + 1))
    nodes.sort()
    return pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "path"])


@dataclass
class Forest:
    """All trees in flat arrays; ``roots`` holds the position of each root."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    depth: int
    tree_rows: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Outlier score in (0, 1]: two to the minus of the relative mean path length."""
        rows, width = x.shape
        values, start = np.ascontiguousarray(x).ravel(), np.arange(rows) * width
        tested = np.maximum(self.feature, 0)
        children = np.column_stack([self.right, self.left]).ravel()
        path = np.zeros(rows)
        for root in self.roots:
            at = np.full(rows, root)
            for _ in range(self.depth):
                goes_left = values.take(start + tested.take(at)) <= self.split.take(at)
                at = children.take(2 * at + goes_left)
            path += self.path.take(at)
        mean_path = path / len(self.roots)
        return np.exp2(-mean_path / max(float(average_path(self.tree_rows)), 1e-12))


def fit_forest(
    prepared: Prepared,
    key: list[str] | None = None,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    seed: int = SEED,
) -> Forest:
    names = prepared.names
    vectors = prepared.vectors(row_number(prepared.rows, key, seed).alias("number"))
    # The pool is a uniform sample far larger than a tree's share of it, and bounded.
    pool_size = tree_rows * _POOL_PER_TREE_ROW
    pool = pin(sample_rows(vectors, pool_size, ["number"], seed, prepared.n))
    pool_rows = pool.count()
    if pool_rows == 0:
        raise ValueError("no rows to fit")
    size = min(tree_rows, pool_rows)
    rate = min(1.0, (size + 6 * math.sqrt(size) + 20) / pool_rows)
    drawn = pool.select(
        *names, "number", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    ).withColumn("place", portable_hash([F.col("tree"), F.col("number")], seed + 1))

    def build(group: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(group[0])
        kept = sample.sort_values(["place", *names])[:size]
        nodes = grow_tree(kept[names].to_numpy(float), tree, seed)
        return nodes.assign(tree=tree)[[f.split()[0] for f in _NODE_SCHEMA.split(", ")]]

    chosen = drawn.where(F.col("place") < rate * PRIME * PRIME) if rate < 1 else drawn
    # Few rows but much work per tree: spread the trees, whatever the size of their rows.
    tasks = min(trees, pool.sparkSession.sparkContext.defaultParallelism)
    spread = chosen.repartition(tasks, "tree")
    nodes = spread.groupBy("tree").applyInPandas(build, _NODE_SCHEMA).toPandas()
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    sizes = nodes.groupby("tree").size()
    roots = np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]])
    base = np.repeat(roots, sizes.to_numpy())
    return Forest(
        nodes["feature"].to_numpy(np.int64),
        nodes["split"].to_numpy(float),
        nodes["left"].to_numpy(np.int64) + base,
        nodes["right"].to_numpy(np.int64) + base,
        nodes["path"].to_numpy(float),
        roots,
        math.ceil(math.log2(max(size, 2))),
        size,
    )


def score_forest(prepared: Prepared, forest: Forest, out: str = "raw_score") -> DataFrame:
    """Add the raw outlier score; the forest is the same small size for any table."""
    shared = prepared.rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scorer(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            x = matrix(batch)
            parts = [model.score(x[i : i + _CHUNK]) for i in range(0, len(x), _CHUNK)]
            yield pd.Series(np.concatenate(parts or [np.empty(0)]))

    return prepared.rows.withColumn(out, scorer(*prepared.scaled))


def isolation_forest(
    df: DataFrame,
    features: list[str],
    contamination: float = 0.1,
    key: list[str] | None = None,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Detect with an Isolation Forest over all rows.

    With a unique ``key`` the result depends on the data alone, not on how it is partitioned.
    """
    prepared = prepare(df, features)
    forest = fit_forest(prepared, key, trees, tree_rows, seed)
    scored = score_forest(prepared, forest)
    fitted = fit_scores(score_counts(scored, "raw_score"), contamination)
    return finish_model(scored, "raw_score", fitted)
