import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayrow.functions.components import connected_components
from strayrow.operators import dbscan as module
from strayrow.operators.dbscan import dbscan


def plain(x, eps, min_rows):
    """(cluster, core, rows within reach) of scaled rows; clusters named by their first core row."""
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    seen = near.sum(1)
    core = seen >= min_rows
    name = np.where(core, np.arange(len(x)), -1)
    changed = True
    while changed:
        best = np.where(near & core[None] & core[:, None], name[None], len(x)).min(1)
        new = np.where(core, np.minimum(name, best), -1)
        changed = (new != name).any()
        name = new
    beside = np.where(near & core[None], name[None], len(x)).min(1)
    return np.where(core, name, np.where(beside < len(x), beside, -1)), core, seen


def scaled(x):
    spread = x.std(0)
    return np.where(spread > 0, (x - x.mean(0)) / np.where(spread > 0, spread, 1), 0)


def check(spark, x, eps, min_rows):
    frame = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])]).assign(id=np.arange(len(x)))
    df = spark.createDataFrame(frame).repartition(5)
    got = dbscan(df, [c for c in frame if c != "id"], eps, min_rows, ["id"]).toPandas().sort_values("id")
    cluster, core, seen = plain(scaled(x), eps, min_rows)
    assert got["cluster"].fillna(-1).astype(int).tolist() == cluster.tolist()
    assert got["core"].tolist() == core.tolist()
    assert got["anomaly"].tolist() == (cluster < 0).astype(int).tolist()
    expected = np.where(core, 0.0, 10.0 * (min_rows - np.minimum(seen, min_rows)) / min_rows)
    assert np.allclose(got["anomaly_score"], expected)
    return cluster


def test_clusters_of_several_shapes(spark):
    rng = np.random.default_rng(2)
    ring = np.linspace(0, 2 * np.pi, 400)
    x = np.concatenate([
        np.column_stack([np.cos(ring), np.sin(ring)]) * 3 + rng.normal(0, 0.05, (400, 2)),
        rng.normal(0, 0.4, (300, 2)),
        rng.uniform(-5, 5, (150, 2)),
    ])
    cluster = check(spark, x, 0.15, 6)
    assert (cluster < 0).any() and len(set(cluster)) >= 3


@pytest.mark.parametrize("dims", [1, 3, 5])
def test_one_to_five_features(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(c, 0.5, (120, dims)) for c in (0, 4, 4.8)] + [rng.uniform(-6, 10, (60, dims))])
    check(spark, x, 0.3 * np.sqrt(dims) / 1.5, 5)


def test_ties_at_the_edge_of_reach(spark):
    x = np.array([[i, j] for i in range(12) for j in range(12)], float)
    x = x[(x.sum(1) % 5) != 4]
    step = 1 / x.std(0)[0]
    for eps in (step * 0.999, step * 1.001, step * 1.42):
        check(spark, x, eps, 4)


def test_boxes_are_split_where_they_leave_links_open(spark, monkeypatch):
    monkeypatch.setattr(module, "PAIRS", 4)
    rng = np.random.default_rng(4)
    left, right = rng.uniform(0, 1, (300, 2)), rng.uniform(0, 1, (300, 2)) + [1.15, 0]
    x = np.concatenate([left, right, [[40, 40], [-40, -40]]])
    check(spark, x, 0.013, 3)
    check(spark, x, 0.002, 2)


def test_crowded_cells_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(module, "POINTS_PER_TASK", 7)
    rng = np.random.default_rng(6)
    check(spark, np.concatenate([rng.normal(0, 0.02, (500, 2)), rng.normal(0, 1, (300, 2))]), 0.2, 5)


def test_copies_are_one_point(spark):
    n = 1_000_000
    far = spark.createDataFrame([(n, 100.0, 1.0), (n + 1, 100.0, 1.0), (n + 2, 1.0, None)], "id long, a double, b double")
    df = spark.range(n).select("id", F.lit(1.0).alias("a"), F.lit(2.0).alias("b")).unionByName(far)
    began = time.time()
    got = dbscan(df, ["a", "b"], 0.5, 5, ["id"]).groupBy("cluster", "core", "anomaly").count().collect()
    assert {tuple(r) for r in got} == {(0, True, 0, n + 1), (None, False, 1, 2)}
    assert time.time() - began < 120


def test_odd_tables(spark):
    rows = [(1, 1.0, None, "x"), (2, float("nan"), 2.0, "y"), (3, 1.0, 2.0, None), (4, -0.0, 0.0, "z"), (5, 0.0, -0.0, "z"), (6, 1.0, 2.0, "w")]
    df = spark.createDataFrame(rows, "id long, `a.b` double, y double, cluster string")
    got = {r["id"]: (r["cluster"], r["core"], r["anomaly"]) for r in dbscan(df, ["a.b", "y"], 0.01, 2, ["id"]).collect()}
    assert got == {1: (1, True, 0), 2: (1, True, 0), 3: (1, True, 0), 4: (4, True, 0), 5: (4, True, 0), 6: (1, True, 0)}
    without = dbscan(df, ["a.b", "y"], 0.01, 2).select("cluster").distinct().count()
    assert without == 2
    several = dbscan(df, ["a.b", "y"], 0.01, 2, ["id", "y"]).select("cluster.id").distinct()
    assert {r["id"] for r in several.collect()} == {1, 4}


def test_components_of_chains_stars_and_rings(spark):
    rng = np.random.default_rng(9)
    edges = [(i, i + 1) for i in range(0, 300)]
    edges += [(1000, i) for i in range(1001, 1400)]
    edges += [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(3000, 3000), (5, 5)]
    edges += [(4000 + int(a), 4000 + int(b)) for a, b in rng.integers(0, 200, (150, 2))]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    expected = {i: find(i) for i in root}
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert {r["node"]: r["component"] for r in got} == expected
    assert len(got) == len(expected)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
