import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strayrow.functions.materialize import pin
from strayrow.operators import lof
from strayrow.operators.forest import average_path, grow_tree, isolation_forest
from strayrow.operators.lof import local_outlier_factor, point_scores
from strayrow.operators.scaling import prepare
from strayrow.operators.svm import fit_svm, one_class_svm
from strayrow.sources.sample import sample_dataset

FEATURES = ["Feature_1", "Feature_2", "Feature_3"]


@pytest.fixture(scope="module")
def sample(spark):
    return pin(sample_dataset(spark, 4000))


def auc(df):
    data = df.select("planted", "anomaly_score").toPandas()
    ranks, planted = data["anomaly_score"].rank(), data["planted"]
    m, n = planted.sum(), len(data)
    return (ranks[planted].sum() - m * (m + 1) / 2) / (m * (n - m))


def test_forest_finds_planted_rows(spark, sample):
    found = isolation_forest(sample, FEATURES, 0.05, ["id"])
    assert auc(found) >= 0.95
    top = found.where(F.col("planted") & (F.col("anomaly_probability") <= 90)).count()
    assert top == 0
    assert 0 <= found.agg(F.min("anomaly_score")).first()[0]
    assert found.agg(F.max("anomaly_score")).first()[0] == 10.0


def test_forest_does_not_depend_on_partitioning(spark, sample):
    results = [
        isolation_forest(sample.repartition(n), FEATURES, 0.1, ["id"], trees=20)
        .orderBy("id")
        .toPandas()["anomaly_score"]
        for n in (2, 7)
    ]
    assert np.allclose(*results, rtol=1e-9)


def test_forest_on_constant_rows(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(30)], "id int, x double")
    found = isolation_forest(df, ["x"], key=["id"], trees=5).toPandas()
    assert set(found["anomaly_score"]) == {0.0} and set(found["anomaly"]) == {0}


def test_tree_separates_every_distinct_row():
    nodes = grow_tree(np.array([[0.0], [1.0], [1.0], [5.0]]), 1)
    inner = nodes[nodes["feature"] >= 0]
    assert (inner["left"] != inner["right"]).all()
    assert average_path(2) == 1 and average_path(1) == 0
    assert average_path(256) == pytest.approx(10.244, abs=1e-3)


def brute_force(x: np.ndarray, k: int) -> np.ndarray:
    """LOF of every row; equal rows are one weighted point, ties go to the smaller values."""
    points, place, weight = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    squared = np.zeros((len(points), len(points)))
    for j in range(x.shape[1]):
        squared += (points[:, j, None] - points[None, :, j]) ** 2
    near = []
    for i in range(len(points)):
        left, mine = k, []
        for o in np.lexsort((np.arange(len(points)), squared[i])):
            share = min(weight[o] - (o == i), left)
            if share > 0:
                mine.append((o, share))
                left -= share
            if not left:
                break
        near.append(mine)
    d = np.sqrt(squared)
    reach = np.array([max(d[i, o] for o, _ in near[i]) for i in range(len(points))])
    density = np.array(
        [
            1 / (sum(s * max(reach[o], d[i, o]) for o, s in near[i]) / k + 1e-10)
            for i in range(len(points))
        ]
    )
    factor = [sum(s * density[o] for o, s in near[i]) / k / density[i] for i in range(len(points))]
    return np.array(factor)[place.ravel()]


RNG = np.random.default_rng(3)
CLOUDS = {
    "gauss": RNG.normal(size=(700, 3)),
    "grid": RNG.integers(0, 15, size=(800, 2)).astype(float),
    "third_is_one_point": np.vstack([np.zeros((400, 2)), RNG.normal(size=(700, 2))]),
    "line": RNG.exponential(size=(500, 1)),
    "two_clusters": np.vstack([RNG.normal(size=(400, 2)), 50 + 0.01 * RNG.normal(size=(300, 2))]),
    "few": RNG.normal(size=(8, 2)),
}


@pytest.mark.parametrize("cloud", CLOUDS)
def test_lof_equals_brute_force(spark, cloud, monkeypatch):
    monkeypatch.setattr(lof, "BOX_POINTS", 60)
    monkeypatch.setattr(lof, "VISITORS_PER_TASK", 37)
    x = CLOUDS[cloud]
    names = [f"f{i}" for i in range(x.shape[1])]
    prepared = prepare(spark.createDataFrame(pd.DataFrame(x, columns=names)), names)
    got = point_scores(prepared).toPandas()
    scaled = prepared.vectors().toPandas()
    scaled["want"] = brute_force(scaled.to_numpy(), min(20, len(x) - 1))
    both = scaled.drop_duplicates().merge(got, on=prepared.names)
    assert len(both) == len(got) and both["weight"].sum() == len(x)
    assert np.allclose(both["raw_score"], both["want"], rtol=1e-6)


def test_lof_attaches_scores_to_every_row(spark):
    df = spark.createDataFrame(
        [(i, float(i % 7), None if i == 5 else float(i % 3), f"n{i}") for i in range(60)],
        "id int, x double, y double, name string",
    )
    found = local_outlier_factor(df, ["x", "y"])
    assert found.columns[:4] == df.columns
    assert found.count() == 60 and found.where("anomaly_score is null").count() == 0


def test_lof_needs_two_rows(spark):
    with pytest.raises(ValueError, match="two rows"):
        local_outlier_factor(spark.createDataFrame([(1.0,)], "x double"), ["x"])


def dual_decision(x: np.ndarray, gamma: float, nu: float, rounds: int = 4000) -> np.ndarray:
    """Projected gradient on the kernel dual, for a small table."""
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    n, cap = len(x), 1 / (nu * len(x))
    alpha = np.full(n, 1 / n)
    rate = 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(rounds):
        moved = alpha - rate * (kernel @ alpha)
        low, high = moved.min() - cap, moved.max()
        for _ in range(60):
            middle = (low + high) / 2
            if np.clip(moved - middle, 0, cap).sum() > 1:
                low = middle
            else:
                high = middle
        alpha = np.clip(moved - high, 0, cap)
    return kernel @ alpha


def test_svm_ranks_like_the_kernel_solution(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(560, 2)), rng.uniform(-6, 6, size=(40, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    prepared = prepare(df, ["a", "b"])
    vectors = prepared.vectors().toPandas().to_numpy()
    model = fit_svm(prepared, ["id"])
    ours = pd.Series(model.decision(vectors)).rank()
    theirs = pd.Series(dual_decision(vectors, 0.5, 0.5)).rank()
    assert ours.corr(theirs) >= 0.99


def test_svm_finds_planted_rows(spark, sample):
    assert auc(one_class_svm(sample, FEATURES, 0.05, ["id"], waves=128, steps=5)) >= 0.95
