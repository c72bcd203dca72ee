"""Near duplicates and clusters of vectors against plain versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as repo
from strayrow.llm import centroids, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain_near(rows, threshold=0.93):
    """{place: (id, links, component, kept)} of (id, vector, label) rows."""
    n = len(rows)
    good = [i for i, (key, v, label) in enumerate(rows) if sound(v) and label is not None and key is not None]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    groups = {}
    for i in good:
        groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for members in groups.values():
        x = np.array([rows[i][1] for i in members], float)
        x /= np.sqrt((x * x).sum(1))[:, None]
        for a, row in enumerate(x @ x.T >= threshold):
            near = [members[b] for b in np.flatnonzero(row) if b != a]
            links[members[a]] = len(near)
            for other in near:
                root[find(other)] = find(members[a])
    least = {}
    for i in good:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    out = []
    for i, (key, _, _) in enumerate(rows):
        first = least[find(i)] if i in set(good) else key
        out.append((key, links[i], first, key == first))
    return sorted(out, key=str)


def near(df, **options):
    found = near_vectors.near_vectors(df, **options)
    return sorted((tuple(r) for r in found.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def crowd(rng, size, noise, dims=16):
    base = rng.standard_normal(dims)
    base /= np.linalg.norm(base)
    return base + noise * rng.standard_normal((size, dims)) / np.sqrt(dims)


def test_crowds_chains_and_copies(spark):
    rng = np.random.default_rng(3)
    parts = [
        (crowd(rng, 700, 0.15), 1),  # balls hold them
        (crowd(rng, 300, 0.30), 1),  # links that half the angle does not prove
        (crowd(rng, 40, 0.15), 2),
        (rng.standard_normal((600, 16)), 1),
        (rng.standard_normal((300, 16)), 2),
        (np.repeat(rng.standard_normal((1, 16)), 120, axis=0), 2),
    ]
    chain = np.array([[np.cos(t), np.sin(t), *[0] * 14] for t in np.arange(0, 3, 0.3)])
    vectors = np.concatenate([*(p for p, _ in parts), chain])
    labels = [*(label for p, label in parts for _ in p), *[3] * len(chain)]
    ids = rng.permutation(len(vectors))
    rows = [(int(i), [float(np.float32(x)) for x in v], label) for i, v, label in zip(ids, vectors, labels)]
    got, true = near(spark.createDataFrame(rows, SCHEMA).repartition(6)), plain_near(rows)
    links = lambda found: sum(r[1] for r in found)
    assert all(mine[1] <= theirs[1] for mine, theirs in zip(got, true))  # none below the threshold
    assert links(got) >= 0.999 * links(true)
    loose = {i for i, _, label in rows[700:1000]}
    assert [r for r in got if r[0] not in loose] == [r for r in true if r[0] not in loose]


def test_odd_vectors(spark):
    rows = [
        (1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [0.0, 0.0], 1),
        (6, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1), (9, [1.0, 2.0, 0.0], 1),
        (7, [1.0, 2.0], 1), (10, [1.0, 2.0], 2), (11, [3e38, 3e38], 1), (12, [1e-44, 2e-44], 1), (7, [1.0, -1.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({"node": F.lit("x"), "grp": F.lit(1), "h": F.lit(0), "weight": F.lit(0), "a.b": F.lit(1), "links": F.lit(1)})
    assert near(clashing) == plain_near(rows)
    assert near(df.limit(0)) == []


def test_same_result_however_rows_lie(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([crowd(rng, 200, 0.15), rng.standard_normal((400, 16))])
    rows = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert near(df.repartition(3)) == near(df.repartition(11, "vec_id")) == plain_near(rows)


# Clustering


def plain_clusters(rows, k, rounds, dims, scale=256.0):
    kept = [(key, [int(np.floor(float(c) * scale)) for c in v]) for key, v, _ in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    digest = lambda key: hashlib.sha256(f"2:{key}".encode()).hexdigest()
    seeds = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]) if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, one)), j) for j, one in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, i) in zip(kept, at) if i == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    total = sum(d for d, _ in at)
    by = {j: sum(d for d, i in at if i == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in c]
    return sorted(((key, j, d, by[j], total, sha[j]) for (key, _), (d, j) in zip(kept, at)), key=str)


def clustered(df, **options):
    return sorted((tuple(r) for r in centroids.cluster_vectors(df, **options).collect()), key=str)


@pytest.mark.parametrize("k, rounds", [(7, 5), (1, 2), (12, 0)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.integers(-3, 4, (150, 3)), 5 + rng.integers(-2, 3, (60, 3))]) / 256  # many ties
    rows = [(int(i), [float(c) for c in v], 0) for i, v in enumerate(x)]
    got = clustered(spark.createDataFrame(rows, SCHEMA).repartition(5), k=k, rounds=rounds, dims=3)
    assert got == plain_clusters(rows, k, rounds, 3)


def test_clusters_of_odd_rows(spark):
    rows = [
        (1, [0.1, 0.2], 1), (1, [0.1, 0.2], 1), (1, [0.3, -0.2], 1), (None, [0.5, 0.5], 1), (2, None, 1), (3, [0.1], 1),
        (4, [None, 0.1], 1), (5, [float("inf"), 0.1], 1), (6, [float("nan"), 0.1], 1), (7, [-0.001, 9.0], None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cluster": F.lit("x"), "id": F.lit(1), "v": F.lit(2), "a.b": F.lit(3)})
    assert clustered(df, k=3, rounds=3, dims=2) == plain_clusters(rows, 3, 3, 2)
    assert clustered(df, k=99, rounds=1, dims=2) == plain_clusters(rows, 99, 1, 2)
    assert clustered(df.limit(0), k=3, rounds=3, dims=2) == []


def test_too_large_components_are_refused(spark):
    with pytest.raises(ValueError):
        clustered(spark.createDataFrame([(1, [3e38, 0.0], 1)], SCHEMA), dims=2)


def test_bounds_spare_distances_and_are_exact():
    rng = np.random.default_rng(0)
    centres = rng.integers(-300, 300, (20, 8))
    x = (centres[rng.integers(0, 20, 3_000)] + rng.integers(-25, 26, (3_000, 8))).astype(np.int64)
    history = x[rng.choice(len(x), 20, False)][None]
    bounds, evaluated = centroids.Bounds(x, history[0]), 0
    for _ in range(8):
        means = [x[bounds.cluster == j].sum(0) // max(1, (bounds.cluster == j).sum()) for j in range(20)]
        history = np.concatenate([history, np.array(means)[None]])
        bounds.evaluated = 0
        bounds.advance(x, history, centroids.displacement(history))
        evaluated += bounds.evaluated
        assert (bounds.cluster == centroids.squared(x, history[-1]).argmin(1)).all()
    assert evaluated < 0.5 * 8 * x.shape[0] * 20


def test_total_displacement_is_not_summed():
    history = np.array([[[0, 0]], [[10, 0]], [[0, 0]]])
    assert centroids.displacement(history)[:, 0].tolist() == [0, 10, 0]


def test_queries_cover_the_given_table(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [tuple(r) for r in given.collect()]
    found = repo.queries()["op11_embedding_near_dedup"](spark, sf)
    got = [tuple(r) for r in found.select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=str) == plain_near(rows)
