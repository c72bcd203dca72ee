"""N-gram Jaccard join and exact top-k search against plain versions."""

from __future__ import annotations

import random

import brute
import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strayrow.llm import jaccard, topk
from strayrow.llm.components import components
from strayrow.llm.oracles import SQL
from strayrow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, node string, id string, keys string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "n", "i", "k") for r in rows], SCHEMA)


def copies(seed=1, groups=12):
    """Texts in groups of near copies with a few changed words, some groups sharing a passage."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, rows = words(40), []
    for g in range(groups):
        base = words(rng.choice([5, 12, 30, 90, 200])) + (passage if g % 3 == 0 else [])
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def check_groups(spark, rows, size, num, den):
    got = jaccard.similar_groups(docs(spark, rows), size, (num, den)).collect()
    want = []
    for group in brute.groups(rows, size, num, den):
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            want.append((rows[i][0], len(brute.shingle_set(rows[i][1], size)), min(ids, default=None)))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    return want


@pytest.mark.parametrize("seed,size,num,den", [(1, 4, 85, 100), (2, 5, 4, 5), (3, 2, 3, 5), (4, 3, 1, 1)])
def test_groups_equal_a_plain_version(spark, seed, size, num, den):
    check_groups(spark, copies(seed), size, num, den)


def test_groups_of_odd_rows(spark):
    text = " ".join(f"t{k}" for k in range(60))
    rows = [
        (7, text), (3, text), (3, text), (None, text.upper()), (4, None), (5, ""), (6, " \n"), (None, None),
        (8, "two words"), (9, "Two\tWORDS"), (10, "two words more"), (None, "alone without an id"), (11, "x " * 30_000),
    ]
    want = check_groups(spark, rows, 4, 85, 100)
    assert (7, 57, 3) in want and (9, 1, 8) in want and (11, 1, 11) in want and (5, 0, 5) in want
    assert jaccard.similar_groups(docs(spark, [])).count() == 0


def test_links_that_only_the_second_comparison_finds(spark, monkeypatch):
    """Chains of near copies in one tile, in blocks of two nodes."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(14):
        text = list(base)
        for j in range(4 * k, 4 * k + 4):
            text[(3 * j) % 120] = f"c{k}_{j}"
        rows.append((k, " ".join(text)))
    for num in (60, 65, 70, 75, 80):
        check_groups(spark, rows, 1, num, 100)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.sampled_from([(85, 100), (4, 5), (1, 2), (19, 20)]))
def test_similar_sets_share_a_tile(seed, size, similarity):
    """The pigeonhole: sets at the threshold always have a common tile key."""
    num, den = similarity
    rng = np.random.default_rng(seed)
    bands = jaccard.Bands(num, den)
    common = rng.integers(0, 2**63, size).astype(np.uint64)
    extra = (size * den) // num - size  # the largest union with that overlap
    cut = rng.integers(0, extra + 1)
    others = rng.integers(0, 2**63, extra).astype(np.uint64)
    a, b = np.unique(np.append(common, others[:cut])), np.unique(np.append(common, others[cut:]))
    both = [int(k) for k in set(jaccard.tile_keys(a, bands).tolist()) & set(jaccard.tile_keys(b, bands).tolist())]
    assert both
    # In a band where both stand they share as many tiles as the pruning asks of either.
    band = bands.of(max(len(a), len(b)))[0]
    shared = sum(k & jaccard.BAND_MASK == band for k in both)
    for n in (len(a), len(b)):
        partner = min(bands.edges[band + 1] - 1, n * den // num)
        asked = bands.differ[band] + 1 + bands.extra[band] - (n + partner) * (den - num) // (den + num)
        assert shared >= asked


def test_least_shared_is_what_the_property_asks(spark):
    bands = jaccard.Bands(4, 5)
    rows = [(n, b) for n in (1, 7, 50, 400, 6000) for b in bands.of(n)]
    frame = spark.createDataFrame(rows, "n long, band long")
    got = frame.select("n", "band", bands.least_shared(F.col("n"), F.col("band")).alias("need")).collect()
    for n, band, need in got:
        partner = min(bands.edges[band + 1] - 1, n * 5 // 4)
        assert need == bands.differ[band] + 1 + bands.extra[band] - (n + partner) // 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=80), st.lists(st.integers(0, 300), max_size=80))
def test_bitmaps_bound_the_overlap(a, b):
    x, y = (jaccard.mixed(np.unique(np.array([0, *v], np.uint64))) for v in (a, b))
    x, y = np.sort(x), np.sort(y)
    true = len(set(x.tolist()) & set(y.tolist()))
    assert jaccard.overlap(x, y) == true
    p, q = jaccard.bitmap(x), jaccard.bitmap(y)
    size = min(len(p), len(q))
    p, q = jaccard.folded(p, size), jaccard.folded(q, size)
    assert true <= len(x) - int(np.bitwise_count(p & ~q).sum())
    assert true <= len(y) - int(np.bitwise_count(q & ~p).sum())


def test_python_holds_few_rows_at_once(spark, monkeypatch):
    """Rows with two texts' shingles come in small batches; the setting is put back."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(setting), []
    keep, pin = jaccard.Scratch.keep, jaccard.pin

    def noted(write):
        return lambda *args: (seen.append(int(spark.conf.get(setting))), write(*args))[1]

    monkeypatch.setattr(jaccard.Scratch, "keep", noted(keep))
    monkeypatch.setattr(jaccard, "pin", noted(pin))
    rows = [(k, f"one two three four five six seven eight nine {k % 3}") for k in range(12)]
    groups = jaccard.similar_groups(docs(spark, rows), 2, (1, 2))
    assert seen and set(seen) == {jaccard.BATCH_ROWS}
    assert "MapInArrow" not in groups._jdf.queryExecution().toString()
    assert spark.conf.get(setting) == before
    assert {r["component_id"] for r in groups.collect()} == {0}


def test_keep_one_of_each_group(spark):
    rows = copies(5)
    rows += [(None, rows[0][1]), (500, None), (501, ""), (rows[1][0], rows[1][1]), (rows[1][0], rows[1][1])]
    table = docs(spark, rows)
    kept = jaccard.keep_one(table)
    assert kept.schema == table.schema
    ids = [r["doc_id"] for r in kept.collect()]
    named = [r for r in dict.fromkeys(rows) if r[0] is not None]
    want = [min(named[i][0] for i in g) for g in brute.groups(named, 5, 4, 5)]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 1


def test_keep_one_without_broadcast(spark, monkeypatch):
    rows = copies(6)
    want = sorted(r["doc_id"] for r in jaccard.keep_one(docs(spark, rows)).collect())
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs(spark, rows)).collect()) == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(k, 1) for k in range(2, 40)] + [(7, 7), (500, 400), (500, 400)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 40)}, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Top-k search


def plain_top(rows, k, scale=64.0):
    sound = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in sound), default=0)
    x = np.array([[np.floor(scale * float(c)) for c in v] + [0] * (dims - len(v)) for _, v in sound]).reshape(-1, dims)
    out = []
    for q, (owner, _) in enumerate(sound):
        if owner is not None and owner % 20 == 0:
            scores = x @ x[q]
            best = sorted(
                (j for j in range(len(sound)) if j != q),
                key=lambda j: (-scores[j], sound[j][0] is not None, sound[j][0] or 0),
            )[:k]
            out += [(owner, r + 1, sound[j][0], int(scores[j])) for r, j in enumerate(best)]
    return sorted(out, key=str)


def found(spark, rows, k=3):
    frame = spark.createDataFrame([(*r, 1, "r") for r in rows], "vec_id long, embedding array<float>, label int, row string")
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k).collect()
    return sorted(map(tuple, got), key=str)


def test_top_k_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(k, [0.5] * 6) for k in (100, 101, 120, 121, 140)]  # ties
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (220, [float("inf")] * 6), (None, [9.0] * 6)]
    rows += [(240, [2.0, -1.0]), (260, []), (33, [0.1] * 6)]
    for k in (1, 3, 100):
        assert found(spark, rows, k) == plain_top(rows, k)
    assert found(spark, []) == []
    assert found(spark, [(20, [1.0])]) == []


def test_top_k_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 50)
    monkeypatch.setattr(topk, "QUERY_BUCKET", 4)
    monkeypatch.setattr(topk, "STEP", 7)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 5) / 2).astype(np.float32).tolist()) for i in range(400)]
    assert found(spark, rows, 5) == plain_top(rows, 5)


def test_repeated_query_rows_are_candidates_of_each_other(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.0])]
    assert found(spark, rows, 2) == sorted([(20, 1, 20, 4096), (20, 1, 20, 4096), (20, 2, 3, 2048), (20, 2, 3, 2048)], key=str)


def test_pivots_spare_evaluations():
    """On clustered vectors most rows are never multiplied."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16)) * 300
    data = np.floor(centers[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 16)) * 5)
    most = float((data**2).sum(1).max())
    pivots = topk.choose_pivots(topk.lifted(data[:1000], most, False), 24)
    table = topk.distances(topk.lifted(data, most, False), pivots).T.copy()
    order = np.arange(len(data))
    spared = []
    for q in range(0, 200, 10):
        asking = topk.distances(topk.lifted(data[q : q + 1], most, True), pivots)[0]
        places, scores, evaluated = topk.search(data, table, order, data[q], asking, most, q, 20)
        plain = data @ data[q]
        plain[q] = -np.inf
        assert places.tolist() == np.lexsort((order, -plain))[:20].tolist()
        assert scores.tolist() == plain[places].tolist()
        spared.append(1 - evaluated / len(data))
    assert np.mean(spared) > 0.5


@pytest.mark.parametrize("name", ["op6_ngram_jaccard", "op7_exact_top_k"])
def test_query_equals_sql(spark, sf, name):
    assert oracle.differences(QUERIES[name](spark, sf), oracle.connect(sf), SQL[name]) == []
