"""The corpus pipeline stage by stage against plain versions."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest

from strayrow.functions.materialize import new_path
from strayrow.llm import quality
from strayrow.llm.line_dedup import LEAST, RATIO


@pytest.fixture(scope="module")
def stages(spark):
    """The input and every stage's rows, each stage run on what its predecessor wrote."""
    sf = "/root/testdata/sf0.001"
    frames = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, frames[-1], sf).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return [sorted(f.collect(), key=lambda r: r["doc_id"]) for f in frames], frames


def test_stages_and_columns(stages):
    _, frames = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "best_fit_packing"]
    for frame in frames[1:-1]:
        assert frame.dtypes == frames[0].dtypes


def test_quality_stage(stages):
    (before, after, *_), _ = stages
    kept = [r for r in before if quality.rejecting(quality.Features((r["text"] or "").encode()), quality.RULES) is None]
    assert after == kept and 0 < len(kept) < len(before)


def test_line_stage(stages):
    (_, before, after, *_), _ = stages
    want = brute.without_boilerplate([(r["source"], r["text"]) for r in before], RATIO, LEAST)
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in after] == [
        (r["doc_id"], t, len(t)) for r, t in zip(before, want)
    ]
    assert any(a["text"] != b["text"] for a, b in zip(before, after))


def test_duplicate_stage(stages):
    (_, _, before, after, _), _ = stages
    rows = [(r["doc_id"], r["text"]) for r in before]
    firsts = sorted(min(rows[i][0] for i in g) for g in brute.groups(rows, 5, 4, 5))
    assert after == [r for r in before if r["doc_id"] in set(firsts)]
    assert len(after) < len(before)


def test_packing_stage(stages):
    (_, _, _, before, after), _ = stages
    want = brute.pieces(brute.tokenizer("word_bpe_49k.json"), [(r["doc_id"], r["text"]) for r in before])
    assert sorted(tuple(r)[:5] for r in after) == sorted(want)
    brute.check_packing((r["sequence_id"], r["offset"], r["length"]) for r in after)


def test_run(spark, stages):
    frames, _ = stages
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(tuple(r)[:5] for r in frames[-1])


def test_stages_on_odd_rows(spark):
    prose = " ".join(f"word{k} and other{k}" for k in range(60))
    rows = [(1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (None, prose, None, None, None), (2, None, "en", "s", 0), (3, "", "en", None, 0)]
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            path = new_path(spark, name)
            stage(spark, docs, "").write.parquet(path)
            result = spark.read.parquet(path)
            if name != "best_fit_packing":
                assert result.dtypes == docs.dtypes


def test_one_of_many_edited_copies_stays_whole(spark):
    lines = [" ".join(f"w{k}x{j}" for j in range(8)) for k in range(20)]
    texts = ["\n".join([*lines[:k], lines[k] + f" edit{k}", *lines[k + 1 :]]) for k in range(12)]
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    cleaned = corpus_pipeline.line_dedup_by_source(spark, spark.createDataFrame(rows, schema), "")
    kept = corpus_pipeline.near_duplicates(spark, cleaned, "").collect()
    assert [r["text"] for r in kept] == texts[:1]
