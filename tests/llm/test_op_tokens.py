"""Token files, packing and the SentencePiece lattice against the libraries."""

from __future__ import annotations

import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strayrow.functions.materialize import new_path
from strayrow.llm import packing, pieces, token_files
from strayrow.llm.queries import QUERIES
from strayrow.llm.tokens import PieceEncoder

ODD = [
    "", " ", "  ", "a  b", " a \n b\t\tc  ", "a\n  b", "a\n", "\na", "a\n\nb", "\n", "it's  I'll 'S don't",
    "x y 　z", "<|endoftext|> a", "é ́a Σ ΑΣ b", "\x1c \x85 a", "a \x1cb",
    "日本語 123 456", "a  b", "x\ty\n z\r\n\r\nq", "no., A.B. é.\nb", "w" * 5000, "\U0001f600 ​",
]
ROWS = [(3, "the end of the end"), (1, None), (2, ""), (None, "no id"), (2, "again the same id"), (5, "word " * 6000)]
SCHEMA = "doc_id long, text string, length string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("name,blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_the_whole(name, blanks):
    whole, own = brute.tokenizer(name), PieceEncoder(public_tokenizers.path(name), blanks)
    for _ in range(2):
        for text, got in zip(ODD, own.encode(pa.array(ODD))):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


_own = {n: PieceEncoder(public_tokenizers.path(n), b) for n, b in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t.,'sé́　日1", max_size=30))
def test_any_text_encodes_as_a_whole(text):
    for own in _own.values():
        got = np.frombuffer(next(own.encode(pa.array([text]))), "<u4").tolist()
        assert got == own.tokenizer.encode(text, add_special_tokens=False).ids


_parts = ["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "a", "b's", " ", "  ", "\n", "\t", "日", "é", ".", "\u00a0", "<|ENDOFTEXT|>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(_parts), max_size=12))
def test_special_strings_are_what_the_library_makes_of_them(parts):
    text = "".join(parts)
    for own in _own.values():
        got = np.frombuffer(next(own.encode(pa.array([text]))), "<u4").tolist()
        assert got == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_strings_by_the_contract():
    for name, ids in (("byte_bpe_50k.json", [64, 220, 50256, 275]), ("word_bpe_49k.json", [320, 49407, 321])):
        assert np.frombuffer(next(_own[name].encode(pa.array(["a <|endoftext|> b"]))), "<u4").tolist() == ids


def test_a_full_memory_forgets(monkeypatch):
    monkeypatch.setattr("strayrow.llm.tokens.REMEMBERED", 10)
    own = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = [" ".join(f"w{k}x{j}" for j in range(7)) for k in range(30)]
    for text in texts + texts[:3]:
        got = np.frombuffer(next(own.encode(pa.array([text]))), "<u4").tolist()
        assert got == own.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own.memory.pieces) <= 10


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [2, 3, 100, 50257, 2**31, 2**59])
def test_segments_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n, dtype=np.uint64)
    assert (token_files.decode_segment(token_files.encode_segment(ids)) == ids).all()


def test_wide_ids_escape_and_wider_fail():
    ids = np.array([2**60 - 1, 0, 1, 2**30, 2**30 - 1], np.uint64)
    assert (token_files.decode_segment(token_files.encode_segment(ids)) == ids).all()
    with pytest.raises(ValueError):
        token_files.encode_segment(np.array([2**60], np.uint64))
    with pytest.raises(ValueError):
        token_files.decode_segment(b"x" * 100)


def test_small_ids_pack_densely():
    assert len(token_files.encode_segment(np.ones(512 * 100, np.uint64))) < 512 * 100 / 4


def test_token_files_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_DOCS", 2)
    path = new_path(spark, "t")
    token_files.write_tokens(frame(spark, ROWS), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    t = brute.tokenizer("byte_bpe_50k.json")
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 3, 5]
    start = 0
    texts = {(k, brute.ids_with_end(t, x).tobytes()) for k, x in ROWS}
    for r in rows:
        assert (r["doc_id"], bytes(r["ids"])) in texts
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]) // 4)
        start += r["n_tokens"]


def test_token_files_of_nothing(spark):
    path = new_path(spark, "t")
    token_files.write_tokens(frame(spark, []), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_tokens(spark, path).count() == 0


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_token_file_query(spark, sf):
    t, start, want = brute.tokenizer("byte_bpe_50k.json"), 0, []
    for owner, text in sorted(documents(spark, sf)):
        ids = brute.ids_with_end(t, text)
        want.append((owner, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op2_token_files"](spark, sf).collect()) == want


def test_packing_query(spark, sf):
    rows = QUERIES["op9_best_fit_packing"](spark, sf).collect()
    want = brute.pieces(brute.tokenizer("word_bpe_49k.json"), documents(spark, sf))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    used = brute.check_packing((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert used <= 1.03 * sum(r["length"] for r in rows) / 2048 + 2


def test_packing_of_odd_rows(spark):
    cut = packing.cut_pieces(frame(spark, ROWS), public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_pieces(cut).collect()
    want = brute.pieces(brute.tokenizer("word_bpe_49k.json"), ROWS)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], brute.crc(np.frombuffer(r["ids"], "<u4"))) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert brute.check_packing((r["sequence_id"], r["offset"], r["length"]) for r in rows) == 3  # 6,000 ids and a few


def test_packing_in_many_shards(spark):
    sizes = spark.range(4000).select(
        F.col("id").alias("row"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length")
    )
    rows = packing.pack_pieces(sizes, 1000, shard=256).collect()
    assert len(rows) == 4000
    used = brute.check_packing(((r["sequence_id"], r["offset"], r["length"]) for r in rows), 1000)
    assert used <= 1.02 * sum(r["length"] for r in rows) / 1000 + 1


def test_packing_of_nothing_and_of_full_pieces(spark):
    cut = packing.cut_pieces(frame(spark, []), public_tokenizers.path("word_bpe_49k.json"))
    assert packing.pack_pieces(cut).count() == 0
    full = spark.createDataFrame([(0, 8), (7, 8)], "row long, length long")
    assert len({r["sequence_id"] for r in packing.pack_pieces(full, 8).collect()}) == 2


def test_sum_of_squares_choice():
    """Two gaps fit: the one whose count of open sequences shrinks the sum most is taken."""
    sizes = np.array([6, 6, 7, 3])  # gaps 4, 4, 3; then 3 fits all
    sequence, offset, gaps = packing.place(sizes, 10)
    assert sequence.tolist() == [0, 1, 2, 1] and gaps.tolist() == [4, 1, 3] and offset[3] == 6


# The SentencePiece lattice


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable.from_model(public_tokenizers.path("piece_bpe_32k.model"))


def plain_ids(table, text):
    known = dict(zip(table.pieces, zip(table.ids, table.scores)))
    marked = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    return [
        i
        for unit in re.findall(f"{pieces.SPACE}+[^{pieces.SPACE}\n]*|[^{pieces.SPACE}\n]+|\n", marked)
        for i in pieces.viterbi(unit, known, table.longest, table.unknown_score, table.byte_ids)
    ]


def test_lattice_query(spark, sf, table):
    got = {r["doc_id"]: r for r in QUERIES["op4_sentencepiece"](spark, sf).collect()}
    rows = documents(spark, sf)
    assert len(got) == len(rows)
    for owner, text in rows:
        r, ids = got[owner], np.array(plain_ids(table, text), "<u4")
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), brute.crc(ids))
        assert (r["n_chars"], r["text_crc32"]) == (len(text), zlib.crc32(text.encode()))


def test_lattice_equals_the_library(table):
    """The library runs the same table as a unigram model; a few pieces have scores beyond what
    its single precision can add, so they get the next lower score in both."""
    from sentencepiece import sentencepiece_model_pb2

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = pieces.PieceTable(table.pieces, table.ids, tuple(max(s, -40_000.0) for s in table.scores), table.byte_ids)
    for text in ["the hested", "Hello  world\nfoo é\U0001f600", " lead", "tail ", "don't ².", "a\n\nb", "x\ty", "日本語"]:
        assert plain_ids(own, text) == library.encode(text)
        assert library.decode(plain_ids(own, text)) == text


def test_lattice_of_odd_rows(spark, table):
    texts = [t for t in ODD if "▁" not in t] + [None, "same", "same", "q" * 300, "☃" * 60]
    docs = spark.createDataFrame(
        [(k if k else None, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, unit string, ids string"
    )
    encoded = pieces.encode_pieces(docs, table)
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in encoded.collect()}
    decoded = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(encoded, table).collect()}
    for k, text in enumerate(texts):
        assert ids[k or None] == plain_ids(table, text or ""), text
        assert decoded[k or None] == (text or "")


def test_lattice_in_many_partitions_and_batches(spark, table):
    rows = [(k, f"text {k % 7} the end of it, {k}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    docs = spark.read.parquet(write(spark, docs))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = pieces.encode_pieces(docs, table).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 90
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain_ids(table, dict(rows)[r["doc_id"]])
        assert r["n_pieces"] == len(r["ids"]) // 4


def test_blocks_of_texts_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 4_000)
    monkeypatch.setattr(pieces, "SLICE", 1_000)
    texts = [f"text {k} of many, " * (k % 9) for k in range(400)] + [None, "long " * 3_000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    blocks = list(pieces._blocks(iter([batch.slice(0, 150), batch.slice(150)]), True, 3))
    assert [number for number, _ in blocks] == [(3 << 32) + k for k in range(len(blocks))]
    at = 0
    for _, block in blocks:
        owners = pa.concat_arrays(block.owners).to_pylist()
        own = [texts[k] or "" for k in owners]
        assert sum(map(len, own)) <= 10_000 or max(map(len, own)) > 10_000
        ends = np.cumsum(block.sizes).tolist()
        for owner, text, size, end in zip(owners, own, block.sizes.tolist(), ends):
            assert owner == at
            units = block.units.take(pa.array(block.codes[end - size : end])).to_pylist()
            assert "".join(units) == (pieces.SPACE + text.replace(" ", pieces.SPACE) if text else "")
            at += 1
    assert at == len(texts) and len(blocks) > 5


def test_lattices_folded_in_parts(spark, table, monkeypatch):
    words = ["", "▁the", "▁hested", "q" * 90, "é☃x", "\U0001f600", "ab" * 20, *(f"▁un{k}like" for k in range(50))]
    units = spark.createDataFrame([(w, [k]) for k, w in enumerate(words)], "unit string, places array<int>").coalesce(1)
    rows = pieces.lattices(units, table, "places").toArrow()
    known = dict(zip(table.pieces, zip(table.ids, table.scores)))
    for edges in (1, 40, 10_000):
        monkeypatch.setattr(pieces, "EDGES", edges)
        got = {}
        for found, counts, flat, places in pieces._Fold(table).run(iter(rows.to_batches(max_chunksize=7))):
            ids = np.split(flat, np.cumsum(counts)[:-1])
            got |= {u: (i.tolist(), p) for u, i, p in zip(found.to_pylist(), ids, places.to_pylist())}
        for k, w in enumerate(words):
            assert got[w] == (pieces.viterbi(w, known, table.longest, table.unknown_score, table.byte_ids), [k])


def test_lattice_refuses_an_input_that_changes(spark, table):
    from pyspark.sql.functions import col, concat, lit, rand

    docs = spark.range(40).select(col("id").alias("doc_id"), concat(lit("some text "), (rand() * 1e6).cast("int")).alias("text"))
    changing = docs.mapInArrow(lambda batches: (b.take(np.random.permutation(len(b))[: len(b) // 2]) for b in batches), docs.schema)
    with pytest.raises(Exception, match="changed between two reads"):
        pieces.encode_pieces(changing, table).collect()


def write(spark, docs):
    path = new_path(spark, "docs")
    docs.write.parquet(path)
    return path


def test_lattice_of_nothing(spark, table):
    docs = spark.createDataFrame([], "doc_id long, text string")
    encoded = pieces.encode_pieces(docs, table)
    assert encoded.count() == 0 and pieces.decode_pieces(encoded, table).count() == 0


def test_pieces_that_units_would_cut(table):
    with pytest.raises(ValueError):
        pieces.PieceTable(("a▁b",), (1,), (0.0,), table.byte_ids).fine
    assert table.fine
    mixed = pieces.PieceTable(("a.", "a", "b", ".", "▁"), (1, 2, 3, 4, 5), (-1.0, -3.0, -1.0, -3.0, -1.0), table.byte_ids)
    assert not mixed.fine


def test_lattice_with_a_piece_across_letters_and_marks(spark, table):
    mixed = pieces.PieceTable(("a.", "a", "b", ".", "▁"), (1, 2, 3, 4, 5), (-1.0, -3.0, -1.0, -3.0, -1.0), table.byte_ids)
    docs = spark.createDataFrame([(1, "a.b a b.")], "doc_id long, text string")
    (row,) = pieces.encode_pieces(docs, mixed).collect()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [5, 1, 3, 5, 2, 5, 3, 4]
