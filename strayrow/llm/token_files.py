"""Token ids in files, packed into 64-bit words by Simple-8b.

A word holds a 4-bit selector and 60 bits of payload: selector k of ``COUNTS`` packs that many ids
of equal width, the largest count that fits; an id wider than 30 bits escapes to a word of its
own. Ids are packed in blocks of ``BLOCK``, each starting at a new word whose number is kept, so
that blocks are decoded side by side by array operations.

A dataset is a folder that Spark writes and commits task by task: each row is a segment of whole
documents in ascending order of their id, with ids, lengths and the packed bytes
(``encode_segment``). ``part`` and ``segment`` give the order of the segments.

Edge cases: a null text counts as empty; rows without an id come first; rows with equal ids stand
in the order of their texts' hashes; an empty table gives an empty dataset; other columns are
ignored. One document must fit into a task's memory; nothing is cut or dropped.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.llm.tokens import encoder

#: Ids in a word and bits of each, by selector; selector 0 is the escape.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BITS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BLOCK = 512
SEGMENT_IDS = 1 << 20
SEGMENT_DOCS = 1 << 12
_HEAD = struct.Struct("<4sIQQ")
_MAGIC = b"S8B1"


def _fitting(widths: np.ndarray) -> np.ndarray:
    """For each place of each block the selector that packs most ids from there on."""
    most = {1: widths}

    def window(size: int) -> np.ndarray:
        """Greatest width among the next ``size`` ids; beyond the end there is padding."""
        if size not in most:
            half = max(s for s in most if s <= size)
            best, shift = most[half].copy(), size - half
            part = min(s for s in most if s >= shift)
            shift = size - part
            best[:, : widths.shape[1] - shift] = np.maximum(best[:, : widths.shape[1] - shift], most[part][:, shift:])
            most[size] = best
        return most[size]

    chosen = np.zeros(widths.shape, np.uint8)
    for k, (size, bits) in enumerate(zip(COUNTS, BITS)):
        fits = window(int(size)) <= bits
        if k and not fits.any():
            break
        np.copyto(chosen, np.uint8(k), where=fits)
    return chosen


def _width(values: np.ndarray) -> np.ndarray:
    """The least payload width that holds each value; 0 for 0."""
    needed = np.zeros(61, np.uint8)
    for bits in BITS:  # from wide to narrow
        needed[1 : bits + 1] = bits
    small = needed[[int(v).bit_length() for v in range(1 << 16)]]
    if not values.size or int(values.max()) < 1 << 16:
        return small[values.astype(np.uint16)]
    return needed[np.minimum(np.frexp(values.astype(np.float64))[1], 60)]


def encode_segment(ids: np.ndarray) -> bytes:
    """Pack ids (below 2^60) into words; see ``decode_segment``."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.zeros((blocks, BLOCK + 60), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    values[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    if n and int(flat.max()) >> 60:
        raise ValueError("ids must be below 2^60")
    widths = _width(values)
    chosen = _fitting(widths)
    sizes = np.full(blocks, BLOCK)
    if blocks:
        sizes[-1] = n - (blocks - 1) * BLOCK
    rows, places = np.arange(blocks), np.zeros(blocks, np.int64)
    steps = []
    while len(rows):
        selectors = chosen[rows, places]
        steps.append((rows, places, selectors))
        places = places + COUNTS[selectors]
        more = places < sizes[rows]
        rows, places = rows[more], places[more]
    if steps:
        rows, places, selectors = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(rows, kind="stable")
        rows, places, selectors = rows[order], places[order], selectors[order]
    else:
        selectors = np.zeros(0, np.uint8)
    words = selectors.astype(np.uint64) << np.uint64(60)
    line = values.ravel()
    for k in np.unique(selectors):
        here = np.flatnonzero(selectors == k)
        at = rows[here] * values.shape[1] + places[here]
        payload = line.take(at)
        for j in range(1, COUNTS[k]):
            payload |= line.take(at + j) << np.uint64(j * BITS[k])
        words[here] |= payload
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=blocks))]) if n else np.zeros(1)
    return _HEAD.pack(_MAGIC, BLOCK, n, len(words)) + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; all blocks are decoded together."""
    magic, block, n, n_words = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a token segment")
    blocks = -(-n // block)
    offsets = np.frombuffer(data, "<u4", blocks + 1, _HEAD.size).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, _HEAD.size + 4 * (blocks + 1))
    selectors = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[selectors]
    before = np.concatenate([[0], np.cumsum(held)])
    owner = np.repeat(np.arange(blocks), np.diff(offsets))
    starts = before[:-1] - before[offsets[:-1]][owner] + owner * block
    ends = np.minimum((owner + 1) * block, n)
    ids = np.zeros(n, np.uint64)
    for k in np.unique(selectors):
        here = np.flatnonzero(selectors == k)
        mask = (np.uint64(1) << np.uint64(BITS[k])) - np.uint64(1)
        for j in range(COUNTS[k]):
            inside = here[starts[here] + j < ends[here]]
            ids[starts[inside] + j] = (words[inside] >> np.uint64(j * BITS[k])) & mask
    return ids


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    blanks_count: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending order of the id.

    The rows are dealt out by ranges of the id, with as many partitions as the session has for
    shuffles; each task writes its own range.
    """
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer, blanks_count)
        part = TaskContext.get().partitionId()
        segment, before, held = 0, 0, 0
        owners: list[pa.Scalar] = []
        pieces: list[bytes] = []

        def flush() -> pa.RecordBatch:
            lengths = [len(p) // 4 for p in pieces]
            data = encode_segment(np.frombuffer(b"".join(pieces), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([sum(lengths)], pa.int64()),
                    pa.array([owners], pa.list_(kind)),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([data], pa.binary()),
                ],
                names=["part", "segment", "before", "n_ids", "doc_ids", "lengths", "data"],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for owner, ids in zip(batch.column(0).to_pylist(), known.encode(batch.column(1))):
                owners.append(owner)
                pieces.append(ids + end)
                held += len(pieces[-1]) // 4
                if held >= SEGMENT_IDS or len(owners) >= SEGMENT_DOCS:
                    yield flush()
                    segment, before, held = segment + 1, before + held, 0
                    owners, pieces = [], []
        if owners:
            yield flush()

    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = slim.repartitionByRange(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "id", tie
    ).sortWithinPartitions("id", tie)
    kind = slim.dtypes[0][1]
    schema = (
        f"part int, segment int, before long, n_ids long, doc_ids array<{kind}>, "
        "lengths array<long>, data binary"
    )
    dealt.mapInArrow(run, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``
    (little-endian unsigned 32-bit integers in a row)."""
    segments = spark.read.parquet(path)
    kind = dict(segments.dtypes)["doc_ids"].removeprefix("array<")[:-1]
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one per partition
    sizes = {r["part"]: r["n"] for r in totals}
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = spark.createDataFrame(starts, "part int, part_start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner_type = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                ids = decode_segment(row["data"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], owner_type),
                        pa.array(starts + row["part_start"] + row["before"], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    names=[id_col, "start", "n_tokens", "ids"],
                )

    placed = segments.join(F.broadcast(offsets), "part").select(
        "part_start", "before", "doc_ids", "lengths", "data"
    )
    return placed.mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")
