"""Pack tokenized documents into sequences of a fixed length by the sum-of-squares rule.

A document's ids are cut into pieces only where it is longer than a sequence. A full piece is a
sequence of its own. The others are placed longest first: each goes where the sum, over all
residual gaps, of the squared number of open sequences with that gap becomes smallest; a new
sequence is one of the choices.

The rule needs only the open sequences, so it runs in shards of bounded size that are dealt out by
a hash. Sequences that a shard could not fill (but for 1/128) give their pieces back; these are few, and are packed
again, first in the shard and then in fewer shards, until one shard holds them all. Every round
leaves far fewer pieces.

Edge cases: a null or empty text is the end id alone; repeated rows, equal or null ids are packed
one by one (rows are told apart by a number given when the pieces are written); an empty table
gives an empty table; other columns are ignored. One document's ids must fit into a task's memory.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.functions.materialize import pin, pin_table
from strayrow.llm.tokens import encoder

SHARD = 16_384
#: A sequence counts as filled when its gap is at most this part of it.
NEARLY = 128


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    end_id: int = 0,
    blanks_count: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of at most ``length`` ids: id, ``piece``, ``start``, ``length``, ``ids`` and ``row``.

    ``ids`` holds little-endian unsigned 32-bit integers. ``row`` numbers the pieces; the table is
    written to the shared folder so that the numbers stay.
    """
    end = array("I", [end_id]).tobytes()
    step = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer, blanks_count)
        for batch in batches:
            owners, pieces, ids = [], [], []

            def flush():
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                numbers = np.array(pieces, np.int64)
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owners, pa.int64())),
                        pa.array(numbers, pa.int32()),
                        pa.array(numbers * length, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=[id_col, "piece", "start", "length", "ids"],
                )

            held = 0
            for k, got in enumerate(known.encode(batch.column(1))):
                got += end
                for n, at in enumerate(range(0, len(got), step)):
                    owners.append(k)
                    pieces.append(n)
                    ids.append(got[at : at + step])
                held += len(got)
                if held > 1 << 22:
                    yield flush()
                    owners, pieces, ids, held = [], [], [], 0
            if owners:
                yield flush()

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = f"`{id_col}` {slim.dtypes[0][1]}, piece int, start long, length long, ids binary"
    cut = slim.mapInArrow(run, schema)
    return pin_table(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")


def place(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in the given order, and the final gap by sequence.

    Moving a sequence from gap g to gap h changes the sum of squares by
    (2 N[h] + 1) - (2 N[g] - 1) if h > 0, by -(2 N[g] - 1) if it is full; a new one adds
    2 N[h] + 1. Ties go to the smallest gap, an open sequence before a new one.
    """
    counts = np.zeros(length + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    gaps: list[int] = []
    for i, size in enumerate(sizes.tolist()):
        change = 2 - 2 * counts[size:length]
        change[1:] += 2 * counts[1 : length - size]
        if len(change):
            change[0] -= 1
        change[counts[size:length] == 0] = np.iinfo(np.int64).max
        new = 2 * counts[length - size] + 1
        k = int(change.argmin()) if len(change) else 0
        if len(change) and change[k] <= new:
            gap = size + k
            chosen = open_by_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, chosen = length, len(gaps)
            gaps.append(length)
        sequence[i], offset[i] = chosen, length - gap
        gaps[chosen] = gap - size
        if gap > size:
            open_by_gap[gap - size].append(chosen)
            counts[gap - size] += 1
    return sequence, offset, np.array(gaps, np.int64)


def place_again(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place; then the pieces of sequences with a gap once more, while that fills any."""
    sequence, offset, gaps = place(sizes, length)
    while True:
        left = np.flatnonzero(gaps[sequence] > 0)
        again, places, new_gaps = place(sizes[left], length)
        filled, before = int((new_gaps == 0).sum()), int((gaps > 0).sum())
        if not filled or len(new_gaps) > before:
            return sequence, offset, gaps
        sequence[left], offset[left] = again + len(gaps), places
        gaps = np.concatenate([gaps, new_gaps])


def _pack_round(pool: DataFrame, shards: int, number: int, length: int) -> DataFrame:
    """Place the pool's pieces shard by shard: row, length, sequence_id, offset, open."""

    def pack(shard: int, rows: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        sequence, offset, gaps = place_again(sizes, length)
        # Odd numbers; a full piece has an even one.
        ids = (((number << 30) + shard << 24) + sequence) * 2 + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(sizes), pa.array(ids), pa.array(offset), pa.array(gaps[sequence] > length // NEARLY)],
            names=["row", "length", "sequence_id", "offset", "open"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current = None
        for batch in batches:
            shard, rows, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for a, b in _runs(shard):
                if held and shard[a] != current:
                    yield pack(current, *(np.concatenate(x) for x in zip(*held)))
                    held = []
                current = int(shard[a])
                held.append((rows[a:b], sizes[a:b]))
        if held:
            yield pack(current, *(np.concatenate(x) for x in zip(*held)))

    dealt = pool.select(
        F.pmod(F.xxhash64("row", F.lit(number)), F.lit(shards)).alias("shard"), "row", "length"
    )
    ordered = dealt.repartitionByRange(shards, "shard").sortWithinPartitions(
        "shard", F.desc("length"), "row"
    )
    return ordered.mapInArrow(
        run, "row long, length long, sequence_id long, offset long, open boolean"
    )


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(keys):
        return []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]))


def pack_pieces(pieces: DataFrame, length: int = 2048, shard: int = SHARD) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a unique ``row`` and a ``length``."""
    pool = pieces.where(F.col("length") < length).select("row", "length")
    settled = []
    number = 0
    size = pool.count()
    while size:
        number += 1
        shards = -(-size // shard)
        placed = pin(_pack_round(pool, shards, number, length))
        if shards == 1:
            settled.append(placed)
            break
        settled.append(placed.where(~F.col("open")))
        pool = placed.where("open").select("row", "length")
        left = pool.count()
        if 4 * left > 3 * size:  # hardly any sequence was filled: another round would not help
            settled[-1] = placed
            break
        size = left
    full = (F.col("row") * 2).alias("sequence_id")
    if not settled:
        return pieces.select("*", full, F.lit(0).cast("long").alias("offset"))
    places = settled[0]
    for more in settled[1:]:
        places = places.unionByName(more)
    places = places.select(F.col("row").alias("_row"), F.col("sequence_id").alias("_s"), F.col("offset").alias("_o"))
    joined = pieces.join(places, F.col("row") == F.col("_row"), "left")
    return joined.select(
        *[pieces[c] for c in pieces.columns],
        F.coalesce("_s", F.col("row") * 2).alias("sequence_id"),
        F.coalesce("_o", F.lit(0).cast("long")).alias("offset"),
    )
