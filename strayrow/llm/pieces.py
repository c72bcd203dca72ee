"""SentencePiece encoding and decoding: the best segmentation by piece scores, as a relational lattice.

The piece table (piece, id, score) is a DataFrame. Texts are written as SentencePiece writes them
(blank as U+2581, one before the text) and cut where no piece can reach across: before a blank that
follows another character, around line ends and, if no piece mixes them, between letters and other
characters. Every distinct unit is segmented once: all its substrings up to the longest piece are
exploded and joined to the piece table; the matches are the edges of the unit's lattice; they are
sorted by unit and folded from left to right (Viterbi), the edges to one place in all units of a batch
at once, keeping for each place the best score and its last piece. Of equal scores the one with the longer last piece wins.
A character without a piece is an edge at a penalty and becomes the pieces of its UTF-8 bytes.

Texts do not travel. A task turns the texts of its partition, in blocks of bounded bytes, into numbers
of the block's distinct units, by rank of their frequency; the units are grouped with the list of the
blocks that hold them, segmented once, and sent back packed by block, to meet the compressed numbers
(made again from the input) of the block. So the input must give equal partitions each time (files do;
write other inputs first); a checksum of every block's units is compared, and a difference is an error.
A unit's list has one entry for each block at most.

A model of either kind gives the piece table. The scores of a byte-pair model are ranks; the result
is then the segmentation with the best sum of scores, as the library gives for the same table as a
unigram model, not the order of merges of the byte-pair encoder.

Edge cases: a null or empty text has no pieces and decodes to the empty text; units longer than
``LONGEST`` characters are segmented by the same rule in Python; U+2581 in a text decodes to a
blank, as with the library; repeated rows are encoded one by one; rows without an id stay; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.llm.texts import give_back, raw
from strayrow.llm.tokens import gather

SPACE = "▁"
LONGEST = 48
PENALTY = 10.0
#: Bytes of text in a block, which has its own numbers of units, and in what is cut into units at once.
BLOCK = 16 << 20
SLICE = 4 << 20
#: Edges that are folded at once, about.
EDGES = 250_000
#: Rows whose ids or texts are made at once.
ROWS = 500

_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PURE = re.compile(f"{SPACE}*[{_LETTER}]*|[^{_LETTER}]*")


@dataclass(frozen=True)
class PieceTable:
    """Pieces with ids and scores, and the ids that stand for the 256 byte values."""

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]

    @classmethod
    def from_model(cls, path: str) -> PieceTable:
        """The ordinary pieces of a SentencePiece model with byte fallback."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        return cls(
            tuple(model.id_to_piece(i) for i in usual),
            tuple(usual),
            tuple(float(model.get_score(i)) for i in usual),
            tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256)),
        )

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def unknown_score(self) -> float:
        return min(self.scores, default=0.0) - PENALTY

    @property
    def fine(self) -> bool:
        """Whether no piece mixes letters with other characters, so that units may end between."""
        for p in self.pieces:
            if "\n" in p or " " in p or SPACE in p.lstrip(SPACE):
                raise ValueError(f"units could be cut inside the piece {p!r}")
        return all(map(_PURE.fullmatch, self.pieces))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.pieces, self.ids, self.scores))
        return spark.createDataFrame(rows, "piece string, piece_id int, score double")


def viterbi(unit: str, table: dict[str, tuple[int, float]], longest: int, unknown: float, byte_ids) -> list[int]:
    """The fold of the lattice in plain Python, for units too long to explode."""
    best = [0.0] + [-np.inf] * len(unit)
    last: list[tuple[int, int]] = [(0, -1)] * (len(unit) + 1)
    for start in range(len(unit)):
        for end in range(start + 1, min(len(unit), start + longest) + 1):
            known = table.get(unit[start:end])
            if known is None and end > start + 1:
                continue
            number, score = known or (-1, unknown)
            if best[start] + score > best[end]:
                best[end], last[end] = best[start] + score, (start, number)
    ids: list[list[int]] = []
    at = len(unit)
    while at:
        start, number = last[at]
        ids.append([number] if number >= 0 else [byte_ids[b] for b in unit[start:at].encode()])
        at = start
    return [i for part in reversed(ids) for i in part]


def lattices(units: DataFrame, table: PieceTable, keep: str) -> DataFrame:
    """The edges of every distinct unit's lattice: ``number`` of the unit, ``edge``, and with one row of
    each unit ``unit`` and the column ``keep``. Rows of a unit are in one partition, one after the other
    and by edge. Units without a lattice (empty or too long) have a row without an edge."""
    # The piece table is bounded by the model, so it may be broadcast.
    pieces = F.broadcast(table.frame(units.sparkSession))
    n, start, size = F.length("unit"), F.col("start"), F.col("size")
    none = F.array(F.lit(0))
    sizes = F.sequence(F.lit(1), F.least(F.lit(table.longest), n - start + 1))
    carrier = (start <= 1) & (size <= 1)  # the edge of the first character, or the row without one
    substrings = (
        units.select("unit", keep, F.monotonically_increasing_id().alias("number"))
        .withColumn(
            "start", F.explode(F.when(n.between(1, LONGEST), F.sequence(F.lit(1), n)).otherwise(none))
        )
        .select(
            "number", "unit", F.when(start <= 1, F.col(keep)).alias(keep), "start",
            F.explode(F.when(start > 0, sizes).otherwise(none)).alias("size"),
        )
        .select(
            "number", "start", "size", F.substring("unit", start, size).alias("piece"),
            F.when(carrier, F.col("unit")).alias("unit"), F.when(carrier, F.col(keep)).alias(keep),
        )
    )
    # An edge is one number: end, start, and id + 1 (0 for a character without a piece).
    edge = (
        F.shiftleft((start + size - 1).cast("long"), 40)
        + F.shiftleft((start - 1).cast("long"), 24)
        + F.coalesce(F.col("piece_id") + 1, F.lit(0))
    )
    return (
        substrings.join(pieces, "piece", "left")
        .where(F.col("piece_id").isNotNull() | (size <= 1))
        .select("number", F.when(start > 0, edge).alias("edge"), "unit", keep)
        .sortWithinPartitions("number", "edge")
    )


class _Fold:
    """Folds the lattices of many units at once, from left to right (Viterbi)."""

    def __init__(self, table: PieceTable):
        self.longest, self.unknown, self.byte_ids = table.longest, table.unknown_score, table.byte_ids
        self.known = dict(zip(table.pieces, zip(table.ids, table.scores)))
        self.scores = np.full(max(table.ids, default=0) + 2, table.unknown_score)
        self.scores[np.array(table.ids, np.int64) + 1] = table.scores

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
        """Of the rows of ``lattices``: units, their numbers of ids, the ids, and what is kept."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < EDGES:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            number = whole["number"].to_numpy()
            cut = int(np.searchsorted(number, number[-1]))  # the last unit may go on
            if cut:
                yield self._folded(whole.slice(0, cut))
            held, rows = whole.slice(cut).to_batches(), len(whole) - cut
        if rows:
            yield self._folded(pa.Table.from_batches(held).combine_chunks())

    def _folded(self, rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
        number = rows["number"].to_numpy()
        carriers = rows.filter(pc.is_valid(rows["unit"])).combine_chunks()
        if not np.array_equal(carriers["number"].to_numpy(), np.unique(number)):
            raise RuntimeError("the rows of a unit are not together")
        units, kept = (carriers[c].combine_chunks() for c in (2, 3))
        real = pc.is_valid(rows["edge"]).to_numpy()
        edge = rows["edge"].drop_null().to_numpy()
        of = np.cumsum(np.diff(number, prepend=number[0]) > 0)[real]
        place, last = self._paths(len(units), of, edge)
        ids = last["number"] - 1
        widths = np.ones(len(ids), np.int64)
        spelled = []
        for k in np.flatnonzero(ids < 0).tolist():
            character = units[int(place[k])].as_py()[last["start"][k]]
            spelled.append((k, [self.byte_ids[b] for b in character.encode()]))
            widths[k] = len(spelled[-1][1])
        flat, ends = np.repeat(ids, widths), np.cumsum(widths)
        for k, bytes_of in spelled:
            flat[ends[k] - widths[k] : ends[k]] = bytes_of
        counts = np.bincount(place, widths, minlength=len(units)).astype(np.int64)
        bare = np.flatnonzero(np.bincount(of, minlength=len(units)) == 0)
        if len(bare):
            return units, *self._with_bare(units, bare, counts, flat), kept
        return units, counts, flat, kept

    def _paths(self, n: int, of: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit, and number and start of each edge on the best paths, by unit and place."""
        end, start = edge >> 40, (edge >> 24) & 0xFFFF
        order = np.argsort(end.astype(np.uint8), kind="stable")
        of, end, start, number = (x[order] for x in (of, end, start, edge & 0xFFFFFF))
        most = int(end[-1]) if len(end) else 0
        best = np.zeros((most + 1, n))
        last = np.zeros((most + 1, n), [("number", np.int64), ("start", np.int64)])
        at = np.zeros(n, np.int64)
        cuts = np.searchsorted(end, np.arange(1, most + 2))
        for p, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
            owner, score = of[a:b], best[start[a:b], of[a:b]] + self.scores[number[a:b]]
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            top = np.maximum.reduceat(score, firsts)
            # Of equal scores the first, which starts first.
            equal = np.flatnonzero(score == np.repeat(top, np.diff(firsts, append=b - a)))
            chosen = equal[np.flatnonzero(np.diff(owner[equal], prepend=-1))]
            mine = owner[chosen]
            best[p, mine], at[mine] = score[chosen], p
            last["number"][p, mine], last["start"][p, mine] = number[a:b][chosen], start[a:b][chosen]
        owners, steps = [np.zeros(0, np.int64)], [np.zeros(0, last.dtype)]
        going = np.flatnonzero(at)
        while len(going):
            step = last[at[going], going]
            owners.append(going)
            steps.append(step)
            at[going] = step["start"]
            going = going[step["start"] > 0]
        # The path was followed from its end.
        owner, step = np.concatenate(owners[::-1]), np.concatenate(steps[::-1])
        order = np.argsort(owner, kind="stable")
        return owner[order], step[order]

    def _with_bare(self, units: pa.Array, bare, counts, flat) -> tuple[np.ndarray, np.ndarray]:
        """Adds the ids of the units without a lattice."""
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for k in bare.tolist():
            found = viterbi(units[k].as_py(), self.known, self.longest, self.unknown, self.byte_ids)
            parts[k], counts[k] = np.array(found, np.int64), len(found)
        return counts, np.concatenate(parts)


def _units(texts: pa.Array, fine: bool) -> pa.ListArray:
    """Every text's units; a line end is one of its own. A blank belongs to the unit after it."""
    odd = pc.match_substring_regex(texts, f"  |^ |{SPACE}")
    if pc.any(odd).as_py():  # a blank that follows a blank does not begin a unit
        marked = pc.binary_join_element_wise("", pc.replace_substring(texts, " ", SPACE), SPACE)
        spaced = pc.replace_substring_regex(marked, f"([^{SPACE}]){SPACE}", f"\\1 {SPACE}")
    else:
        spaced = pc.binary_join_element_wise("", pc.replace_substring(texts, " ", " " + SPACE), SPACE)
    spaced = pc.if_else(pc.equal(texts, ""), "", spaced)
    spaced = pc.replace_substring(spaced, "\n", " \n ")
    if fine:
        # A character can end one match and begin the next, so the two kinds of border take turns.
        spaced = pc.replace_substring_regex(spaced, f"([{_LETTER}])([^{_LETTER} {SPACE}])", "\\1 \\2")
        spaced = pc.replace_substring_regex(spaced, f"([^{_LETTER} {SPACE}])([{_LETTER}])", "\\1 \\2")
    return pc.split_pattern(spaced, " ")


class _Block:
    """Texts as numbers of their distinct units, the most frequent first."""

    def __init__(self, slices: Iterator[tuple[pa.Array, pa.Array]], fine: bool):
        self.owners: list[pa.Array] = []
        held, codes, sizes, total = [pa.array([], pa.string())], [np.zeros(0, "<u4")], [np.zeros(0, "<u4")], 0
        for owners, texts in slices:
            cut = _units(texts, fine)
            offsets = cut.offsets.to_numpy()
            coded = cut.values.slice(int(offsets[0])).dictionary_encode()
            found = pc.index_in(coded.dictionary, value_set=pa.concat_arrays(held)).fill_null(-1)
            places = found.to_numpy().copy()
            new = np.flatnonzero(places < 0)
            places[new] = total + np.arange(len(new))
            total += len(new)
            held.append(coded.dictionary.take(pa.array(new)))
            self.owners.append(owners)
            codes.append(places.astype("<u4")[coded.indices.to_numpy()])
            sizes.append(np.diff(offsets).astype("<u4"))
        codes, self.sizes = np.concatenate(codes), np.concatenate(sizes)
        order = np.argsort(-np.bincount(codes, minlength=total), kind="stable")
        rank = np.empty(total, "<u4")
        rank[order] = np.arange(total)
        self.codes = rank[codes]
        self.units = pa.concat_arrays(held).take(pa.array(order))

    def checksum(self) -> int:
        return _checksum(_crcs(self.units), np.arange(len(self.units)))


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of rows with about ``size`` bytes of text."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        share = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // size
        cuts = np.flatnonzero(np.diff(share, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(batch)]):
            yield batch.column(0).slice(a, b - a), texts.slice(a, b - a)


def _blocks(batches: Iterator[pa.RecordBatch], fine: bool, partition: int) -> Iterator[tuple[int, _Block]]:
    """The texts of a partition in blocks of bounded bytes, numbered over all partitions."""
    slices, number = _slices(batches, SLICE), partition << 32

    def some(first) -> Iterator[tuple[pa.Array, pa.Array]]:
        held, row = 0, first
        while row is not None:
            held += row[1].nbytes
            yield row
            row = next(slices, None) if held < BLOCK else None

    while (first := next(slices, None)) is not None:
        yield number, _Block(some(first), fine)
        number += 1
        give_back()


def _crcs(units: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(u) for u in raw(units)], np.int64)


def _checksum(crcs: np.ndarray, places: np.ndarray) -> int:
    """Of units and their places; that of several parts is the sum, modulo 2^32."""
    return int((crcs * (2 * places.astype(np.int64) + 1) & 0xFFFFFFFF).sum()) & 0xFFFFFFFF


def _pack(arrays) -> bytes:
    """Arrays of unsigned 32-bit integers, compressed byte by byte of the integers."""
    parts = []
    for column in arrays:
        data = np.ascontiguousarray(np.asarray(column, "<u4")).view(np.uint8)
        parts += [len(data).to_bytes(8, "little"), data.reshape(-1, 4).T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    data, at, arrays = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        planes = np.frombuffer(data, np.uint8, size, at + 8).reshape(4, -1)
        arrays.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 8 + size
    return arrays


def encode_pieces(
    docs: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id, ``n_pieces`` and ``ids`` (little-endian unsigned 32-bit integers) of every row."""
    fine = table.fine
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.dtypes[0][1]

    def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, fine, TaskContext.get().partitionId()):
            units = block.units
            del block
            for at in range(0, len(units), 50_000):
                some = units.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), part, np.int64)),
                        pa.array(np.arange(at, at + len(some), dtype=np.int32)),
                        some,
                    ],
                    names=["part", "place", "unit"],
                )

    def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, fine, TaskContext.get().partitionId()):
            owners = pa.concat_arrays(block.owners)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([len(block.units)], pa.int64()),
                    pa.array([block.checksum()], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners),
                    pa.array([_pack([block.codes, block.sizes])], pa.binary()),
                ],
                names=["part", "n_units", "checksum", "owners", "codes"],
            )
            del block, owners

    # Many partitions, since every unit grows to all its substrings before it is one row again.
    partitions = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = (
        slim.mapInArrow(units_of, "part long, place int, unit string")
        .repartition(partitions, "unit")
        .groupBy("unit")
        .agg(F.collect_list(F.struct("part", "place")).alias("places"))
    )
    fold = _Fold(table)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids by block: places of the units in the block, each less the one before, counts, ids and the
        checksum of these units."""
        for units, counts, flat, places in fold.run(batches):
            crcs = _crcs(units)
            starts = np.cumsum(counts) - counts
            found = pc.list_flatten(places)
            unit = pc.list_parent_indices(places).to_numpy()
            part, place = (found.field(k).to_numpy() for k in (0, 1))
            order = np.lexsort((place, part))
            unit, part, place = unit[order], part[order], place[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            packs = []
            for a, b in zip(cuts, [*cuts[1:], len(part)]):
                own = unit[a:b]
                ids = gather(flat, starts[own], counts[own])
                check = _checksum(crcs[own], place[a:b])
                packs.append(_pack([np.diff(place[a:b], prepend=0), counts[own], ids, [check]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cuts]), pa.array(packs, pa.binary())], names=["part", "data"]
            )
        give_back()

    back = lattices(units, table, "places").mapInArrow(packed, "part long, data binary")
    texts = slim.mapInArrow(
        codes_of, f"part long, n_units long, checksum long, owners array<{kind}>, codes binary"
    )

    def put_together(packs: pa.Table, blocks: pa.Table) -> pa.Table:
        """One block: ids by place of the unit, then the ids of each text."""
        parts = [_unpack(p) for p in packs["data"].to_pylist()]
        none = np.zeros(0, "<u4")
        places = np.concatenate([none, *(np.cumsum(p[0], dtype="<u4") for p in parts)])
        counts, flat = (np.concatenate([none, *(p[k] for p in parts)]) for k in (1, 2))
        check = sum(int(p[3][0]) for p in parts) & 0xFFFFFFFF
        del parts
        order = np.argsort(places)
        found = [] if not blocks.num_rows else [(blocks["n_units"][0].as_py(), blocks["checksum"][0].as_py())]
        if found != [(len(places), check)] or not np.array_equal(places[order], np.arange(len(places))):
            raise RuntimeError("a partition changed between two reads; write the input first")
        starts = (np.cumsum(counts, dtype=np.int64) - counts)[order]
        counts = counts[order].astype(np.int64)
        codes, sizes = _unpack(blocks["codes"][0].as_py())
        ends = np.cumsum(sizes, dtype=np.int64)
        owners = blocks["owners"].combine_chunks().flatten()
        tables = []
        for at in range(0, len(sizes), ROWS):
            ids, lengths = [], []
            for size, end in zip(sizes[at : at + ROWS].tolist(), ends[at : at + ROWS].tolist()):
                own = codes[end - size : end]
                text = gather(flat, starts[own], counts[own])
                ids.append(text.tobytes())
                lengths.append(len(text))
            columns = [owners.slice(at, ROWS), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
            tables.append(pa.table(columns, names=[id_col, "n_pieces", "ids"]))
        del codes, flat
        give_back()
        return pa.concat_tables(tables)

    return (
        back.groupBy("part")
        .cogroup(texts.groupBy("part"))
        .applyInArrow(put_together, f"`{id_col}` {kind}, n_pieces long, ids binary")
    )


def decode_pieces(
    encoded: DataFrame, table: PieceTable, id_col: str = "doc_id", keep: Sequence[str | Column] = ()
) -> DataFrame:
    """Id and ``text`` of rows with ``ids``, and the columns of ``encoded`` that are to be kept."""
    size = max([*table.ids, *table.byte_ids]) + 1
    spelled = [b""] * size
    for number, piece in zip(table.ids, table.pieces):
        spelled[number] = piece.replace(SPACE, " ").encode()
    for value, number in enumerate(table.byte_ids):
        spelled[number] = bytes([value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.frombuffer(b"".join(spelled), np.uint8)
        lengths = np.array([len(s) for s in spelled])
        starts = np.cumsum(lengths) - lengths
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch, texts = whole.slice(at, ROWS), []
                for data in batch.column(0).to_pylist():
                    ids = np.frombuffer(data or b"", "<u4")
                    text = gather(flat, starts[ids], lengths[ids]).tobytes().decode("utf-8", "replace")
                    texts.append(text.removeprefix(" "))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()), *batch.columns[1:]], names=["text", *batch.schema.names[1:]]
                )
        give_back()

    slim = encoded.select("ids", F.col(f"`{id_col}`"), *keep)
    kept = ", ".join(f"`{c}` {kind}" for c, kind in slim.dtypes[1:])
    return slim.mapInArrow(run, f"text string, {kept}")
