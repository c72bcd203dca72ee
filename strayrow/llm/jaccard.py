"""N-gram Jaccard join: documents whose sets of word shingles overlap enough are linked.

Equal sets are one node. Nodes are dealt into tiles by size band and shingle class. A pair with
similarity t or more has at most d = (1 - t) / (1 + t) * (size + size) shingles in one set only; the
shingles are split by hash into more than d classes, so some class is the same in both sets, and
both nodes stand in the tile (band, class, content of the class). More classes than d + 1 are used,
so that a common class is not empty, unless both nodes have many empty classes; such nodes also
stand in tiles of empty classes. A node stands in the tiles of its own band and of each band that a
larger partner can be in. As there are more classes, a pair shares more than one tile; a node that
shares fewer with all others together has no partner in the band and is taken out. No pair is lost.

In each tile the smallest node is compared with all others; the links give first components. Then
only nodes of different components that still share a tile are compared with each other, block by
block, the most promising pair of every two components first; pairs within a component that these
links form are left out. Every comparison first uses hashed bitmaps: a bit that only one of the two has stands for at
least one shingle that only it has, so bit counts bound the overlap from above. What passes is
decided by intersecting the sorted arrays of 64-bit shingle hashes (equal hashes count as equal
shingles; the odds of a wrong one are about 1e-13 for a pair of large sets).

Edge cases: a text with fewer words than a shingle is one shingle; a null text or one without words
is linked with nothing; equal texts are linked; rows without an id take part, and a component's id
is the smallest id that is not null; rows with an equal id are rows of their own; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strayrow.functions.materialize import Scratch, pin, small_batches
from strayrow.functions.skew import attach
from strayrow.llm.components import components
from strayrow.llm.texts import give_back, raw

SHINGLE = 5
SIMILARITY = (4, 5)
BROADCAST_IDS = 1_000_000
BLOCK = 4_096
BAND_MASK = 127
#: Rows that a Python task holds at once; a row can carry two texts' shingles, 8 bytes for each.
BATCH_ROWS = 1_000
#: Rounds of taking out nodes that share too few tiles.
ROUNDS = 2

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    joined = np.full(count, size, np.uint64)
    for k in range(size):
        joined = mixed(joined * _STEP + hashes[k : k + count])
    return np.unique(joined)


class Bands:
    """Size bands and their class counts for the similarity ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 3 // 2))
        self.differ = [2 * (hi - 1) * (den - num) // (den + num) for hi in self.edges[1:]]
        #: Classes that may be empty before a node also stands in tiles of empty classes.
        self.spare = [d // 16 + 1 if d else 0 for d in self.differ]
        #: Classes beyond those; a pair shares so many more tiles.
        self.extra = [d // 8 for d in self.differ]
        self.classes = [d + 1 + s + x for d, s, x in zip(self.differ, self.spare, self.extra)]

    def own(self, sizes):
        return np.searchsorted(self.edges, sizes, "right") - 1

    def of(self, size: int) -> list[int]:
        """The band of a size and those of larger partners."""
        first = int(self.own(size))
        largest = size * self.den // self.num
        last = int(np.searchsorted(self.edges, largest, "right")) - 1
        return list(range(first, last + 1))

    def least_shared(self, size: Column, band: Column) -> Column:
        """Tiles of a band that a node of a size shares with each partner, at least.

        The classes of the band, less the shingles that only one of the two can have, less the
        classes that may be empty. The largest possible partner asks for the fewest.
        """

        def of_band(values: list[int]) -> Column:
            return F.get(F.array(*[F.lit(v).cast("long") for v in values]), band.cast("int"))

        partner = F.least(of_band(self.edges[1:]) - 1, F.floor(size * self.den / self.num))
        differ = F.floor((size + partner) * (self.den - self.num) / (self.den + self.num))
        return of_band([d + 1 + x for d, x in zip(self.differ, self.extra)]) - differ


def tile_keys(found: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashes that name the tiles of a set; the lowest bits are the band."""
    keys = []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(found + _STEP), dtype=np.uint64)])
    high = found >> np.uint64(32)
    for band in bands.of(len(found)):
        classes = bands.classes[band]
        ends = np.cumsum(np.bincount((high * np.uint64(classes) >> np.uint64(32)).astype(np.int64), minlength=classes))
        content = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        filled = np.diff(ends, prepend=0) > 0
        if classes - filled.sum() > bands.spare[band]:
            filled[:] = True
        label = np.uint64(band) << np.uint64(44) | np.arange(classes, dtype=np.uint64)
        name = mixed(content * _STEP + mixed(label + _STEP))[filled]
        keys.append(name & ~np.uint64(BAND_MASK) | np.uint64(band))
    return np.concatenate(keys)


def bitmap(found: np.ndarray) -> np.ndarray:
    """About four bits for each shingle, a power of two from 64 to 2^16, as 64-bit words."""
    bits = min(max(64, 1 << (4 * len(found) - 1).bit_length()), 1 << 16)
    flags = np.zeros(bits, np.uint8)
    flags[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    while len(words) > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    places = np.searchsorted(b, a)
    places[places == len(b)] = 0
    return int((b[places] == a).sum())


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """Per row its id, set size, node (hash of the set) and, once per task and node, tile keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in raw(batch.column(1)):
                found = shingles(text, size)
                sizes.append(len(found))
                total = mixed(found ^ _STEP).sum(dtype=np.uint64) + np.uint64(len(found))
                node = int(mixed(np.array([total]))[0].view(np.int64)) if len(found) else None
                nodes.append(node)
                keys.append(None if node is None or node in seen else tile_keys(found, bands).view(np.int64))
                seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "node", "keys"],
            )
            give_back()

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.dtypes[0][1]
    return slim.mapInArrow(run, f"id {kind}, n_shingles long, node long, keys array<long>")


def _full_sets(
    docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int, scratch: Scratch
) -> DataFrame:
    """Shingles and bitmaps of the rows whose id is in ``ids``, one row for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, bits, sets = [], [], [], []
            for text in raw(batch.column(0)):
                found = shingles(text, size)
                if not len(found):
                    continue
                total = mixed(found ^ _STEP).sum(dtype=np.uint64) + np.uint64(len(found))
                node = int(mixed(np.array([total]))[0].view(np.int64))
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(found))
                    bits.append(bitmap(found).tobytes())
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(bits, pa.binary()),
                    pa.array(sets, pa.binary()),
                ],
                names=["node", "n", "bits", "shingles"],
            )
            give_back()

    wanted = ids.select(F.col("id").alias("_id"))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    # A node can come from several tasks if an id is repeated; that repeats pairs, no more.
    return scratch.keep(texts.mapInArrow(run, "node long, n long, bits binary, shingles binary"), "sets")


def _with(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Attach columns of both nodes of each pair, in front."""
    own = pairs.columns
    for side in ("a", "b"):
        pairs = pairs.join(
            sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side
        )
    return pairs.select(*[f"{c}_{side}" for c in columns for side in ("a", "b")], *own)


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that sizes and bitmaps do not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in (0, 1))
            keep = []
            for a, b, x, y in zip(n_a, n_b, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                size = min(len(x), len(y))
                x, y = folded(x, size), folded(y, size)
                most = min(a - np.bitwise_count(x & ~y).sum(dtype=np.int64), b - np.bitwise_count(y & ~x).sum(dtype=np.int64))
                keep.append(bool(most * (num + den) >= num * (a + b)))
            yield batch.select([4, 5]).filter(pa.array(keep, pa.bool_()))
        give_back()

    sized = _with(pairs, sets, "n", "bits").where(
        F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    )
    return sized.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs, with all columns, whose exact similarity is large enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                keep.append(overlap(x, y) * (num + den) >= num * (len(x) + len(y)))
            own = list(range(2, batch.num_columns))
            yield batch.select(own).filter(pa.array(keep, pa.bool_()))
        give_back()

    return _with(pairs, sets, "shingles").mapInArrow(run, pairs.schema)


def _across(rows: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    """Pairs of nodes of different components in one tile that bitmaps do not exclude.

    With ``best`` the most similar pair of every two components, with the components (the smaller
    first) and the similarity that the bitmaps leave possible; else a row for each node, with its
    component and its partners (node, component). Tiles repeat each other's pairs, but only those of
    the larger node's own band have them.

    ``rows``: key, lo, hi (blocks of the tile), block, node, component, n, bits.
    """

    bands = Bands(num, den)

    def pairs(key, nodes, parts, sizes, blocks, bits) -> list[np.ndarray]:
        own = bands.own(sizes) == key & BAND_MASK
        width = min(len(x) for x in bits)
        words = np.stack([folded(x, width) for x in bits])
        split = len(set(blocks.tolist())) > 1
        found = []
        step = max(1, (1 << 20) // (len(nodes) * width))
        for at in range(0, len(nodes), step):
            mine = slice(at, at + step)
            only_a = np.bitwise_count(words[mine, None] & ~words[None]).sum(2, dtype=np.int64)
            only_b = np.bitwise_count(~words[mine, None] & words[None]).sum(2, dtype=np.int64)
            a, b = sizes[mine, None], sizes[None]
            most = np.minimum(a - only_a, b - only_b)
            good = (most * (num + den) >= num * (a + b)) & (parts[mine, None] != parts[None])
            good &= (nodes[mine, None] < nodes[None]) & (own[mine, None] | own[None])
            if split:
                good &= blocks[mine, None] != blocks[None]
            i, j = np.nonzero(good)
            x, y = parts[i + at], parts[j]
            if not best:
                found.append((nodes[i + at], x, nodes[j], y))
                continue
            bound = most[i, j] / (a + b - most)[i, j]
            found.append((nodes[i + at], nodes[j], np.minimum(x, y), np.maximum(x, y), bound))
        found = [np.concatenate(x) for x in zip(*found)]
        if best:
            order = np.lexsort((-found[4], found[3], found[2]))
            found = [x[order] for x in found]
            first = np.ones(len(order), bool)
            first[1:] = (found[2][1:] != found[2][:-1]) | (found[3][1:] != found[3][:-1])
            found = [x[first] for x in found]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        current = None

        def flush() -> pa.RecordBatch:
            nodes, parts, sizes, blocks = (
                np.array([r[k] for r in held], np.int64) for k in range(4)
            )
            found = pairs(current[0], nodes, parts, sizes, blocks, [np.frombuffer(r[4], "<u8") for r in held])
            if best:
                return pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["a", "b", "from", "to", "bound"])
            a, x, b, y = found  # by the place of the node a
            starts = np.flatnonzero(np.concatenate([np.ones(len(a[:1]), bool), a[1:] != a[:-1]]))
            partners = pa.StructArray.from_arrays([pa.array(b), pa.array(y)], names=["b", "y"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(a)), pa.int32()), partners)
            return pa.RecordBatch.from_arrays(
                [pa.array(a[starts]), pa.array(x[starts]), lists], names=["a", "x", "partners"]
            )

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for key, lo, hi, *row in zip(*columns):
                if (key, lo, hi) != current:
                    if len(held) > 1:
                        yield flush()
                    current, held = (key, lo, hi), []
                held.append(row)
        if len(held) > 1:
            yield flush()
        give_back()

    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    columns = dealt.select("key", "lo", "hi", "node", "component", "n", "block", "bits")
    if best:
        return columns.mapInArrow(run, "a long, b long, from long, to long, bound double")
    return columns.mapInArrow(run, "a long, x long, partners array<struct<b: long, y: long>>")


def _renamed(labels: DataFrame, names: DataFrame) -> DataFrame:
    """Labels whose components were joined to others."""
    names = names.select(F.col("node").alias("component"), F.col("component").alias("name"))
    return labels.join(names, "component", "left").select(
        "node", F.coalesce("name", "component").alias("component")
    )


def _sharing_enough(tiles: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """The rows of nodes that share as many tiles of the band as any partner would share with them."""
    band = F.col("key").bitwiseAND(BAND_MASK)
    counted = (
        tiles.repartition("node")
        .join(nodes.select("node", "n"), "node")
        .withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("node", band)))
    )
    return counted.where(F.col("count") >= bands.least_shared(F.col("n"), band)).select(tiles.columns)


def _tiles_of_components(
    shared: DataFrame, labels: DataFrame, sets: DataFrame, nodes: DataFrame, bands: Bands, of: DataFrame | None
) -> DataFrame:
    """What ``_across`` reads: tiles with several components, in blocks of bounded size; with ``of``
    only the nodes of these components.

    A pair that is still apart and not yet decided shares only tiles of several components with
    three nodes or more, and as many as any pair; nodes with fewer of those go.
    """
    tile = Window.partitionBy("key")
    ends = {
        "least": F.min("component").over(tile),
        "most": F.max("component").over(tile),
        "count": F.count(F.lit(1)).over(tile),
    }

    def mixed_tiles(rows: DataFrame, nodes_in_tile: int) -> DataFrame:
        several = (F.col("least") < F.col("most")) & (F.col("count") >= nodes_in_tile)
        return rows.withColumns(ends).where(several)

    labelled = shared.join(labels, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    apart = mixed_tiles(labelled, 3).select("key", "node", "component")
    if of is not None:
        apart = apart.join(of, "component", "left_semi").select(apart.columns)
    known = mixed_tiles(_sharing_enough(apart, nodes, bands), 2)
    order = Window.partitionBy("key").orderBy("node")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    return (
        known.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "key", "node", "component", "block",
            F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        )
        .join(sets.select("node", "n", "bits"), "node")
    )


def _join_components(
    labels: DataFrame, tiles: DataFrame, sets: DataFrame, num: int, den: int, best: bool, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """Labels after the pairs of ``_across`` have been decided, and the components that are still
    apart from another one with which they have such a pair."""
    found = _across(tiles, num, den, best)
    if best:
        top = found.groupBy("from", "to").agg(F.max(F.struct("bound", "a", "b")).alias("p"))
        pairs = top.select("p.a", "p.b", "from", "to")
    else:
        partners = F.array_distinct(F.flatten(F.collect_list("partners")))
        once = found.groupBy("a", "x").agg(F.explode(partners).alias("p")).select("a", "x", "p.b", "p.y")
        pairs = once.select("a", "b", F.least("x", "y").alias("from"), F.greatest("x", "y").alias("to"))
    name = "best" if best else "all"
    pairs = scratch.keep(pairs, f"pairs-{name}")
    linked = _linked(pairs, sets, num, den)
    joined = scratch.keep_slim(
        linked.select(F.col("from").alias("a"), F.col("to").alias("b")).distinct(), f"joined-{name}"
    )
    both = pairs.select("from", "to").distinct()
    if not joined.isEmpty():
        names = components(joined)
        # Nodes without a link so far are components of their own.
        lone = names.select("node").join(labels.select("node"), "node", "left_anti")
        every = labels.unionByName(lone.withColumn("component", F.col("node")))
        labels = scratch.keep_slim(_renamed(every, names), f"labels-{name}")
        for side in ("from", "to"):
            of_side = names.select(F.col("node").alias(side), F.col("component").alias("name"))
            both = both.join(of_side, side, "left").withColumn(side, F.coalesce("name", side)).drop("name")
    ends = F.explode(F.array("from", "to")).alias("component")
    still = scratch.keep_slim(both.where(F.col("from") != F.col("to")).select(ends).distinct(), f"open-{name}")
    scratch.drop(f"pairs-{name}")
    return labels, still


def similar_groups(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Rows are linked when their shingle sets' Jaccard similarity is at least
    ``similarity[0] / similarity[1]``.
    """
    # Every Python step below is written before this returns.
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _grouped(docs, shingle, similarity, id_col, text_col)


def _grouped(
    docs: DataFrame, shingle: int, similarity: tuple[int, int], id_col: str, text_col: str
) -> DataFrame:
    num, den = similarity
    # Each table goes when its successor is written; only the slim rows and their groups stay.
    scratch = Scratch(docs.sparkSession, "jaccard")
    shingled = scratch.keep(_sets(docs, id_col, text_col, shingle, num, den), "shingled")
    rows = scratch.keep(shingled.select("id", "n_shingles", "node"), "rows")
    nodes = pin(
        rows.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"))
    )
    tiles = shingled.where(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), "node")
    tile = Window.partitionBy("key")
    ends = {"leader": F.min("node").over(tile), "last": F.max("node").over(tile)}
    shared = tiles.withColumns(ends).where(F.col("leader") < F.col("last")).select("key", "node")
    bands = Bands(num, den)
    source = "shingled"
    for done in range(ROUNDS):
        kept = scratch.keep(shared, f"tiles{done}")
        scratch.drop(source)
        source = f"tiles{done}"
        enough = _sharing_enough(kept, nodes, bands).select("key", "node")
        shared = enough.withColumns(ends).where(F.col("leader") < F.col("last"))
    shared = scratch.keep(shared.select("key", "node", "leader").distinct(), "tiles")
    scratch.drop(source)
    first = shared.where(F.col("node") != F.col("leader")).select(
        F.col("leader").alias("a"), F.col("node").alias("b")
    ).distinct()
    ids = shared.select("node").distinct().join(nodes, "node").select("id").distinct()
    sets = _full_sets(docs, ids, id_col, text_col, shingle, scratch)
    links = pin(_linked(_possible(first, sets, num, den), sets, num, den))
    labels = components(links)

    # First the best pair of every two components; then all pairs of those that are still apart.
    # A pair that was not a candidate in the first round is none in the second.
    tiles = _tiles_of_components(shared, labels, sets, nodes, bands, None)
    labels, still = _join_components(labels, tiles, sets, num, den, True, scratch)
    if not still.isEmpty():
        tiles = _tiles_of_components(shared, labels, sets, nodes, bands, still)
        labels, _ = _join_components(labels, tiles, sets, num, den, False, scratch)

    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    groups = pin(named.join(smallest, "component").select("node", "component_id", "rows"))
    scratch.drop("tiles", "sets")
    placed = attach(rows.select("id", "n_shingles", "node"), groups, "node", ["component_id"], "rows")
    return placed.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The row with the smallest id of each group, with all columns.

    Rows without an id all stay, as do texts without words. Rows equal in id and text are one.
    """
    groups = similar_groups(docs, shingle, similarity, id_col, text_col)
    first = pin(
        groups.where(F.col(id_col) == F.col("component_id"))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    lone = first.where(F.col("rows") == 1).select("_id")
    if lone.count() <= BROADCAST_IDS:
        lone = F.broadcast(lone)
    stay = docs.join(lone, docs[id_col] == lone["_id"], "left_semi")
    stay = stay.unionByName(docs.where(F.col(id_col).isNull()))
    repeated = first.where(F.col("rows") > 1).select("_id")
    if repeated.isEmpty():
        return stay
    twice = docs.join(repeated, docs[id_col] == repeated["_id"], "left_semi")
    return stay.unionByName(twice.dropDuplicates([id_col, text_col]))
