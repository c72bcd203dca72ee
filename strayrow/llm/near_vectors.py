"""Near duplicates among vectors by NN-descent.

Dong, Moses, Li: Efficient k-nearest neighbor graph construction for generic similarity measures,
WWW 2011. A graph that gives every vector a list of near ones is refined by comparing neighbours of
neighbours, round after round; pairs at or above the threshold are the links.

1. Equal vectors of a label are one node with a weight.
2. Nodes are folded into balls: a node within half of the threshold's angle of a centre is covered
   by it, so all nodes of a ball are linked with each other without being compared. Centres are
   chosen inside blocks of a sweep (below), again among the centres that are left, and every covered
   node is held against its final centre; those that are too far from it are folded anew.
3. Centres get first lists from sweeps: sorted by the sides of random hyperplanes they lie on, they
   are cut into blocks, and each gets its nearest of the block. Sorting by ranges splits any crowd.
4. In each round, the members of a centre's list and of the lists it is in meet in one group, and
   pairs of which one is new there are compared. Groups above a size are split at random, anew in
   each round. A list is saturated when its members are so near that their balls may hold links; it
   is then enlarged to twice the number of such members.
5. When a round brings no new pair within reach, an audit compares a bounded sample of centres with
   all of them. Below the wanted recall, what it found is added, another sweep is made and the
   descent goes on.
6. Each node of a ball is held against the centres of the balls within reach: with the radius, that
   proves links with all of the ball, or none, or else the ball's nodes are compared one by one. This
   step alone decides about links, in double precision; steps 2 to 5 use vectors of bytes.

Lists are rows of a table, joined by shuffles; the driver sees counts and the audit's sample. Crowds
of near copies take work in proportion to their size, as they are balls.

Edge cases: vectors that are null, zero, or hold a null or a number that is not finite, and rows
without label or id, link with nothing; vectors of a label with different lengths do not link;
repeated rows are linked copies; rows that share the smallest id of their component are all kept; an
empty table gives an empty table; other columns are ignored, whatever their names. An id that is
missing stays missing and the row is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayrow.functions.columns import col
from strayrow.functions.materialize import Scratch
from strayrow.functions.skew import attach
from strayrow.llm.components import components

NEIGHBOURS = 10
BLOCK = 256
PLANES = 40
SWEEPS = 3
FOLDS = 4
AUDITED = 256
RECALL = 0.999
ROUNDS = 12
ROOM = 1e-6  # radians; arccos of a rounded cosine is off by less
ROUGH = 0.02  # what bytes may take from a cosine
HOT_CENTRES = 20_000
_EDGE = "a long, b long, cos float, reach boolean, fresh boolean"


def _units(rows: list[bytes] | pa.Array) -> np.ndarray:
    """Vectors of bytes, all of one length, as unit vectors."""
    x = np.stack([np.frombuffer(r, np.int8) for r in rows]).astype(np.float32)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _numbered(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Row by row, in double precision; both lists of a row have one length."""
    out, lengths = np.zeros(len(a)), np.diff(a.offsets.to_numpy())
    x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (a, b))
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for i in range(0, len(rows), 4_096):
            part = rows[i : i + 4_096]
            spots = starts[part][:, None] + np.arange(n)
            u, v = _unit(x[spots]), _unit(y[spots])
            out[part] = (u * v).sum(1)
    return np.clip(out, -1, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, initial=0)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


class _Search:
    def __init__(self, spark, threshold: float, neighbours: int, sweeps: int):
        self.scratch = Scratch(spark, "near-vectors")
        self.threshold, self.angle = threshold, math.acos(threshold)
        self.half = self.angle / 2 - ROOM
        self.k, self.sweeps = neighbours, sweeps
        self.made = 0
        self.seed = 0

    def keep(self, df: DataFrame, *old: str) -> DataFrame:
        """Write the next table; then drop those it replaces."""
        self.made += 1
        found = self.scratch.keep(df, self.last)
        self.scratch.drop(*old)
        return found

    @property
    def last(self) -> str:
        return f"t{self.made}"

    # Sweeps

    def sorted_blocks(self, nodes: DataFrame, work, schema: str) -> DataFrame:
        """Cut ``nodes`` (node, grp, q, radius), sorted by the sides of random planes, into blocks
        and apply ``work(node, group number, unit vectors, radius)`` to each block of one length."""
        self.seed += 1
        seed = self.seed

        def coded(batches):
            for batch in batches:
                rows = batch["q"].to_pylist()
                lengths = np.array([len(r) for r in rows])
                code = np.zeros(len(rows), np.int64)
                for n in np.unique(lengths):
                    planes = np.random.default_rng(seed).standard_normal((int(n), PLANES)).astype(np.float32)
                    at = np.flatnonzero(lengths == n)
                    sides = _units([rows[i] for i in at]) @ planes > 0
                    code[at] = sides.astype(np.int64) @ (1 << np.arange(PLANES)[::-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

        def blocks(batches):
            waiting = None
            for batch in batches:
                waiting = pa.table(batch) if waiting is None else pa.concat_tables([waiting, pa.table(batch)])
                whole = waiting.num_rows // BLOCK * BLOCK
                for i in range(0, whole, BLOCK):
                    yield from worked(waiting.slice(i, BLOCK))
                waiting = waiting.slice(whole).combine_chunks()
            if waiting is not None and waiting.num_rows:
                yield from worked(waiting)

        def worked(block):
            block = block.combine_chunks()
            rows = block["q"].to_pylist()
            lengths = np.array([len(r) for r in rows])
            group = _numbered(block["grp"].combine_chunks())
            node, radius = block["node"].to_numpy(), block["radius"].to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                yield from work(node[at], group[at], _units([rows[i] for i in at]), radius[at])

        slim = nodes.select("node", "grp", "q", "radius")
        kinds = "node long, grp string, q binary, radius double"
        order = ["grp", "code", "node"]
        ranged = slim.mapInArrow(coded, kinds + ", code long").repartitionByRange(*order)
        return ranged.sortWithinPartitions(*order).mapInArrow(blocks, schema)

    def covers(self, nodes: DataFrame) -> DataFrame:
        """``node`` and the centre ``root`` of its block that covers it."""
        tight = math.cos(self.half)

        def work(node, group, x, radius):
            near = (x @ x.T >= tight) & (group[:, None] == group)
            np.fill_diagonal(near, False)
            root, free = np.full(len(node), -1), np.ones(len(node), bool)
            some = np.flatnonzero(near.any(1))
            for i in some[np.argsort(_mixed(node[some]))]:
                if free[i]:
                    took = np.flatnonzero(near[i] & free)
                    root[took] = i
                    free[took] = free[i] = False
            at = np.flatnonzero(root >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], names=["node", "root"])

        return self.sorted_blocks(nodes, work, "node long, root long")

    def lists(self, nodes: DataFrame) -> DataFrame:
        """Each node's nearest of its block, and all whose balls are within reach."""
        k, angle = self.k, self.angle

        def work(node, group, x, radius):
            cos = np.where(group[:, None] == group, x @ x.T, -2)
            np.fill_diagonal(cos, -2)
            reach = _within(cos, radius[:, None], radius, angle)
            chosen = reach.copy()
            if len(node) > k:
                best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                np.put_along_axis(chosen, best, True, axis=1)
            else:
                chosen[:] = True
            yield _edges(node, node, cos, reach, chosen & (cos > -2))

        return self.sorted_blocks(nodes, work, _EDGE)

    # Balls

    def fold(self, nodes: DataFrame) -> DataFrame:
        """``node``, its centre and the ``angle`` between them, of all nodes that are covered."""
        flat = nodes.withColumn("radius", F.lit(0.0))
        pool, found = flat, []
        for _ in range(FOLDS):
            roots = None
            for _ in range(self.sweeps):
                moves = self.keep(self.covers(pool if roots is None else self.without(pool, roots)))
                if moves.isEmpty():
                    continue
                if roots is not None:
                    onward = moves.select(F.col("node").alias("root"), F.col("root").alias("onward"))
                    moved = roots.join(onward, "root", "left").select(
                        "node", F.coalesce("onward", "root").alias("root")
                    )
                    moves = self.keep(moved.unionByName(moves))
                roots = moves
            if roots is None:
                break
            held = self.compared(roots.select(F.col("node").alias("a"), F.col("root").alias("b")), nodes)
            held = self.keep(held.select("a", "b", F.acos("cos").alias("angle")))
            near = F.col("angle") <= F.lit(self.half)
            found.append(held.where(near).select(F.col("a").alias("node"), F.col("b").alias("centre"), "angle"))
            strays = held.where(~near).select(F.col("a").alias("node"))
            if strays.isEmpty():
                break
            pool = flat.join(strays, "node", "left_semi")
        if not found:
            return nodes.select("node", F.col("node").alias("centre"), F.lit(0.0).alias("angle")).limit(0)
        covered = found[0]
        for more in found[1:]:
            covered = covered.unionByName(more)
        return covered

    @staticmethod
    def without(nodes: DataFrame, covered: DataFrame) -> DataFrame:
        return nodes.join(covered.select("node"), "node", "left_anti")

    @staticmethod
    def compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Add the exact cosine ``cos`` of ``a`` and ``b``; other columns stay."""
        first = nodes.select(F.col("node").alias("a"), F.col("x").alias("xa"))
        second = nodes.select(F.col("node").alias("b"), F.col("x").alias("xb"))
        both = pairs.join(first, "a").join(second, "b").select(*pairs.columns, "xa", "xb")
        names = [*pairs.columns, "cos"]

        def run(batches):
            for batch in batches:
                cos = pa.array(_cosines(batch["xa"], batch["xb"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], cos], names=names)

        kinds = ", ".join(f"{n} {t}" for n, t in pairs.dtypes)
        return both.mapInArrow(run, f"{kinds}, cos double")

    # Descent

    def trimmed(self, edges: DataFrame) -> DataFrame:
        """Lists of ``k`` members, or, where those within reach fill them, twice as many as these."""
        merged = edges.groupBy("a", "b").agg(
            F.max("cos").alias("cos"), F.max("reach").alias("reach"), F.min("fresh").alias("fresh")
        )
        own = Window.partitionBy("a")
        ranked = merged.withColumn("place", F.row_number().over(own.orderBy(F.desc("cos"), "b")))
        filled = ranked.withColumn("near", F.sum(F.col("reach").cast("int")).over(own))
        most = F.greatest(F.lit(self.k), 2 * F.col("near"))
        return filled.where(F.col("reach") | (F.col("place") <= most)).select(*[f.split()[0] for f in _EDGE.split(", ")])

    def round(self, graph: DataFrame, centres: DataFrame) -> DataFrame:
        """Compare neighbours of neighbours; pairs that improve the list of ``a``."""
        forth = graph.select(F.col("a").alias("v"), F.col("b").alias("u"), "fresh")
        back = graph.select(F.col("b").alias("v"), F.col("a").alias("u"), "fresh")
        members = forth.unionByName(back).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        members = self.keep(members)
        most = 3 * self.k
        crowds = members.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("any")).where("any")
        crowds = crowds.select("v", F.ceil(F.col("n") / most).alias("parts"))
        self.seed += 1
        part = F.pmod(F.xxhash64(F.lit(self.seed), "u"), F.col("parts")).alias("part")
        floors = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) >= self.k, F.min("cos")).alias("floor"))
        facts = centres.select(F.col("node").alias("u"), "q", "radius").join(
            floors.select(F.col("a").alias("u"), "floor"), "u", "left"
        )
        packs = (
            members.join(crowds, "v")
            .select("v", part, "u", "fresh")
            .join(facts, "u")
            .groupBy("v", "part")
            .agg(F.collect_list(F.struct("u", "fresh", F.coalesce("floor", F.lit(-2.0)).alias("floor"), "radius", "q")).alias("m"))
            .where(F.size("m") > 1)
            .select("m")
        )
        angle, k = self.angle, self.k

        def run(batches):
            for batch in batches:
                out = []
                for members in batch["m"]:
                    flat = members.values.flatten()
                    u, fresh, floor, radius = (c.to_numpy(zero_copy_only=False) for c in flat[:4])
                    x = _units(flat[4].to_pylist())
                    cos = x @ x.T
                    new = (fresh[:, None] | fresh) & (u[:, None] != u)
                    reach = _within(cos, radius[:, None], radius, angle)
                    chosen = new & (reach | (cos > floor[:, None]))
                    out.append(_edges(u, u, cos, reach, chosen))
                if out:
                    yield _best(out, k)

        return packs.mapInArrow(run, _EDGE)

    def audit(self, graph: DataFrame, centres: DataFrame) -> tuple[float, DataFrame]:
        """Recall of the pairs within reach of a sample of centres, and all of those pairs."""
        crowded = graph.where("reach").select(F.col("a").alias("node")).distinct()
        sample = []
        for some in (centres, centres.join(crowded, "node", "left_semi")):
            order = F.xxhash64(F.lit(self.seed), "node")
            sample += some.select("node", "grp", "q", "radius").orderBy(order).limit(AUDITED).collect()
        by_group: dict[str, dict[int, tuple]] = {}
        for r in sample:
            by_group.setdefault(r["grp"], {})[r["node"]] = (bytes(r["q"]), r["radius"])
        angle = self.angle

        def run(batches):
            asked = {
                g: (np.array([*m]), _units([q for q, _ in m.values()]), np.array([r for _, r in m.values()]))
                for g, m in by_group.items()
            }
            for batch in batches:
                grp = batch["grp"].to_pylist()
                places: dict[str, list[int]] = {}
                for i, g in enumerate(grp):
                    if g in asked:
                        places.setdefault(g, []).append(i)
                node, radius, q = batch["node"].to_numpy(), batch["radius"].to_numpy(), batch["q"]
                for g, at in places.items():
                    own, x, r = asked[g]
                    for i in range(0, len(at), 4_096):
                        rows = at[i : i + 4_096]
                        cos = x @ _units([q[j].as_py() for j in rows]).T
                        reach = _within(cos, r[:, None], radius[rows], angle) & (own[:, None] != node[rows])
                        yield _edges(own, node[rows], cos, reach, reach)

        true = self.keep(centres.select("node", "grp", "q", "radius").mapInArrow(run, _EDGE))
        known = graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        missed = true.join(known, ["a", "b"], "left_anti").count()
        total = true.count()
        return (1.0 if not total else 1 - missed / total), true

    def descend(self, centres: DataFrame) -> tuple[DataFrame, float]:
        """The lists of all centres, and the recall that the last audit found."""
        edges = self.lists(centres)
        for _ in range(self.sweeps - 1):
            edges = edges.unionByName(self.lists(centres))
        graph = self.keep(self.trimmed(edges))
        recall, before = 0.0, graph.where("reach").count()
        for _ in range(ROUNDS):
            name = self.last
            better = self.round(graph, centres)
            old = graph.withColumn("fresh", F.lit(False))
            graph = self.keep(self.trimmed(old.unionByName(better)))
            self.scratch.drop(name)
            now = graph.where("reach").count()
            if now > before:
                before = now
                continue
            recall, true = self.audit(graph, centres)
            if recall >= RECALL:
                break
            more = true.unionByName(self.lists(centres)).unionByName(graph)
            graph = self.keep(self.trimmed(more))
            before = graph.where("reach").count()
        return graph, recall


def _mixed(node: np.ndarray) -> np.ndarray:
    """Numbers in an order that has nothing to do with how they were given out."""
    x = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _within(cos, radius, other, angle) -> np.ndarray:
    """Whether balls of these radii, at centres with these rough cosines, may hold a link."""
    return cos >= np.cos(np.minimum(np.pi, angle + radius + other)) - ROUGH


def _edges(a, b, cos, reach, chosen) -> pa.RecordBatch:
    i, j = np.nonzero(chosen)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a[i]), pa.array(b[j]), pa.array(cos[i, j].astype(np.float32)),
            pa.array(reach[i, j]), pa.array(np.ones(len(i), bool)),
        ],
        names=["a", "b", "cos", "reach", "fresh"],
    )


def _best(batches: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """Of one batch's pairs, each once: those within reach and the best k of every ``a``."""
    a, b, cos, reach = (np.concatenate([x[n].to_numpy(zero_copy_only=False) for x in batches]) for n in ("a", "b", "cos", "reach"))
    order = np.lexsort((b, -cos, a))
    a, b, cos, reach = a[order], b[order], cos[order], reach[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, cos, reach = a[once], b[once], cos[once], reach[once]
    start = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1]) if len(a) else np.zeros(0, int)
    place = np.arange(len(a)) - np.repeat(start, np.diff([*start, len(a)]))
    held = reach | (place < k)
    return pa.RecordBatch.from_arrays(
        [pa.array(a[held]), pa.array(b[held]), pa.array(cos[held]), pa.array(reach[held]), pa.array(np.ones(int(held.sum()), bool))],
        names=["a", "b", "cos", "reach", "fresh"],
    )


def _bytes(nodes: DataFrame, kinds: str) -> DataFrame:
    """Add ``q``: the vector in steps of 1/127 of its largest component."""

    def run(batches):
        for batch in batches:
            q = []
            for x in batch["x"]:
                v = x.values.to_numpy(zero_copy_only=False).astype(float)
                q.append(np.rint(v * (127 / np.abs(v).max())).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.binary())], names=[*batch.schema.names, "q"])

    return nodes.mapInArrow(run, f"{kinds}, q binary")


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    neighbours: int = NEIGHBOURS,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """Id, ``n_links``, ``component_id``, ``kept`` and the audit's ``recall`` of every vector.

    Vectors of a label are linked at a cosine of ``threshold`` or more; a component is kept by its
    smallest id.
    """
    search = _Search(vectors.sparkSession, threshold, neighbours, sweeps)
    vector, label = col(vector_col), col(label_col)
    number = lambda c: F.abs(c.cast("double"))
    sound = F.forall(vector, lambda c: c.isNotNull() & (number(c) < float("inf"))) & F.exists(vector, lambda c: number(c) > 0)
    links = F.coalesce(sound, F.lit(False)) & label.isNotNull() & col(id_col).isNotNull()
    grp = F.concat(label.cast("string"), F.lit(":"), F.size(vector))
    rows = vectors.select(
        col(id_col).alias("id"),
        F.when(links, grp).alias("grp"),
        F.when(links, F.xxhash64(grp, vector)).alias("h"),
        F.when(links, F.xxhash64(F.lit(1), vector, grp)).alias("g"),
        vector.alias("x"),
    )
    kind = dict(rows.dtypes)
    nodes = (
        rows.where("grp IS NOT NULL")
        .groupBy("grp", "h", "g")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("low"), F.any_value("x").alias("x"))
        .select(F.monotonically_increasing_id().alias("node"), "grp", "h", "g", "weight", "low", "x")
    )
    kinds = f"node long, grp string, h long, g long, weight long, low {kind['id']}, x {kind['x']}"
    nodes = search.keep(_bytes(nodes, kinds))

    covered = search.keep(search.fold(nodes))
    of_centre = F.coalesce("centre", "node").alias("centre")
    members = search.keep(
        nodes.join(covered, "node", "left").select("node", of_centre, "weight", "low", F.coalesce("angle", F.lit(0.0)).alias("angle"))
    )
    balls = members.groupBy("centre").agg(
        F.max("angle").alias("radius"), F.sum("weight").alias("rows"), F.min("low").alias("low"), F.count(F.lit(1)).alias("nodes")
    )
    balls = search.keep(balls)
    centres = search.keep(
        nodes.select("node", "grp", "x", "q").join(balls.select(F.col("centre").alias("node"), "radius"), "node")
    )
    graph, recall = search.descend(centres)

    one_way = graph.where("reach").select("a", "b")
    near = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    asking = members.select(F.col("node").alias("a"), F.col("centre").alias("own")).join(
        near.select(F.col("a").alias("own"), "b"), "own"
    )
    of_ball = balls.select(F.col("centre").alias("b"), "radius", "rows", "nodes")
    held = search.keep(search.compared(asking.select("a", "own", "b").join(of_ball, "b"), nodes))
    angle, alone = F.acos("cos"), F.col("nodes") == 1
    whole = (alone & (F.col("cos") >= threshold)) | (~alone & (angle + F.col("radius") <= search.angle - ROOM))
    apart = (alone & (F.col("cos") < threshold)) | (~alone & (angle - F.col("radius") > search.angle + ROOM))
    sure = held.where(whole).select("a", "own", "b", F.col("rows").alias("found"))
    open_pairs = held.where(~whole & ~apart).select("a", "own", F.col("b").alias("other"))
    singly = open_pairs.join(
        members.select(F.col("centre").alias("other"), F.col("node").alias("b"), "weight"), "other"
    )
    decided = search.compared(singly.select("a", "own", "other", "weight", "b"), nodes).where(F.col("cos") >= threshold)
    found = sure.unionByName(decided.select("a", "own", F.col("other").alias("b"), F.col("weight").alias("found")))
    found = search.keep(found.groupBy("a", "own", "b").agg(F.sum("found").alias("found")))

    joined = components(found.select(F.col("own").alias("a"), "b").distinct())
    lowest = joined.join(balls, joined["node"] == balls["centre"]).groupBy("component").agg(F.min("low").alias("first"))
    firsts = joined.join(lowest, "component").select(F.col("node").alias("centre"), "first")
    of_balls = search.keep(
        balls.join(firsts, "centre", "left").select("centre", "rows", F.coalesce("first", "low").alias("first"))
    )
    extra = found.groupBy(F.col("a").alias("node")).agg(F.sum("found").alias("more"))
    results = search.keep(
        nodes.select("node", "h", "g", "weight")
        .join(members.select("node", "centre"), "node")
        .join(of_balls, "centre")
        .join(extra, "node", "left")
        .select(
            "h", "g", "weight", (F.col("rows") - 1 + F.coalesce("more", F.lit(0))).alias("links"), "first"
        )
    )
    out = attach(rows.select("id", "h", "g"), results, ["h", "g"], ["links", "first"], "weight", HOT_CENTRES)
    first = F.coalesce("first", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        first.alias("component_id"),
        F.col("id").eqNullSafe(first).alias("kept"),
        F.lit(recall).alias("recall"),
    )
