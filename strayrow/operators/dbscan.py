"""Density clustering; rows in no dense place are outliers.

Ester, Kriegel, Sander, Xu: A density-based algorithm for discovering clusters, KDD 1996, by the grid
of Gunawan and of Gan, Tao (DBSCAN Revisited, SIGMOD 2015). Space is cut into cells so small that all
points of a cell are within ``eps`` of each other, so a cell with ``min_rows`` rows needs no distances:
all its points are core. Only points of sparse cells, of which a cell has less than ``min_rows``, are
held against the points of cells nearby; points of crowded cells are dealt out to several tasks. Core
points of a cell are in one cluster, so clusters are connected components of cells. Whether two cells
are linked is decided by the bounding boxes of their core points, which are split again and again
where they leave it open and hold many points; only small boxes are compared point by point.

Copies are one point with a weight. Cells that may be near are found by an equi-join on coarse
coordinates of at most three features; with many more features, more cells share these. Nothing is
collected but counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col
from strayrow.functions.components import connected_components
from strayrow.functions.materialize import Scratch
from strayrow.functions.ranking import score_distribution
from strayrow.functions.skew import attach
from strayrow.operators.scaling import SCORE_SCALE, prepare
from strayrow.operators.scoring import finish

# Neighbourhood and density of common practice.
EPS = 0.5
MIN_ROWS = 5

POINTS_PER_TASK = 20_000
PAIRS = 2_500
_ROOM = 1e-9
_COARSE = 3
_SPLIT = 4
_DEEPEST = 12


class _Grid:
    def __init__(self, points: DataFrame, scratch: Scratch, dims: int, eps: float, min_rows: int):
        """``points`` have ``node``, ``weight``, ``label`` and the coordinates x0, x1 …"""
        self.scratch, self.dims, self.min_rows = scratch, dims, min_rows
        self.side = eps / math.sqrt(dims) * (1 - _ROOM)
        self.near2 = eps * eps
        self.x = [f"x{i}" for i in range(dims)]
        self.c = [f"c{i}" for i in range(dims)]
        placed = points.withColumns(dict(zip(self.c, self._coordinates(1))))
        cells = placed.groupBy(*self.c).agg(F.sum("weight").alias("rows"), F.count(F.lit(1)).alias("nodes"))
        parts = F.ceil(F.col("nodes") / POINTS_PER_TASK).alias("parts")
        numbered = F.monotonically_increasing_id().alias("cell")
        self.cells = scratch.keep(cells.select(numbered, *self.c, "rows", parts), "cells")
        self.points = scratch.keep(
            placed.join(self.cells, self.c).select(
                "node", "weight", "label", "cell", "rows",
                F.pmod(F.xxhash64("node"), "parts").alias("part"), *self.x,
            ),
            "points",
        )
        self.pairs = scratch.keep(self._neighbours(), "pairs")

    def _coordinates(self, finer: int) -> list[Column]:
        return [F.floor(F.col(x) / F.lit(self.side / finer)) for x in self.x]

    def _neighbours(self) -> DataFrame:
        """Pairs ``a`` < ``b`` of cells of which some places are within reach of each other."""
        wide = math.floor(math.sqrt(self.dims)) + 1
        keys = self.c[:_COARSE]
        a = self.cells.select(F.col("cell").alias("a"), *[F.col(c).alias(f"a{c}") for c in self.c])
        b = self.cells.select(F.col("cell").alias("b"), *[F.col(c).alias(f"b{c}") for c in self.c])
        for k in keys:
            step = F.explode(F.array(*[F.lit(s) for s in (-1, 0, 1)])).alias("step")
            a = a.select("*", step).withColumn(f"k{k}", F.floor(F.col(f"a{k}") / wide) + F.col("step")).drop("step")
            b = b.withColumn(f"k{k}", F.floor(F.col(f"b{k}") / wide))
        apart = [F.greatest(F.abs(F.col(f"a{c}") - F.col(f"b{c}")) - 1, F.lit(0)) for c in self.c]
        close = sum((d * d for d in apart), F.lit(0)) <= self.dims
        return a.join(b, [f"k{k}" for k in keys]).where(close & (F.col("a") < F.col("b"))).select("a", "b")

    def around(self, sparse: DataFrame, others: DataFrame) -> DataFrame:
        """Each point of ``sparse`` with the points of ``others`` within reach in other cells.

        Columns of ``others`` get the prefix ``o_``.
        """
        both = self.pairs.unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parts = self.cells.select(F.col("cell").alias("b"), "parts")
        asked = (
            sparse.select("node", F.col("cell").alias("a"), *self.x)
            .join(both, "a")
            .join(parts, "b")
            .select("node", *self.x, F.col("b").alias("o_cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o_part"))
        )
        named = others.select(*[F.col(c).alias(f"o_{c}") for c in others.columns])
        return asked.join(named, ["o_cell", "o_part"]).where(self._squared() <= F.lit(self.near2))

    def _squared(self) -> Column:
        return sum(((F.col(x) - F.col(f"o_{x}")) * (F.col(x) - F.col(f"o_{x}")) for x in self.x), F.lit(0.0))

    def counted(self) -> DataFrame:
        """All points with the number of rows in reach, where it decides, and ``core``."""
        sparse = self.points.where(F.col("rows") < self.min_rows)
        more = self.around(sparse, self.points).groupBy("node").agg(F.sum("o_weight").alias("more"))
        seen = F.col("rows") + F.coalesce("more", F.lit(0))
        found = self.points.join(more, "node", "left").withColumn("seen", seen).drop("more")
        return self.scratch.keep(found.withColumn("core", F.col("seen") >= self.min_rows), "counted")

    # Which cells are linked

    def _boxes(self, core: DataFrame, finer: int) -> DataFrame:
        """Boxes around the core points of each part of a cell; ``above`` is the part it came from."""
        sub = F.array(*self._coordinates(finer)).alias("sub")
        above = F.array(*self._coordinates(max(1, finer // _SPLIT))).alias("above")
        lows = [F.min(x).alias(f"lo{i}") for i, x in enumerate(self.x)]
        highs = [F.max(x).alias(f"hi{i}") for i, x in enumerate(self.x)]
        parts = core.select("cell", sub, above, *self.x)
        return parts.groupBy("cell", "above", "sub").agg(F.count(F.lit(1)).alias("n"), *lows, *highs)

    def links(self, core: DataFrame) -> DataFrame:
        """Pairs of cells that hold core points within reach of each other."""
        live = core.select("cell").distinct()
        todo = self.pairs.join(live.withColumnRenamed("cell", "a"), "a", "left_semi").join(
            live.withColumnRenamed("cell", "b"), "b", "left_semi"
        )
        waiting = todo.select("a", "b", F.lit(None).cast("array<bigint>").alias("sa"), F.lit(None).cast("array<bigint>").alias("sb"))
        found, finer = [], 1
        for level in range(_DEEPEST + 1):
            boxes = self._boxes(core, finer)
            for side, cell in (("a", "a"), ("b", "b")):
                named = boxes.select(
                    F.col("cell").alias(cell), F.col("above").alias(f"s{side}"), F.col("sub").alias(f"sub_{side}"),
                    *[F.col(c).alias(f"{c}_{side}") for c in boxes.columns[3:]],
                )
                keys = [cell] if level == 0 else [cell, f"s{side}"]
                waiting = waiting.join(named if level else named.drop(f"s{side}"), keys)
            least, most = F.lit(0.0), F.lit(0.0)
            for i in range(self.dims):
                lo_a, hi_a, lo_b, hi_b = (F.col(f"{e}{i}_{s}") for s in "ab" for e in ("lo", "hi"))
                gap = F.greatest(lo_b - hi_a, lo_a - hi_b, F.lit(0.0))
                span = F.greatest(F.abs(hi_b - lo_a), F.abs(hi_a - lo_b))
                least, most = least + gap * gap, most + span * span
            judged = waiting.select(
                "a", "b", F.col("sub_a").alias("sa"), F.col("sub_b").alias("sb"),
                (F.col("n_a") * F.col("n_b")).alias("pairs"), least.alias("least"), most.alias("most"),
            ).where(F.col("least") <= F.lit(self.near2))
            judged = self.scratch.keep(judged, f"judged{level}")
            linked = judged.where(F.col("most") <= F.lit(self.near2)).select("a", "b").distinct()
            unsettled = judged.join(linked, ["a", "b"], "left_anti")
            small = unsettled.where(F.lit(level == _DEEPEST) | (F.col("pairs") <= PAIRS))
            met = self.scratch.keep(self._met(core, small, finer), f"met{level}")
            found += [linked, met]
            waiting = unsettled.where(F.col("pairs") > PAIRS).join(met, ["a", "b"], "left_anti").select("a", "b", "sa", "sb")
            if level == _DEEPEST or waiting.isEmpty():
                break
            finer *= _SPLIT
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.distinct()

    def _met(self, core: DataFrame, small: DataFrame, finer: int) -> DataFrame:
        """Pairs of cells whose small boxes hold core points within reach."""
        placed = core.select("cell", F.array(*self._coordinates(finer)).alias("sub"), *self.x)
        a = placed.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), *self.x)
        b = placed.select(F.col("cell").alias("b"), F.col("sub").alias("sb"), *[F.col(x).alias(f"o_{x}") for x in self.x])
        met = small.select("a", "b", "sa", "sb").join(a, ["a", "sa"]).join(b, ["b", "sb"])
        return met.where(self._squared() <= F.lit(self.near2)).select("a", "b").distinct()


def dbscan(
    df: DataFrame,
    features: list[str],
    eps: float = EPS,
    min_rows: int = MIN_ROWS,
    key: list[str] | None = None,
) -> DataFrame:
    """Add ``cluster``, ``core`` and the columns of a detector; rows in no cluster are flagged.

    Features are imputed and scaled as for the other models. A row is core if at least ``min_rows``
    rows, itself included, lie within ``eps``; clusters are what core rows link, and other rows
    within reach of a core row belong to its cluster (to the one that is named first, if there are
    several). A cluster is named after the smallest ``key`` (a struct, if there are several columns)
    among its core rows, or by a number if there is no key; rows without a cluster have null. The
    score falls from 10 to 0 as the rows within reach grow to ``min_rows``; it is 0 for core rows.
    """
    prepared = prepare(df, features)
    scratch = Scratch(df.sparkSession, "dbscan")
    names = prepared.names
    # Adding zero makes the two zeros one, as the join of rows with points asks for.
    coordinates = [(c + F.lit(0.0)).alias(n) for n, c in zip(names, prepared.scaled)]
    label = F.lit(None).cast("long") if not key else col(key[0]) if len(key) == 1 else F.struct(*map(col, key))
    copies = prepared.rows.select(*coordinates, label.alias("label"))
    merged = copies.groupBy(*names).agg(F.count(F.lit(1)).alias("weight"), F.min("label").alias("label"))
    points = scratch.keep(merged.select(F.monotonically_increasing_id().alias("node"), "weight", "label", *names), "merged")
    if not key:
        points = points.withColumn("label", F.col("node"))

    grid = _Grid(points, scratch, len(names), float(eps), int(min_rows))
    counted = grid.counted()
    core = counted.where("core")
    joined = connected_components(grid.links(core))
    of_cell = core.groupBy("cell").agg(F.min("label").alias("least"))
    with_root = of_cell.join(joined, of_cell["cell"] == joined["node"], "left").select(
        "cell", "least", F.coalesce("component", "cell").alias("root")
    )
    with_root = scratch.keep(with_root, "roots")
    of_root = with_root.groupBy("root").agg(F.min("least").alias("cluster"))
    clusters = scratch.keep(with_root.join(of_root, "root").select("cell", "cluster"), "clusters")

    edge = counted.where(~F.col("core"))
    near_core = core.join(clusters, "cell").select("cell", "part", "cluster", *names)
    reached = grid.around(edge, near_core).groupBy("node").agg(F.min("o_cluster").alias("beside"))
    own = counted.join(clusters, "cell", "left").join(reached, "node", "left")
    # A point that shares a cell with a core point is within reach of it.
    cluster = F.when(F.col("core"), F.col("cluster")).otherwise(
        F.when(F.col("beside") < F.col("cluster"), F.col("beside")).otherwise(F.coalesce("cluster", "beside"))
    )
    missing = F.greatest(F.lit(min_rows) - F.col("seen"), F.lit(0))
    found = scratch.keep(
        own.select(
            *names, "weight", cluster.alias("cluster"), "core",
            (F.lit(SCORE_SCALE) * missing / F.lit(float(min_rows))).alias("score"),
        ),
        "found",
    )
    placed = {n: c for n, c in zip([f"_p{i}" for i in range(len(names))], prepared.scaled)}
    rows = prepared.rows.withColumns({n: c + F.lit(0.0) for n, c in placed.items()})
    named = found.withColumnsRenamed(dict(zip(names, placed)))
    named = named.withColumnsRenamed({"cluster": "_cluster", "core": "_core", "score": "_score"})
    labelled = attach(rows, named, list(placed), ["_cluster", "_core", "_score"], "weight")
    distribution = score_distribution(labelled, F.col("_score"))
    out = finish(labelled, F.col("_cluster").isNull(), F.col("_score"), distribution)
    return out.withColumns({"cluster": F.col("_cluster"), "core": F.col("_core")}).drop(*placed, "_cluster", "_core", "_score")
