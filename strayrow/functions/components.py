"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.functions.materialize import Scratch


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node of its component) of all nodes in ``links``.

    ``links`` has the columns ``a`` and ``b``. Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii:
    Connected Components in MapReduce and Beyond, SoCC 2014: large stars and small stars in turn,
    until every node points to the smallest one. The number of links never grows, and one with many
    links gets all but one of them moved away from itself, so hot nodes fade; each grouping is
    combined before its shuffle. Rounds grow with the logarithm of the number of nodes.
    """
    spark: SparkSession = links.sparkSession
    scratch = Scratch(spark, "components")
    start = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.keep(start.distinct(), "0")
    size, before = _state(edges), None
    done = 0
    while size != before:
        done += 1
        large = scratch.keep(_starred(edges, both=True), f"{done}-large")
        following = scratch.keep(_starred(large, both=False), str(done))
        scratch.drop(str(done - 1), f"{done}-large")
        edges, before, size = following, size, _state(following)
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the links, whatever their order."""
    checked = F.xxhash64("a", "b").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)), F.sum(checked)).first()
    return tuple(row)


def _starred(edges: DataFrame, both: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them and the node.

    ``both``: a large star, which moves the neighbours above the node; else a small star, which moves
    the node and the neighbours below it. ``edges`` point from the larger to the smaller node.
    """
    pairs = edges
    if both:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    moved = pairs.join(least, "a")
    if both:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    below = moved.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return below.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
