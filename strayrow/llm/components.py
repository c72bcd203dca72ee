"""Connected components of links between nodes, as repeated joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.functions.materialize import Scratch


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that links reach) of all nodes of ``links``.

    ``links`` has the columns ``a`` and ``b``; direction, order and repetitions do not matter.
    Every round takes the smallest label among the neighbours and then the label of that label,
    so labels travel paths of doubling length. Each round's labels are written, those before dropped.
    """
    scratch = Scratch(links.sparkSession, "components")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.keep_slim(both.where("a <> b").distinct(), "edges")
    parts = edges.rdd.getNumPartitions()
    first = edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component"))
    labels, done = scratch.keep_slim(first.coalesce(parts), "0"), 0
    while True:
        offered = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("offer"))
        )
        nearer = labels.join(offered, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "offer").alias("near")
        )
        of_label = labels.select(F.col("node").alias("near"), F.col("component").alias("jump"))
        found = nearer.join(of_label, "near").select(
            "node", F.least("near", "jump").alias("component"), "old"
        )
        new = scratch.keep_slim(found.coalesce(parts), str(done + 1))
        scratch.drop(str(done))
        labels, done = new.select("node", "component"), done + 1
        if new.where(F.col("component") != F.col("old")).isEmpty():
            scratch.drop("edges")
            return labels
