"""Connected components of an edge table, without collecting groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Each round gives a node the smallest label around it and then the label of its label, so long
    chains shrink by jumps. Minima are combined before the shuffle; the labels are a written table.
    """
    both = cut_lineage(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.min("other").alias("component")).withColumn("component", F.least("node", "component")))
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jump = nearer.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = cut_lineage(nearer.join(jump, "component").select("node", "before", F.least("component", "far").alias("component")))
        labels = moved.select("node", "component")
        if not moved.where("component < before").limit(1).count():
            return labels
