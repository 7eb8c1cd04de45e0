"""Layering and row-count propagation on an edge table of any size and depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import heavy_keys, skew_join

CHILD_FACTOR = 5  # rows per parent row on a 1:N edge
MOST = (1 << 63) - 1  # row counts end here


def _times(rows: Column | str, factor: Column | str) -> Column:
    return F.coalesce(F.try_multiply(F.col(rows) if isinstance(rows, str) else rows, F.col(factor) if isinstance(factor, str) else factor), F.lit(MOST))


def _contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Long chains made short: edges(parent, child, steps, factor) and, per round, the nodes taken out with the edge that leads to them.

    A node with one edge in and one out can be skipped: its two edges become one. A coin per node and
    round keeps neighbours from going together, so a chain shrinks by a constant share per round.
    """
    taken: list[DataFrame] = []
    while True:
        into = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent"), F.first("steps").alias("steps"), F.first("factor").alias("factor")).where("n = 1")
        out = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("m")).where("m = 1")
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(len(taken))), F.lit(2))
        chosen = into.join(out.select(F.col("parent").alias("child")), "child").where((F.col("parent") != F.col("child")) & (coin("child") == 1) & (coin("parent") == 0))
        chosen = cut_lineage(chosen.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.col("steps").alias("up_steps"), F.col("factor").alias("up_factor")))
        n, total = chosen.count(), edges.count()
        if n * 20 < total or not n:
            return edges, taken
        taken.append(chosen)
        bridged = edges.join(chosen.select(F.col("node").alias("parent"), "up", "up_steps", "up_factor"), "parent", "left")
        bridged = bridged.join(chosen.select(F.col("node").alias("child"), F.lit(True).alias("gone")), "child", "left").where("gone IS NULL")
        edges = cut_lineage(
            bridged.select(F.coalesce("up", "parent").alias("parent"), "child", (F.col("steps") + F.coalesce("up_steps", F.lit(0))).alias("steps"), _times("factor", F.coalesce("up_factor", F.lit(1).cast("bigint"))).alias("factor"))
        )


def plan_rows(nodes: DataFrame, edges: DataFrame, base_rows: int = 100) -> DataFrame:
    """(node, tier, rows) for nodes(node) and edges(parent, child, cardinality).

    A node without parents is in tier 0 and has ``base_rows``. A node is one tier below its deepest
    parent and gets the largest parent count, times 5 unless the edge is ``1:1`` (at most 2**63 - 1).
    Nodes on or behind a cycle form the last tier, where a parent without a count stands for
    ``base_rows``.

    Chains are contracted first, so the rounds follow the depth of the branching, not of the
    graph. A round joins the open edges with the freshly placed nodes only and appends them to one
    list of written tables; edges of a parent with very many children are dealt over several tasks.
    """
    factor = F.when(F.coalesce("cardinality", F.lit("1:N")) == "1:1", 1).otherwise(CHILD_FACTOR)
    given = cut_lineage(edges.select("parent", "child", factor.cast("bigint").alias("factor")).distinct())
    every = nodes.select("node").union(given.select("parent")).union(given.select("child")).distinct()
    left, taken = _contracted(given.withColumn("steps", F.lit(1)))
    heavy = heavy_keys(left, ["parent"])

    roots = every.join(given.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    fresh = cut_lineage(roots.select("node", F.lit(0).alias("tier"), F.lit(base_rows).cast("bigint").alias("rows")))
    placed, pending = [fresh], None
    while True:
        met = cut_lineage(skew_join(left, fresh.withColumnRenamed("node", "parent"), ["parent"], "left", heavy=heavy))
        left = met.where("rows IS NULL").select("parent", "child", "steps", "factor")
        reached = met.where("rows IS NOT NULL").select("child", (F.col("tier") + F.col("steps")).alias("tier"), _times("rows", "factor").alias("rows"))
        if pending is not None:
            reached = pending.unionByName(reached)
        reached = reached.groupBy("child").agg(F.max("tier").alias("tier"), F.max("rows").alias("rows"))
        state = cut_lineage(reached.join(left.select("child").distinct().withColumn("_wait", F.lit(True)), "child", "left"))
        fresh = state.where("_wait IS NULL").select(F.col("child").alias("node"), "tier", "rows")
        pending = state.where("_wait").drop("_wait")
        if fresh.isEmpty():
            break
        placed.append(fresh)
    done = reduce(DataFrame.unionByName, placed)
    for step in reversed(taken):  # nodes taken out last come back first
        back = step.join(done.withColumnRenamed("node", "up"), "up").select("node", (F.col("tier") + F.col("up_steps")).alias("tier"), _times("rows", "up_factor").alias("rows"))
        done = cut_lineage(done.unionByName(back))
    if left.isEmpty():
        return done.select("node", "tier", "rows")
    done = cut_lineage(done)
    last = done.agg(F.coalesce(F.max("tier"), F.lit(-1)) + 1).first()[0]
    rest = given.join(done.select(F.col("node").alias("child")), "child", "left_anti").join(done.select(F.col("node").alias("parent"), "rows"), "parent", "left")
    rest = rest.groupBy("child").agg(F.max(_times(F.coalesce("rows", F.lit(base_rows).cast("bigint")), "factor")).alias("rows"))
    return done.unionByName(rest.select(F.col("child").alias("node"), F.lit(last).alias("tier"), "rows")).select("node", "tier", "rows")


def tiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, tier) only."""
    return plan_rows(nodes, edges.withColumn("cardinality", F.lit("1:1"))).select("node", "tier")
