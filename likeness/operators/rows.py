"""Row numbers, exact-size random choices and resampling without global sorts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import random as R
from ..session import cut_lineage
from .joins import match, shuffle_width, skew_join


def hashed_index(df: DataFrame, ids: list[str], seed: int, stream: str, name: str = "row_idx", buckets: int | None = None) -> DataFrame:
    """Dense number 0..n-1 in the order of a random draw per id; ``ids`` must be unique.

    Rows are dealt into equal hash ranges, numbered inside each and shifted by the sizes of
    the ranges before. The size table has at most ``buckets`` rows.
    """
    buckets = buckets or 4 * shuffle_width(df)
    width = -(-R.SPACE // buckets)
    drawn = df.withColumn("_h", R.bits(seed, stream, ids)).withColumn("_bucket", F.floor(F.col("_h") / F.lit(width)).cast("int"))
    sizes = drawn.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *ids))
    return (
        drawn.withColumn("_r", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_r") - 1)
        .drop("_h", "_bucket", "_r", "_offset")
    )


def ordered_index(df: DataFrame, keys: list[str], order: list[str], name: str = "t", blocks: int | None = None) -> DataFrame:
    """Dense number 0..n-1 per key group in ``order`` (which must be unique inside a group).

    One range shuffle splits even a single group over all tasks. The placement is written to
    the checkpoint folder, so a lost executor cannot change it (``_place`` holds partition and position). The position inside a
    partition plus the sizes of the partitions before gives the number.
    """
    blocks = blocks or shuffle_width(df)
    placed = cut_lineage(
        df.repartitionByRange(blocks, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_block", F.shiftright("_place", 33)).withColumn("_pos", F.col("_place").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = placed.join(F.broadcast(offsets), "_block").withColumn(name, F.col("_offset") + F.col("_pos"))
    if keys:
        # first position of the group, known per (group, block): no task gets a whole large group
        firsts = placed.groupBy(*keys, "_block").agg(F.min(name).alias("_first"))
        start = F.min("_first").over(Window.partitionBy(*keys))
        firsts = firsts.select(*keys, "_block", start.alias("_start"))
        placed = match(placed, firsts, [*keys, "_block"]).withColumn(name, F.col(name) - F.col("_start")).drop("_start")
    return placed.drop("_place", "_block", "_pos", "_offset")


# --- exact-size random choice --------------------------------------------------------


@dataclass
class Choice:
    """Choose ``k`` of the rows where ``eligible`` holds, by the draw of ``stream``."""

    name: str
    stream: str
    k: int
    eligible: Column | None = None


_FINE = 1_000_000  # a hash range with fewer rows is ranked directly


def _cut(counts: DataFrame, name: str, by: str, left: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """Per choice: the value of ``by`` where the running count reaches k, rows before it, rows in it."""
    goal = F.create_map(*[x for n, k in left.items() for x in (F.lit(n), F.lit(k))])[F.col(name)]
    w = Window.partitionBy(name).orderBy(by)
    run = counts.withColumn("_cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = run.where((F.col("_cum") >= goal) & (F.col("_cum") - F.col("n") < goal))
    return {r[name]: (r[by], r["_cum"] - r["n"], r["n"]) for r in hit.collect()}


def thresholds(df: DataFrame, ids: list[str], choices: list[Choice], seed: int) -> dict[str, Column]:
    """One boolean expression per choice that is true for exactly ``k`` eligible rows.

    The k smallest draws are chosen. A histogram of the top 16 bits (at most 65,536 rows per
    choice, combined before the shuffle) finds the range of the k-th draw; the same step on
    the next bits, or directly on the values, gives the exact bound. All choices share each
    scan, and only one row per choice reaches the driver.
    """
    out: dict[str, Column] = {}
    live: list[Choice] = []
    sizes = {}
    wanted = [c for c in choices if c.k > 0]
    if wanted:
        row = df.agg(*[F.count_if(F.lit(True) if c.eligible is None else F.coalesce(c.eligible, F.lit(False))).alias(c.name) for c in wanted]).first()
        sizes = {c.name: row[c.name] for c in wanted}
    for c in choices:
        yes = F.lit(True) if c.eligible is None else F.coalesce(c.eligible, F.lit(False))
        if c.k <= 0:
            out[c.name] = F.lit(False)
        elif c.k >= sizes[c.name]:
            out[c.name] = yes
        else:
            live.append(c)
    if not live:
        return out

    draws = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("choice"),
                F.when(F.lit(True) if c.eligible is None else F.coalesce(c.eligible, F.lit(False)), R.bits(seed, c.stream, ids)).alias("h"),
            )
            for c in live
        ]
    )
    long = df.select(*ids, F.explode(draws).alias("d")).select(*ids, "d.choice", "d.h").where(F.col("h").isNotNull())
    left = {c.name: c.k for c in live}
    spans = {c.name: (0, R.SPACE) for c in live}  # draw range that holds the k-th value
    for shift in (36, 20):
        coarse = [n for n in left if spans[n][1] == R.SPACE or (sizes[n] > _FINE)]
        if not coarse:
            break
        part = _inside(long, {n: spans[n] for n in coarse})
        counts = part.groupBy("choice", F.shiftright("h", shift).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        for n, (b, before, rows) in _cut(counts, "choice", "b", {n: left[n] for n in coarse}).items():
            left[n] -= before
            spans[n] = (b << shift, (b + 1) << shift)
            sizes[n] = rows
    part = _inside(long, spans)
    exact = _cut(part.groupBy("choice", "h").agg(F.count(F.lit(1)).alias("n")), "choice", "h", left)
    ties = {n: (h, left[n] - before) for n, (h, before, rows) in exact.items() if left[n] - before < rows}
    last_ids = _tie_ids(long, ids, ties) if ties else {}
    for c in live:
        yes = F.lit(True) if c.eligible is None else F.coalesce(c.eligible, F.lit(False))
        h = R.bits(seed, c.stream, ids)
        bound = exact[c.name][0]
        if c.name in last_ids:
            last = F.struct(*[F.lit(v).cast(df.schema[i].dataType).alias(i) for i, v in zip(ids, last_ids[c.name])])
            tie = (h == F.lit(bound)) & (F.struct(*ids) <= last)
            out[c.name] = yes & ((h < F.lit(bound)) | tie)
        else:
            out[c.name] = yes & (h <= F.lit(bound))
    return out


def _inside(long: DataFrame, spans: dict[str, tuple[int, int]]) -> DataFrame:
    keep = F.lit(False)
    for n, (lo, hi) in spans.items():
        keep = keep | ((F.col("choice") == n) & (F.col("h") >= F.lit(lo)) & (F.col("h") < F.lit(hi)))
    return long.where(keep)


def _tie_ids(long: DataFrame, ids: list[str], ties: dict[str, tuple[int, int]]) -> dict[str, list]:
    """Different ids with the same draw: the last id that still belongs to the choice."""
    keep = F.lit(False)
    for n, (h, _) in ties.items():
        keep = keep | ((F.col("choice") == n) & (F.col("h") == F.lit(h)))
    rows = long.where(keep).groupBy("choice", *ids).agg(F.count(F.lit(1)).alias("n"))
    if rows.where("n > 1").limit(1).count():
        raise ValueError(f"{ids} must identify a row")
    found: dict[str, list] = {}
    for n, (_, need) in ties.items():
        found[n] = [tuple(r) for r in rows.where(F.col("choice") == n).orderBy(*ids).select(*ids).limit(need).collect()][-1]
    return found


def resample(df: DataFrame, ids: list[str], target: int, seed: int, stream: str) -> DataFrame:
    """Exactly ``target`` rows: a random subset, or all rows plus draws with replacement.

    Adds ``copy``: 0 for an original row, 1.. for an extra draw.
    """
    target = max(1, int(target))
    n = df.count()
    if n == 0 or n == target:
        return df.withColumn("copy", F.lit(0).cast("bigint"))
    if n > target:
        keep = thresholds(df, ids, [Choice("keep", stream, target)], seed)["keep"]
        return df.where(keep).withColumn("copy", F.lit(0).cast("bigint"))
    index = hashed_index(df, ids, seed, stream + ".index")
    extra = df.sparkSession.range(1, target - n + 1).withColumnRenamed("id", "copy").withColumn("row_idx", R.below(seed, stream + ".extra", "copy", n))
    return df.withColumn("copy", F.lit(0).cast("bigint")).unionByName(skew_join(extra, index, ["row_idx"]).drop("row_idx"))
