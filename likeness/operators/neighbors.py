"""Exact nearest neighbours between two tables of points, without comparing all pairs.

Equal points become one with a count, so no group of copies is ever gathered. A tree of median
splits over a sample of the source cuts the space into boxes; a point goes to its box, each box is one
group of a cogrouped task. A query point finds its neighbours in its own box first; only where the
distance to the k-th reaches over the box's border it also visits the boxes that lie within that
distance. The sample decides how even the boxes are, never the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PER_BOX = 2000  # source points that a box should hold
MOST_BOXES = 65_536  # bounds the box table that every task gets (16 bytes per dimension and box)
SAMPLE_PER_BOX = 10


class Boxes:
    """Median splits along the widest side; plain arrays, sent to the tasks by value."""

    def __init__(self, sample: np.ndarray, boxes: int):
        d = sample.shape[1]
        self.axis, self.cut, self.left, self.right = [], [], [], []
        lows, highs = [], []

        def grow(rows: np.ndarray, want: int, low: np.ndarray, high: np.ndarray) -> int:
            spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(d)
            if want < 2 or not spread.max() > 0:
                lows.append(low)
                highs.append(high)
                return -len(lows)  # box number is -value - 1
            axis = int(spread.argmax())
            cut = float(np.median(rows[:, axis]))
            under = rows[:, axis] < cut
            if not under.any():
                cut = float(rows[rows[:, axis] > cut, axis].min())
                under = rows[:, axis] < cut
            here = len(self.axis)
            for part in (self.axis, self.cut, self.left, self.right):
                part.append(0)
            self.axis[here], self.cut[here] = axis, cut
            top, bottom = high.copy(), low.copy()
            top[axis] = bottom[axis] = cut
            self.left[here] = grow(rows[under], want // 2, low, top)
            self.right[here] = grow(rows[~under], want - want // 2, bottom, high)
            return here

        self.root = grow(sample, boxes, np.full(d, -np.inf), np.full(d, np.inf))
        self.low, self.high = np.array(lows), np.array(highs)
        self.axis, self.cut, self.left, self.right = np.array(self.axis, int), np.array(self.cut), np.array(self.left, int), np.array(self.right, int)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The box of each point."""
        at = np.full(len(x), self.root)
        while len(live := np.flatnonzero(at >= 0)):
            node = at[live]
            at[live] = np.where(x[live, self.axis[node]] < self.cut[node], self.left[node], self.right[node])
        return -at - 1

    def within(self, x: np.ndarray, own: int, reach: np.ndarray) -> list[list[int]]:
        """Other boxes not farther (squared) from each point than ``reach``."""
        out = []
        for p, r in zip(x, reach):
            gap = np.maximum(np.maximum(self.low - p, p - self.high), 0.0)
            near = np.flatnonzero((gap * gap).sum(1) <= r + 1e-9)
            out.append([int(b) for b in near if b != own])
        return out


def _nearest(points: np.ndarray, weight: np.ndarray, order: np.ndarray, x: np.ndarray, k: int):
    """For each row of ``x``: indexes of the nearest points until their weights reach k, and the last distance (infinite if they never do)."""
    for start in range(0, len(x), 128):
        part = x[start : start + 128]
        dist = np.zeros((len(part), len(points)))
        for j in range(points.shape[1]):
            dist += (points[None, :, j] - part[:, j, None]) ** 2
        dist = np.round(dist, 9)
        some = min(k, len(points))
        edge = np.partition(dist, some - 1, axis=1)[:, some - 1]
        for r in range(len(part)):
            at = np.flatnonzero(dist[r] <= edge[r])
            at = at[np.lexsort((order[at], dist[r, at]))]
            enough = np.searchsorted(np.cumsum(weight[at]), k) + 1
            full = enough <= len(at)
            at = at[:enough]
            yield start + r, at, dist[r, at], (dist[r, at[-1]] if full else np.inf)


def neighbour_means(queries: DataFrame, source: DataFrame, dims: int, scale: list[tuple[float, float]], k: int) -> DataFrame:
    """(x0.., m0..): the mean of the k nearest source rows of each distinct query point.

    ``queries`` has x0.. (doubles without nulls); ``source`` has x0.., ``order`` (ties go to the lower one)
    and ``copies``, one row per distinct point. ``scale`` is (mean, deviation) per dimension; distances are
    squared and rounded to 9 digits.
    """
    xs = [f"x{i}" for i in range(dims)]
    mean, sd = (np.array([s[i] for s in scale]) for i in (0, 1))
    n = source.count()
    boxes = max(1, min(MOST_BOXES, n // PER_BOX))
    sample = source.select(*xs)
    sample = sample.sample(min(1.0, SAMPLE_PER_BOX * boxes / n), 42) if boxes > 1 else sample.limit(0)
    tree = Boxes(((sample.toPandas().to_numpy(float).reshape(-1, dims)) - mean) / sd, boxes)

    @F.pandas_udf("int")
    def box(*cols: pd.Series) -> pd.Series:
        return pd.Series(tree.of((np.column_stack(cols) - mean) / sd))

    def search(home: bool):
        def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = {"q": [], "d": [], "order": [], "copies": [], "p": [], "more": []}
            if len(asked):
                x = asked[xs].to_numpy(float)
                z = (x - mean) / sd
                raw = points[xs].to_numpy(float)
                weight, order = points["copies"].to_numpy(), points["order"].to_numpy()
                reach = np.full(len(x), np.inf)
                if len(raw):
                    for r, at, dist, last in _nearest((raw - mean) / sd, weight, order, z, k):
                        reach[r] = last
                        for i, d in zip(at, dist):
                            for name, value in zip(out, (x[r].tolist(), float(d), int(order[i]), int(weight[i]), raw[i].tolist(), None)):
                                out[name].append(value)
                if home:
                    for r, others in enumerate(tree.within(z, int(asked["box"].iloc[0]), reach)):
                        if others:
                            for name, value in zip(out, (x[r].tolist(), None, None, None, None, others)):
                                out[name].append(value)
            return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in out.items()})

        return run

    found = "q array<double>, d double, order bigint, copies bigint, p array<double>, more array<int>"
    boxed = cut_lineage(source.withColumn("box", box(*xs)))
    asked = queries.select(*xs).distinct().withColumn("box", box(*xs))
    first = cut_lineage(boxed.groupBy("box").cogroup(asked.groupBy("box")).applyInPandas(search(True), found))
    again = first.where("more IS NOT NULL").select(*[F.col("q")[i].alias(f"x{i}") for i in range(dims)], F.explode("more").alias("box"))
    second = boxed.groupBy("box").cogroup(again.groupBy("box")).applyInPandas(search(False), found)
    near = first.where("d IS NOT NULL").unionByName(second).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "order", "copies", "p"))).alias("near"))
    # at most k points per visited box stand here; they are taken in order until their copies reach k
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.array(*[F.lit(0.0)] * dims).alias("s"))

    def add(acc, e):
        take = F.least(e["copies"], F.lit(k) - acc["n"])
        return F.struct((acc["n"] + take).alias("n"), F.zip_with(acc["s"], e["p"], lambda a, b: a + b * take).alias("s"))

    total = near.select("q", F.aggregate("near", zero, add).alias("t"))
    return total.select(*[F.col("q")[i].alias(f"x{i}") for i in range(dims)], *[(F.col("t.s")[i] / F.col("t.n")).alias(f"m{i}") for i in range(dims)])
