"""Seasonal-trend decomposition by loess (STL), with one series split over many tasks.

The inner loop smooths each phase of the season over the cycles, takes the low frequencies out of
that, and smooths what remains without the season as the trend. The outer loop lowers the weight of
points with large residuals. Every step looks at a bounded number of neighbours, so a block of
positions with a margin (``halo``) of all those neighbours gives the same values inside as the whole
series. Only the median of the absolute residuals, one number per series and outer round, is
shared. A block holds about twice its margin, a few seasons, whatever the length of the series.

Local lines are fitted with tricube weights; a span longer than the series widens the weights in
proportion. Where robustness weights leave a window empty, it is fitted without them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .joins import match
from .profile import _c

BLOCK_ROWS = 1 << 16
NOISE = 1e-11  # a median residual below this share of the largest value is rounding noise: no point loses weight
WHOLE_MEDIAN = 1_000_000  # rows of a series up to which its median is taken by one aggregation


# --- numpy part --------------------------------------------------------------------------


def odd(x: float) -> int:
    """The least odd whole number that is not below x."""
    n = int(np.ceil(x))
    return n + 1 - n % 2


def spans(period: int, seasonal: int) -> tuple[int, int]:
    """(trend, low-pass) spans that go with a period and a seasonal span."""
    return odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period + 1)


def halo(period: int, seasonal: int, inner: int) -> int:
    """How many positions away a value can change the result of ``inner`` rounds; next to an end of the series a window reaches a whole span."""
    trend, low = spans(period, seasonal)
    return inner * (seasonal * period + period + 1 + low + trend) + period


def _line(s0, s1, s2, t0, t1):
    """Value at 0 of the weighted least-squares line from its sums; the weighted mean where all weight is in one place."""
    det = s0 * s2 - s1 * s1
    flat = det <= 1e-9 * s0 * s0
    with np.errstate(all="ignore"):
        return np.where(flat, t0 / s0, (s2 * t0 - s1 * t1) / np.where(flat, 1.0, det))


def _fit(x, y, w, at, reach):
    """Local lines through (x, y) with weights ``w`` at the places ``at``, whose weights end at ``reach``; all of x is in each window."""
    d = x[None, :] - at[:, None]
    u = np.minimum(np.abs(d) / np.maximum(reach, 1e-12)[:, None], 1.0)
    k = (1 - u**3) ** 3
    kw = k * w[None, :]
    empty = kw.sum(1) <= 0
    kw[empty] = k[empty]
    return _line(kw.sum(1), (kw * d).sum(1), (kw * d * d).sum(1), kw @ y, (kw * d) @ y)


def loess(y, span: int, w, before: int = 0, after: int = 0):
    """Local lines over equally spaced values with weights ``w``, also ``before`` and ``after`` places beyond the ends."""
    n = len(y)
    half = span // 2
    x = np.arange(n, dtype=float)
    if span >= n:  # every window is the whole series, with wider weights where the span is longer
        at = np.arange(-before, n + after, dtype=float)
        reach = np.maximum(at, n - 1 - at) * (span / n if span > n else 1.0)
        return _fit(x, y, w, at, reach)
    edge = lambda at, lo: _fit(x[lo : lo + span], y[lo : lo + span], w[lo : lo + span], at, np.maximum(at - lo, lo + span - 1 - at))
    first = edge(np.arange(-before, half, dtype=float), 0)
    last = edge(np.arange(n - half, n + after, dtype=float), n - span)
    d = np.arange(-half, half + 1, dtype=float)
    k = (1 - np.abs(d / half) ** 3) ** 3 if half else np.ones(1)
    sums = [np.correlate(v, c, "valid") for v, c in ((w, k), (w, k * d), (w, k * d * d), (w * y, k), (w * y, k * d))]
    middle = _line(*sums)
    for i in np.flatnonzero(sums[0] <= 0):
        middle[i] = edge(np.array([i + half], float), i)[0]
    return np.concatenate([first, middle, last])


def _moving(y, n: int):
    """Means of all windows of n values."""
    return np.correlate(y, np.full(n, 1.0 / n), "valid")


def inner_rounds(y, trend, w, period: int, seasonal: int, rounds: int):
    """(trend, season) after some rounds of the inner loop."""
    n = len(y)
    trend_span, low_span = spans(period, seasonal)
    ones = np.ones(n)
    for _ in range(rounds):
        flat = y - trend
        cycles = np.empty(n + 2 * period)
        for p in range(period):  # the phases by place: values p, p + period, ... of this block
            cycles[p::period] = loess(flat[p::period], seasonal, w[p::period], 1, 1)
        low = loess(_moving(_moving(_moving(cycles, period), period), 3), low_span, ones)
        season = cycles[period : period + n] - low
        trend = loess(y - season, trend_span, w)
    return trend, season


# --- Spark part --------------------------------------------------------------------------


def with_margin(df: DataFrame, before: Column, after: Column, rows: Column, last: Column, t: str = "t") -> DataFrame:
    """Copies every row into each block of ``rows`` positions (``_b``) whose margin it lies in; ``last`` is the last position of its series."""
    at = F.col(t)
    least, most = F.greatest(F.floor((at - after) / rows), F.lit(0)), F.least(F.floor((at + before) / rows), F.floor(last / rows))
    return df.withColumn("_b", F.explode(F.sequence(least.cast("bigint"), most.cast("bigint"))))


def medians(df: DataFrame, keys: list[str], column: str, counts: DataFrame, largest: int) -> DataFrame:
    """(keys, median) of a column without nulls; ``counts`` has (keys, n).

    Long series find the middle values by their bits, sixteen at a time, from counts that are combined before the shuffle.
    """
    if largest <= WHOLE_MEDIAN:
        return df.groupBy(*keys).agg(F.median(_c(column)).alias("median"))
    one = [*keys, "_one"]
    live = df.select(*keys, _ordered_bits(_c(column)).alias("_bits")).withColumn("_one", F.lit(1))
    want = counts.select(*keys, F.lit(1).alias("_one"), F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("_rank"))
    want = want.withColumn("_left", F.col("_rank")).withColumn("_prefix", F.lit(0).cast("bigint"))
    for shift in (48, 32, 16, 0):
        near = match(live, want.select(*one, "_prefix").distinct(), one) if shift < 48 else live
        if shift < 48:
            near = near.where(F.shiftright("_bits", shift + 16) == F.col("_prefix")).drop("_prefix")
        bins = near.groupBy(*one, F.shiftright("_bits", shift).alias("_next")).agg(F.count(F.lit(1)).alias("_k"))
        bins = cut_lineage(bins.withColumn("_parent", F.shiftright("_next", 16)))
        joined = match(want, bins, one).where("_parent = _prefix")
        w = Window.partitionBy(*one, "_rank").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        run = joined.withColumn("_until", F.sum("_k").over(w))
        hit = run.where((F.col("_until") > F.col("_left")) & (F.col("_until") - F.col("_k") <= F.col("_left")))
        want = cut_lineage(hit.select(*one, "_rank", (F.col("_left") - F.col("_until") + F.col("_k")).alias("_left"), F.col("_next").alias("_prefix")))

    @F.pandas_udf(T.DoubleType())
    def value(bits: pd.Series) -> pd.Series:
        return pd.Series(bits.to_numpy(np.int64).view(np.float64))

    return want.groupBy(*keys).agg(F.avg(value("_prefix")).alias("median"))


@F.pandas_udf(T.LongType())
def _ordered_bits(x: pd.Series) -> pd.Series:
    """Bits of doubles that are not negative; they sort like the numbers."""
    return pd.Series((x.to_numpy(np.float64) + 0.0).view(np.int64))


def stl(long: DataFrame, keys: list[str], info: DataFrame, value: str = "value", seasonal: int = 7, inner: int = 2, outer: int = 15, rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, t, value, trend, seasonal, residual, weight) of series without gaps (positions 0.. in ``t``, no nulls).

    ``info`` has (keys, n, period), with n >= 2 * period >= 4. ``seasonal``: cycles in the span that smooths
    a phase, odd, 7 or more. ``outer`` = 0 is the plain decomposition; every outer round is one pass over the rows.
    """
    if seasonal < 7 or seasonal % 2 == 0:
        raise ValueError("seasonal must be odd and at least 7")

    @F.pandas_udf(T.LongType())
    def reach(period: pd.Series) -> pd.Series:
        return period.map(lambda p: halo(int(p), seasonal, inner))

    names = [*keys, "t", value, "trend", "seasonal", "residual", "weight"]
    kinds = {f.name: f.dataType for f in long.schema.fields}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType()) if c in keys else T.LongType() if c == "t" else T.DoubleType()) for c in names])
    sizes = cut_lineage(info.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("period").cast("bigint").alias("period"), F.lit(1).alias("_one")))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    blocks = sizes.select(*keys, "_one", F.col("n").alias("_n"), F.col("period").alias("_period"), reach("period").cast("bigint").alias("_margin"))
    blocks = blocks.withColumn("_rows", F.greatest(F.lit(rows), 2 * F.col("_margin")))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        period, size, b = (int(pdf[c].iloc[0]) for c in ("_period", "_rows", "_b"))
        t = pdf["t"].to_numpy()
        y, w = pdf[value].to_numpy(float), pdf["weight"].to_numpy(float)
        trend, season = inner_rounds(y, pdf["trend"].to_numpy(float), w, period, seasonal, inner)
        core = (t >= b * size) & (t < (b + 1) * size)
        out = pdf.loc[core, [*keys, "t", value]].copy()
        out["trend"], out["seasonal"] = trend[core], season[core]
        out["residual"] = y[core] - out["trend"] - out["seasonal"]
        out["weight"] = w[core]
        return out[names]

    def one_pass(state: DataFrame) -> DataFrame:
        placed = match(state.withColumn("_one", F.lit(1)), blocks, [*keys, "_one"])
        spread = with_margin(placed, F.col("_margin"), F.col("_margin"), F.col("_rows"), F.col("_n") - 1)
        return cut_lineage(spread.drop("_one", "_margin").groupBy(*keys, "_b").applyInPandas(block, schema))

    zero, one = F.lit(0.0), F.lit(1.0)
    scale = cut_lineage(long.groupBy(*keys).agg(F.max(F.abs(_c(value).cast("double"))).alias("_scale")).withColumn("_one", F.lit(1))) if outer else None
    state = one_pass(long.select(*keys, F.col("t").cast("bigint").alias("t"), _c(value).cast("double").alias(value), zero.alias("trend"), one.alias("weight")))
    for _ in range(outer):
        away = state.withColumn("_away", F.abs("residual"))
        middle = match(medians(away, keys, "_away", sizes, largest).withColumn("_one", F.lit(1)), scale, [*keys, "_one"])
        u = F.when(F.col("median") > NOISE * F.col("_scale"), F.col("_away") / (6 * F.col("median")))
        weight = F.when(u.isNull(), one).when(u >= 1, zero).otherwise((1 - u * u) * (1 - u * u))
        state = one_pass(match(away.withColumn("_one", F.lit(1)), middle, [*keys, "_one"]).withColumn("weight", weight).select(*keys, "t", value, "trend", "weight"))
    return state
