"""Time-series analysis for many series, and for single series of any length.

A series is a key (one or more columns, possibly none) with rows in time order; the row
position 0..n-1 is the time axis. Every step works on bounded blocks of positions, so one
series may hold most of the data without ending up in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, together
from .joins import match, shuffle_width, skew_join
from .profile import _c
from .relate import safe_corr
from .rows import ordered_index
from .stl import stl, with_margin

BLOCK_ROWS = 1 << 16
HEAVY_ROWS = 1_000_000

# Labels and name hints.
LABELS = {"h": "Hourly", "min": "Minutely", "D": "Daily", "W": "Weekly", "MS": "Monthly", "QS": "Quarterly", "YS": "Yearly"}
TIME_HINTS = ["date", "time", "dt", "timestamp", "day", "month", "year", "ts"]
# A median step below so many seconds means this frequency.
STEP_LIMITS = [(3600, "min"), (86400, "h"), (6 * 86400, "D"), (20 * 86400, "W"), (60 * 86400, "MS"), (100 * 86400, "QS")]


# --- building blocks -----------------------------------------------------------------


def with_block(df: DataFrame, t: str = "t", rows: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(t) / rows).cast("bigint"))


def with_lag(df: DataFrame, keys: list[str], columns: list[str], t: str = "t", rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``prev_<column>`` (null at position 0). The last row of a block is copied into the next block."""
    at = F.col(t)
    copies = F.when((at + 1) % rows == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = with_block(df, t, rows).withColumn("_copy", F.explode(copies)).withColumn("_b", F.col("_b") + F.col("_copy"))
    w = Window.partitionBy(*keys, "_b").orderBy(t)
    out = spread.withColumns({f"prev_{c}": F.lag(_c(c)).over(w) for c in columns})
    return out.where("_copy = 0").drop("_copy", "_b")


def fill_gaps(df: DataFrame, keys: list[str], columns: list[str], t: str = "t", rows: int = BLOCK_ROWS) -> DataFrame:
    """Nulls take the last value before them; leading nulls take the first value of the series."""
    blocked = with_block(df, t, rows)
    tails = blocked.groupBy(*keys, "_b").agg(
        *[F.max_by(_c(c), F.when(_c(c).isNotNull(), F.col(t))).alias(f"_last_{c}") for c in columns],
        *[F.min_by(_c(c), F.when(_c(c).isNotNull(), F.col(t))).alias(f"_first_{c}") for c in columns],
    )
    whole = Window.partitionBy(*keys).orderBy("_b")
    past = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = tails.select(
        *keys, "_b",
        *[F.coalesce(F.last(f"_last_{c}", True).over(past), F.first(f"_first_{c}", True).over(every)).alias(f"_carry_{c}") for c in columns],
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    joined = match(blocked, carry, [*keys, "_b"])
    filled = {c: F.coalesce(F.last(_c(c), True).over(inside), F.col(f"_carry_{c}")) for c in columns}
    return joined.withColumns(filled).drop("_b", *[f"_carry_{c}" for c in columns])


def running_sum(df: DataFrame, keys: list[str], column: str, out: str, t: str = "t", rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds the sum of ``column`` over positions 0..t."""
    blocked = with_block(df, t, rows)
    sums = blocked.groupBy(*keys, "_b").agg(F.sum(_c(column)).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return match(blocked, offsets, [*keys, "_b"]).withColumn(out, F.sum(_c(column)).over(inside) + F.col("_before")).drop("_b", "_before")


def moving_average(df: DataFrame, keys: list[str], column: str, window: Column, n: Column, out: str = "ma", t: str = "t", rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, t, column, out): centred average with zeros beyond both ends; the divisor is always ``window``.

    ``window`` and the series length ``n`` are columns, so every series can have its own. A block
    of positions, at least as long as the window, brings along the rows of its margin, and all its
    averages are made in one pass. Sums are taken over deviations from the block's mean, so values far
    from zero keep their digits. (A season of steps of 100 days and more has under a million rows, as
    timestamps end; other seasons have at most 1,440.)
    """
    base = df.select(*keys, t, _c(column).cast("double").alias("_x"), window.cast("bigint").alias("_w"), n.cast("bigint").alias("_n"))
    w = F.col("_w")
    base = base.withColumn("_rows", F.greatest(F.lit(rows), w))
    spread = with_margin(base, F.floor(w / 2), F.floor((w - 1) / 2), F.col("_rows"), F.col("_n") - 1, t)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        w, n, size, b = (int(pdf[c].iloc[0]) for c in ("_w", "_n", "_rows", "_b"))
        at, x = pdf[t].to_numpy(), pdf["_x"].to_numpy(float)
        middle = float(np.mean(x))
        middle = middle if np.isfinite(middle) else 0.0
        sums = np.concatenate([[0.0], np.cumsum(x - middle)])
        core = (at >= b * size) & (at < (b + 1) * size)
        here = at[core]
        low, high = np.maximum(here - w // 2, 0), np.minimum(here + (w - 1) // 2, n - 1)
        made = pdf.loc[core, [*keys, t]].copy()
        made[column] = x[core]
        made[out] = (sums[high + 1 - at[0]] - sums[low - at[0]] + middle * (high - low + 1)) / w
        return made

    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [*[T.StructField(c, kinds[c]) for c in keys], T.StructField(t, kinds[t]), T.StructField(column, T.DoubleType()), T.StructField(out, T.DoubleType())]
    return spread.groupBy(*keys, "_b").applyInPandas(block, T.StructType(fields))


# --- frequency and season ------------------------------------------------------------


def steps(df: DataFrame, keys: list[str], ts: str, t: str = "t", rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, t, step) seconds between neighbouring rows in time order."""
    lagged = with_lag(df.select(*keys, t, ts), keys, [ts], t, rows)
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"prev_{ts}").cast("timestamp"))
    return lagged.select(*keys, t, (micros / 1e6).alias("step")).where("step IS NOT NULL")


def median_step(df: DataFrame, keys: list[str], ts: str, t: str = "t") -> DataFrame:
    """Exact median step per series, by rank in a distributed sort."""
    s = steps(df, keys, ts, t)
    ranked = ordered_index(s, keys, ["step", t], "_rank")
    sizes = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    mid = (F.col("_rank") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_rank") == F.floor(F.col("_n") / 2))
    joined = match(ranked.withColumn("_one", F.lit(1)), sizes.withColumn("_one", F.lit(1)), [*keys, "_one"])
    return joined.where(mid).groupBy(*keys).agg(F.avg("step").alias("median_step"))


def frequency_of(step_seconds: Column) -> Column:
    """Frequency name of a median step; missing or non-positive steps count as daily."""
    c = F.when(step_seconds.isNull() | (step_seconds <= 0), F.lit("D"))
    for limit, name in STEP_LIMITS:
        c = c.when(step_seconds < limit, F.lit(name))
    return c.otherwise(F.lit("YS"))


def frequencies(df: DataFrame, keys: list[str], ts: str, t: str = "t", rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, frequency, steps) from the class of the median step, without sorting the steps.

    Whether the median lies below a limit follows from the number of steps below it; with
    the limit exactly between the two middle values, those are the largest below and the
    smallest above. One combined aggregation per series.
    """
    s = steps(df, keys, ts, t, rows)
    x = F.col("step")
    limits = [0.0] + [float(limit) for limit, _ in STEP_LIMITS]

    def low(i: int, limit: float) -> Column:
        return x <= 0 if i == 0 else x < limit

    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, limit in enumerate(limits):
        aggs += [F.count_if(low(i, limit)).alias(f"_c{i}"), F.max(F.when(low(i, limit), x)).alias(f"_a{i}"), F.min(F.when(~low(i, limit), x)).alias(f"_z{i}")]
    g = s.groupBy(*keys).agg(*aggs)

    def below(i: int, limit: float) -> Column:
        half = (F.col(f"_a{i}") + F.col(f"_z{i}")) / 2
        split = (half <= 0) if i == 0 else (half < limit)
        return F.when(F.col(f"_c{i}") * 2 == F.col("_n"), split).otherwise(F.col(f"_c{i}") * 2 > F.col("_n"))

    c = F.when(below(0, 0.0), F.lit("D"))
    for i, (limit, name) in enumerate(STEP_LIMITS, start=1):
        c = c.when(below(i, float(limit)), F.lit(name))
    return g.select(*keys, c.otherwise(F.lit("YS")).alias("frequency"), F.col("_n").alias("steps"))


def season_length(freq: Column, n: Column) -> Column:
    """Main season in rows for a frequency and a series length."""
    def part(k: int) -> Column:
        return F.greatest(F.lit(2), F.floor(n / k)).cast("bigint")

    return (
        F.when((freq == "D") & (n >= 730), 365).when((freq == "D") & (n >= 52), 7)
        .when(freq == "h", 24).when(freq == "min", 1440).when((freq == "W") & (n >= 104), 52)
        .when(freq.isin("MS", "QS"), F.when(n >= 24, 12).otherwise(part(2)))
        .otherwise(part(4)).cast("bigint")
    )


def season_period(season: Column, n: Column) -> Column:
    """The season as used for a series of n rows: at least 2, at most half the rows."""
    return F.greatest(F.lit(2), F.least(season, F.floor(n / 2))).cast("bigint")


def detect_time_columns(df: DataFrame) -> DataFrame:
    """Columns that hold times, best guess first: (column, rank, is_time_type, name_hint).

    Text counts when every non-null value parses. Time types and hinted names go to the
    front (the last one first), others follow in order; numbers are never taken.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, rank int, is_time_type boolean, name_hint boolean")
    text = [f for f in fields if isinstance(f.dataType, T.StringType)]
    parsed = {}
    if text:
        aggs = []
        for i, f in enumerate(text):
            aggs += [F.count(_c(f.name)).alias(f"n{i}"), F.count(F.try_to_timestamp(_c(f.name))).alias(f"p{i}")]
        row = df.agg(*aggs).first()
        parsed = {f.name: row[f"n{i}"] > 0 and row[f"n{i}"] == row[f"p{i}"] for i, f in enumerate(text)}
    front, back = [], []
    for f in fields:
        typed = not isinstance(f.dataType, T.StringType)
        hint = any(h in f.name.lower() for h in TIME_HINTS)
        if typed or parsed.get(f.name):
            entry = (f.name, typed, hint)
            front.insert(0, entry) if typed or hint else back.append(entry)
    rows = [(name, i + 1, typed, hint) for i, (name, typed, hint) in enumerate(front + back)]
    return df.sparkSession.createDataFrame(rows, "column string, rank int, is_time_type boolean, name_hint boolean")


# --- decomposition -------------------------------------------------------------------


def long_form(df: DataFrame, keys: list[str], values: list[str], t: str = "t") -> DataFrame:
    """One row per value column: (keys, column, t, value)."""
    cells = F.array(*[F.struct(F.lit(v).alias("column"), _c(v).cast("double").alias("value")) for v in values])
    return df.select(*keys, t, F.explode(cells).alias("x")).select(*keys, "x.column", t, "x.value")


def trends(long: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Least-squares line on the row position, bounds and length of every series."""
    x, y = F.col(t).cast("double"), F.col("value")
    g = long.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.min(y).alias("value_min"), F.max(y).alias("value_max"), F.count(y).alias("n")
    )
    return g.withColumn("slope", F.coalesce("slope", F.lit(0.0)))


def _heavy_series(df: DataFrame, info: DataFrame, keys: list[str]) -> tuple[list, list]:
    """Heavy join keys from the known series lengths, without another look at the data: series, and (series, phase)."""
    total = info.agg(F.sum("n")).first()[0] or 0
    limit = max(HEAVY_ROWS, total // (4 * shuffle_width(df)))
    if total <= limit:
        return [], []
    big = info.where(F.col("n") > limit)
    phases = big.where(F.col("n") / F.col("period") > limit).select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("period") - 1)).alias("phase"))
    return big.select(*keys).collect(), phases.collect()


def decompose(long: DataFrame, keys: list[str], info: DataFrame, rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, t, flat, moving_trend, seasonal, residual) and phase means (keys, phase, seasonal).

    ``info`` has one row per series: slope, intercept, n, season, period. The value minus the
    trend line (``flat``) is split into a centred moving average, the mean per phase of the
    season, and the rest.
    """
    line = info.select(*keys, "slope", "intercept", "n", "period")
    heavy, heavy_phases = _heavy_series(long, info, keys)
    x = skew_join(long, line, keys, "inner", heavy=heavy)
    x = x.withColumn("flat", F.col("value") - (F.col("slope") * F.col("t") + F.col("intercept")))
    x = moving_average(x, keys, "flat", F.least("period", "n"), F.col("n"), "moving_trend", rows=rows)
    x = skew_join(x, info.select(*keys, "period"), keys, "inner", heavy=heavy)
    x = cut_lineage(x.withColumn("phase", F.col("t") % F.col("period")).drop("period"))
    means = x.groupBy(*keys, "phase").agg(F.avg(F.col("flat") - F.col("moving_trend")).alias("seasonal"))
    x = skew_join(x, means, [*keys, "phase"], "inner", heavy=heavy_phases)
    return x.withColumn("residual", F.col("flat") - F.col("moving_trend") - F.col("seasonal")), means


_HARMONICS = T.StructType(
    [T.StructField("amplitudes", T.ArrayType(T.DoubleType())), T.StructField("phases", T.ArrayType(T.DoubleType())), T.StructField("freqs", T.ArrayType(T.DoubleType()))]
)
FLOOR = 1e-6  # amplitudes up to here are no waves


def _dft(p: np.ndarray, n: int, bins: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """DFT at some bins of a season repeated to length n: the season's own sum times a geometric sum, and the rest."""
    size = len(p)
    reps, rest = divmod(n, size)
    j = np.arange(size)
    out = np.empty(len(bins), complex)
    step = max(1, at_once // size)
    turn = lambda x: np.exp(-2j * np.pi * (x % n) / n)
    for a in range(0, len(bins), step):
        k = bins[a : a + step]
        wave = turn(k[:, None] * j[None, :])
        whole = (k * size) % n == 0
        many = np.where(whole, reps, (1 - turn(k * size * reps)) / np.where(whole, 1, 1 - turn(k * size)))
        out[a : a + step] = many * (wave @ p) + turn(k * size * reps) * (wave[:, :rest] @ p[:rest])
    return out


def _spectrum(profile: np.ndarray, n: int, best: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Bins and DFT values of the season repeated to length n; the ``best`` largest beyond bin 0 are among them.

    A repeated season has its energy next to the multiples of n / P. A bin at least d bins away from all
    of them has at most |p|_1 / sin(pi d P / n) plus the rest's |p|_1; bins are looked at in growing distance until the
    ``best`` found are above that bound, or the bound is below any wave. A season of an eighth of the
    series and more is transformed whole: that takes an array of eight seasons at most.
    """
    size = len(profile)
    if 8 * size >= n:
        return np.arange(n // 2 + 1), np.fft.rfft(np.resize(profile, n))
    reps, rest = divmod(n, size)
    p = profile - (profile.sum() * reps + profile[:rest].sum()) / n  # changes bin 0 only
    every = n // 2
    middle = np.arange(size // 2 + 2) * n // size
    reach = 0 if rest == 0 else 1  # in whole seasons all other bins are zero
    while True:
        near = (middle[:, None] + np.arange(-reach, reach + 2 if rest else 1)[None, :]).reshape(-1)
        bins = np.unique(near[(near > 0) & (near <= every)])
        found = _dft(p, n, bins)
        if rest == 0 or len(bins) == every:
            return bins, found
        low = np.sort(np.abs(found))[-best] if len(found) >= best else 0.0
        bound = np.abs(p).sum() / np.sin(np.pi * min(reach * size / n, 0.5)) + np.abs(p[:rest]).sum()
        if low >= bound or bound * 2 / n <= FLOOR:
            return bins, found
        reach *= 4


@F.pandas_udf(_HARMONICS)
def _harmonics(profile: pd.Series, n: pd.Series, season: pd.Series) -> pd.DataFrame:
    found = []
    for values, size, period in zip(profile, n, season):
        p, size = np.asarray(values, dtype="float64"), int(size)
        reps, rest = divmod(size, len(p))
        mean = (p.sum() * reps + p[:rest].sum()) / size
        spread = float(np.sqrt(max((((p - mean) ** 2).sum() * reps + ((p[:rest] - mean) ** 2).sum()) / size, 0.0)))
        amps, phs, frq = [], [], []
        if size >= period:
            bins, spec = _spectrum(p, size)
            live = bins > 0
            bins, spec = bins[live], spec[live]
            amp = np.abs(spec) * 2 / size
            for i in np.argsort(amp, kind="stable")[::-1][:2]:
                if amp[i] > FLOOR:
                    amps.append(round(float(amp[i]), 6))
                    phs.append(round(float(np.angle(spec[i])), 6))
                    frq.append(float(bins[i]) / size)
        if not amps:
            amps, phs, frq = [round(spread, 6)], [0.0], [1.0 / max(int(period), 1)]
        found.append((amps, phs, frq))
    return pd.DataFrame(found, columns=["amplitudes", "phases", "freqs"])


def harmonics(means: DataFrame, keys: list[str], info: DataFrame) -> DataFrame:
    """Two strongest waves of the seasonal part per series, from its phase means.

    A season has at most 1,440 phases, or a quarter of the rows of a series with steps of 100
    days and more, so the list per series is small.
    """
    packed = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("phase", "seasonal"))), lambda s: s["seasonal"]).alias("profile"))
    packed = packed.join(info.select(*keys, "n", "season"), keys)
    return packed.withColumn("_h", _harmonics("profile", "n", "season")).select(*keys, "_h.*")


def _rounded(c: Column, default: float) -> Column:
    r = F.round(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c), 6)
    return F.when(r.isNull() | (r == 0), F.lit(default)).otherwise(r)


def stl_parts(long: DataFrame, keys: list[str], info: DataFrame, rows: int = BLOCK_ROWS, **options) -> tuple[DataFrame, DataFrame]:
    """As ``decompose``, but what is left over the trend line is split by loess (``stl``)."""
    heavy, _ = _heavy_series(long, info, keys)
    x = skew_join(long, info.select(*keys, "slope", "intercept"), keys, "inner", heavy=heavy)
    x = x.withColumn("flat", F.col("value") - (F.col("slope") * F.col("t") + F.col("intercept")))
    parts = stl(x.select(*keys, "t", "flat"), keys, info, "flat", rows=rows, **options).withColumnRenamed("trend", "moving_trend")
    phased = skew_join(parts, info.select(*keys, "period"), keys, "inner", heavy=heavy).withColumn("phase", F.col("t") % F.col("period"))
    return parts, phased.groupBy(*keys, "phase").agg(F.avg("seasonal").alias("seasonal"))


def analyze(
    df: DataFrame, keys: list[str], ts: str, values: list[str], tie: list[str] = (), rows: int = BLOCK_ROWS, min_rows: int = 4, method: str = "average"
) -> tuple[DataFrame, DataFrame]:
    """Pattern models: one row per (keys, column), and residual correlations (keys, col_a, col_b, corr).

    Series with fewer than ``min_rows`` rows are left out; rows with a null key belong to no series.
    ``method``: ``average`` (moving average and phase means) or ``stl`` (loess, robust).
    """
    placed = ordered_index(df.select(*keys, ts, *tie, *values), keys, [ts, *tie])
    keys_known = reduce(lambda a, b: a & b, [_c(k).isNotNull() for k in keys], F.lit(True))
    placed = placed.where(keys_known)
    span = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_rows"), F.min(ts).alias("source_start"), F.max(ts).alias("source_end")).where(F.col("source_rows") >= min_rows)
    info = span.join(frequencies(placed, keys, ts, rows=rows), keys, "left").withColumn("frequency", F.coalesce("frequency", F.lit("D")))
    info = info.withColumn("season", season_length(F.col("frequency"), F.col("source_rows"))).drop("steps")

    cols = [*keys, "column"]
    long = cut_lineage(long_form(fill_gaps(placed, keys, values, rows=rows), keys, values))
    lines = trends(long, cols).join(info, keys).withColumn("period", season_period(F.col("season"), F.col("n")))
    lines = cut_lineage(lines)
    parts, means = (stl_parts if method == "stl" else decompose)(long, cols, lines, rows)
    lagged = with_lag(parts, cols, ["residual"], rows=rows)
    r = F.col("residual")
    rest = lagged.groupBy(*cols).agg(F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"), safe_corr(r, F.col("prev_residual")).alias("_a"))
    waves = harmonics(means, cols, lines)
    models = lines.join(rest, cols).join(waves, cols).select(
        *cols, "frequency", F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("frequency")].alias("frequency_label"),
        "source_rows", "source_start", "source_end", F.col("season").alias("seasonal_period"),
        _rounded(F.col("slope"), 0.0).alias("trend_slope"), _rounded(F.col("intercept"), 0.0).alias("trend_intercept"),
        F.col("amplitudes").alias("seasonal_amplitudes"), F.col("phases").alias("seasonal_phases"), F.col("freqs").alias("seasonal_freqs"),
        _rounded(F.col("_m"), 0.0).alias("residual_mean"), _rounded(F.col("_s"), 0.001).alias("residual_std"), _rounded(F.col("_a"), 0.0).alias("autocorr_lag1"),
        _rounded(F.col("value_min"), 0.0).alias("value_min"), _rounded(F.col("value_max"), 1.0).alias("value_max"),
    )
    corr = residual_correlations(parts, keys, values)
    return tuple(together(lambda: cut_lineage(models), lambda: cut_lineage(corr)))


def residual_correlations(parts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Correlation of the residuals of every column pair of a series, both directions and the diagonal."""
    wide = parts.groupBy(*keys, "t").agg(*[F.max(F.when(F.col("column") == v, F.col("residual"))).alias(f"r{i}") for i, v in enumerate(values)])
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    one = wide.groupBy(*keys).agg(*[safe_corr(F.col(f"r{i}"), F.col(f"r{j}")).alias(f"c{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(F.lit(values[i]).alias("col_a"), F.lit(values[j]).alias("col_b"), F.round(F.col(f"c{min(i, j)}_{max(i, j)}"), 6).alias("corr"))
        for i in range(len(values)) for j in range(len(values))
    ]
    return one.select(*keys, F.inline(F.array(*cells)))


def nested_models(models: DataFrame, correlations: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: ``columns`` MAP<name, model> and ``residual_correlation_matrix`` MAP<name, MAP<name, corr>>."""
    fields = ["trend_slope", "trend_intercept", "seasonal_period", "seasonal_amplitudes", "seasonal_phases", "residual_mean", "residual_std", "autocorr_lag1", "value_min", "value_max"]
    shared = ["frequency", "frequency_label", "source_rows", "source_start", "source_end", "seasonal_period"]
    m = models.groupBy(*keys, *shared).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("column"), F.struct(*fields))))).alias("columns"))
    inner = correlations.groupBy(*keys, "col_a").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_b", "corr")))).alias("row"))
    c = inner.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col_a", "row"))).alias("residual_correlation_matrix"))
    return (m.join(c, keys, "left") if keys else match(m.withColumn("_one", F.lit(1)), c.withColumn("_one", F.lit(1)), ["_one"]).drop("_one")).withColumn("numeric_columns", F.array_sort(F.map_keys("columns")))


def summary_text(nested: DataFrame) -> Column:
    """One line about a nested model."""
    day = "yyyy-MM-dd"
    return F.concat(
        F.col("frequency_label"), F.lit(" data · "), F.col("source_rows").cast("string"), F.lit(" rows · "), F.date_format("source_start", day), F.lit(" → "),
        F.date_format("source_end", day), F.lit(" · "), F.size("columns").cast("string"), F.lit(" numeric column(s) · seasonal period ≈ "),
        F.col("seasonal_period").cast("string"), F.lit(" steps"),
    )
