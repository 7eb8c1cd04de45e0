"""Synthetic series from pattern models: trend + season + correlated AR(1) noise.

The noise of a row is a function of (seed, series, column, row). A block of rows can
therefore be made on its own: it starts early enough that whatever came before has faded
below the precision of a double, and the early rows are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import random as R
from ..functions.dates import calendar_step, next_point, roll_forward
from ..session import cut_lineage

BLOCK_ROWS = 1 << 15
AR_LIMIT = 0.99
WARM_UP = math.ceil(math.log(1e-18) / math.log(AR_LIMIT))


def noise_factor(std: np.ndarray, corr: np.ndarray) -> np.ndarray:
    """Lower factor of the noise covariance; a matrix that is not positive definite is repaired by its eigenvalues."""
    std = np.where(std <= 0, 1e-6, std)
    corr = np.clip(corr, -0.99, 0.99)
    np.fill_diagonal(corr, 1.0)
    cov = np.outer(std, std) * corr
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(cov)
        return vectors @ np.diag(np.sqrt(np.clip(values, 1e-8, None)))


def noise_factors(models: DataFrame, correlations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, column, columns, weights): each column's weights over the independent normals of its series."""
    ordered = models.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("column", "residual_std"))).alias("cols"))
    pairs = correlations.groupBy(*keys).agg(F.collect_list(F.struct("col_a", "col_b", "corr")).alias("pairs"))
    one = F.lit(1)
    joined = ordered.withColumn("_one", one).join(pairs.withColumn("_one", one), [*keys, "_one"], "left")

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def factor(cols: pd.Series, links: pd.Series) -> pd.Series:
        out = []
        for some, known in zip(cols, links):
            place = {c["column"]: i for i, c in enumerate(some)}
            corr = np.eye(len(place))
            for p in known if known is not None else []:
                if p["col_a"] in place and p["col_b"] in place:
                    corr[place[p["col_a"]], place[p["col_b"]]] = p["corr"]
            out.append(noise_factor(np.array([c["residual_std"] for c in some], dtype="float64"), corr).tolist())
        return pd.Series(out)

    names = F.transform("cols", lambda c: c["column"])
    done = joined.select(*keys, names.alias("columns"), factor("cols", "pairs").alias("f"))
    return done.select(*keys, "columns", F.posexplode("f").alias("_p", "weights")).withColumn("column", F.element_at("columns", F.col("_p") + 1)).drop("_p")


def _ar1(e: np.ndarray, a: float, first: float) -> np.ndarray:
    """r[0] = first, r[t] = a r[t-1] + e[t], in chunks of 64 by one triangular product each."""
    size = 64
    pad = (-len(e)) % size
    x = np.concatenate([e, np.zeros(pad)])
    x[0] = first
    x = x.reshape(-1, size)
    k = np.arange(size)
    low = np.where(k[:, None] >= k[None, :], np.power(float(a), np.maximum(k[:, None] - k[None, :], 0)), 0.0)
    local = x @ low.T
    fade = np.power(float(a), k + 1)
    carry = 0.0
    for row in local:
        row += fade * carry
        carry = row[-1]
    return local.reshape(-1)[: len(e)]


def ar_residuals(keys: list[str], block_rows: int):
    """Function for applyInPandas: AR(1) over one block including its early rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        a = float(min(AR_LIMIT, max(-AR_LIMIT, pdf["autocorr_lag1"].iloc[0])))
        mean = float(pdf["residual_mean"].iloc[0])
        e = pdf["noise"].to_numpy() + mean * (1 - a)
        first = pdf["noise"].iloc[0] + mean
        pdf = pdf.assign(ar=_ar1(e, a, first))
        block = int(pdf["_b"].iloc[0])
        return pdf.loc[pdf["t"] >= block * block_rows, [*keys, "column", "t", "ar"]]

    return run


def generate(
    models: DataFrame,
    correlations: DataFrame,
    keys: list[str],
    n_rows: Column | int,
    seed: int = 42,
    seasonal_scale: float = 1.0,
    start: str | None = None,
    frequency: str | None = None,
    compat: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, column, t, ts, value) for ``n_rows`` steps per series; ``n_rows`` may be a column of ``models``.

    Without ``start`` the series goes on after the source. ``compat`` plays every wave as a
    sine at the main season; the default uses the wave's own frequency and cosine phase.
    """
    n = n_rows if isinstance(n_rows, Column) else F.lit(max(1, int(n_rows)))
    cols = [*keys, "column"]
    freq = F.lit(frequency) if frequency else F.col("frequency")
    origin = F.lit(start).cast("timestamp_ntz") if start else next_point(F.col("source_end").cast("timestamp_ntz"), freq)
    plan = models.join(noise_factors(models, correlations, keys), cols).withColumn("_n", F.greatest(n.cast("bigint"), F.lit(1))).withColumn("_freq", freq)
    plan = cut_lineage(plan.withColumn("_anchor", roll_forward(origin, F.col("_freq"))))
    # blocks first, rows of a block second: no row ever carries more than one block
    each = plan.groupBy(*keys, "columns").agg(F.max("_n").alias("_n"), F.collect_list(F.struct("column", "weights", "autocorr_lag1", "residual_mean")).alias("parts"))
    lo = F.greatest(F.col("_b") * block_rows - WARM_UP, F.lit(0))
    hi = F.least((F.col("_b") + 1) * block_rows, F.col("_n")) - 1
    blocks = each.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block_rows).cast("bigint"))))
    rows = blocks.repartition(*keys, "_b").withColumn("t", F.explode(F.sequence(lo, hi)))
    normals = F.transform("columns", lambda c: R.normal(seed, "series.noise", [*[F.col(k) for k in keys], c, F.col("t")]))
    noisy = rows.select(*keys, "_b", "t", normals.alias("z"), "parts").select(*keys, "_b", "t", "z", F.explode("parts").alias("p"))
    noise = F.aggregate(F.zip_with("z", "p.weights", lambda z, w: z * w), F.lit(0.0), lambda acc, v: acc + v)
    noisy = noisy.select(*keys, "p.column", "_b", "t", "p.autocorr_lag1", "p.residual_mean", noise.alias("noise"))
    schema = T.StructType([*[models.schema[c] for c in cols], T.StructField("t", T.LongType()), T.StructField("ar", T.DoubleType())])
    rest = noisy.groupBy(*cols, "_b").applyInPandas(ar_residuals(keys, block_rows), schema)

    at = F.col("t").cast("double")
    if compat:
        waves = F.zip_with("seasonal_amplitudes", "seasonal_phases", lambda a, p: a * F.sin(F.lit(2 * math.pi) * at / F.greatest("seasonal_period", F.lit(1)) + p))
    else:
        triples = F.arrays_zip("seasonal_amplitudes", "seasonal_phases", "seasonal_freqs")
        waves = F.transform(triples, lambda w: w["seasonal_amplitudes"] * F.cos(F.lit(2 * math.pi) * at * w["seasonal_freqs"] + w["seasonal_phases"]))
    season = F.lit(float(seasonal_scale)) * F.aggregate(waves, F.lit(0.0), lambda acc, v: acc + v)
    value = F.col("trend_slope") * at + F.col("trend_intercept") + season + F.col("ar")
    bounded = F.greatest(F.least(value, F.col("value_max")), F.col("value_min"))
    param = plan.select(
        *cols, "trend_slope", "trend_intercept", "seasonal_amplitudes", "seasonal_phases", "seasonal_freqs", "seasonal_period", "value_min", "value_max", "_anchor", "_freq"
    )
    joined = rest.join(param, cols)
    return joined.select(*cols, "t", calendar_step(F.col("_anchor"), F.col("_freq"), F.col("t")).alias("ts"), F.round(bounded, 4).alias("value"))


def wide(generated: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per time step with a column per series column."""
    return generated.groupBy(*keys, "t", "ts").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])
