import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from likeness.operators import series as S
from likeness.operators import seriesgen as SG
from likeness.operators.rows import ordered_index


def frame(spark, values, step="1 day", key="k"):
    rows = [(key, i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "s string, i bigint, v double")
    return df.withColumn("ts", F.expr(f"timestamp_ntz'2024-01-01' + i * interval {step}"))


@pytest.mark.parametrize("w", [1, 2, 5, 8, 30, 31])
def test_moving_average_equals_convolution(spark, w):
    x = np.random.default_rng(w).normal(size=31)
    df = frame(spark, x).withColumnRenamed("i", "t").withColumns({"w": F.lit(w), "n": F.lit(31)})
    got = [r["ma"] for r in S.moving_average(df, ["s"], "v", F.col("w"), F.col("n"), rows=4).orderBy("t").collect()]
    assert np.allclose(got, np.convolve(x, np.ones(w) / w, mode="same"))


@pytest.mark.parametrize("w", [3, 40, 400])
def test_moving_average_far_from_zero(spark, w):
    x = 1e9 + np.random.default_rng(w).normal(0, 1e-3, 900)
    df = frame(spark, x).withColumnRenamed("i", "t").withColumns({"w": F.lit(w), "n": F.lit(900)})
    made = S.moving_average(df, ["s"], "v", F.col("w"), F.col("n"), rows=32)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = np.array([r["ma"] for r in made.orderBy("t").collect()])
    inside = slice(w // 2, 900 - (w - 1) // 2)
    want = np.array([np.mean(x[max(0, t - w // 2) : t + (w - 1) // 2 + 1] - 1e9) for t in range(900)])
    assert np.abs(got[inside] - 1e9 - want[inside]).max() < 5e-7  # the resolution of a double at 1e9 is 1.2e-7


def test_fill_and_lag_across_blocks(spark):
    x = [None, None, 3, None, None, None, None, 8, None, 10, None, None]
    df = frame(spark, x).withColumnRenamed("i", "t")
    got = [r["v"] for r in S.fill_gaps(df, ["s"], ["v"], rows=3).orderBy("t").collect()]
    assert got == pd.Series(x, dtype=float).ffill().bfill().tolist()
    lag = [r["prev_v"] for r in S.with_lag(df, ["s"], ["v"], rows=3).orderBy("t").collect()]
    assert lag == [None, *df_values(x)[:-1]]
    assert S.fill_gaps(frame(spark, [None] * 5).withColumnRenamed("i", "t"), ["s"], ["v"], rows=2).where("v IS NOT NULL").count() == 0


def df_values(x):
    return [None if v is None else float(v) for v in x]


@pytest.mark.parametrize(
    "step,want",
    [("0 second", "D"), ("30 second", "min"), ("1 hour", "h"), ("23 hour", "h"), ("1 day", "D"), ("7 day", "W"), ("30 day", "MS"), ("91 day", "QS"), ("365 day", "YS"), ("3600 second", "h")],
)
def test_frequency(spark, step, want):
    df = frame(spark, range(6), step).withColumnRenamed("i", "t")
    assert S.frequencies(df, ["s"], "ts", rows=2).first()["frequency"] == want


def test_median_between_two_classes(spark):
    rows = [("k", i, x) for i, x in enumerate(np.cumsum([0, 10, 10, 9000, 9000]).tolist())]
    df = spark.createDataFrame(rows, "s string, t bigint, x bigint").withColumn("ts", F.timestamp_seconds("x").cast("timestamp_ntz"))
    assert S.median_step(df, ["s"], "ts").first()["median_step"] == 4505.0
    assert S.frequencies(df, ["s"], "ts").first()["frequency"] == "h"


def reference_model(x, period):
    """Plain numpy statement of the model of one series."""
    n = len(x)
    t = np.arange(n)
    slope, icept = np.polyfit(t, x, 1)
    flat = x - (slope * t + icept)
    p = max(2, min(period, n // 2))
    ma = np.convolve(flat, np.ones(p) / p, mode="same")
    sea = np.array([np.mean((flat - ma)[i % p :: p]) for i in range(n)])
    res = flat - ma - sea
    spec = np.fft.rfft(sea)
    amp = np.abs(spec) * 2 / n
    top = np.argsort(amp[1:])[::-1][:2] + 1
    return slope, icept, amp[top], np.angle(spec[top]), res


def test_model_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 75
    t = np.arange(n)
    a = 3 + 0.1 * t + 2 * np.sin(2 * np.pi * t / 7) + rng.normal(size=n) * 0.3
    b = 50 - a + rng.normal(size=n)
    df = frame(spark, a).withColumn("b", F.element_at(F.array(*[F.lit(float(v)) for v in b]), (F.col("i") + 1).cast("int")))
    models, corr = S.analyze(df.repartition(3), ["s"], "ts", ["v", "b"], rows=16)
    got = {r["column"]: r for r in models.collect()}
    res = {}
    for name, x in (("v", a), ("b", b)):
        slope, icept, amps, phases, res[name] = reference_model(x, 7)
        m = got[name]
        assert m["frequency"] == "D" and m["seasonal_period"] == 7 and m["source_rows"] == n
        assert np.isclose(m["trend_slope"], slope, atol=1e-5) and np.isclose(m["trend_intercept"], icept, atol=1e-5)
        assert np.allclose(m["seasonal_amplitudes"], amps, atol=1e-5) and np.allclose(m["seasonal_phases"], phases, atol=1e-4)
        assert np.isclose(m["residual_std"], res[name].std(), atol=1e-5)
        assert np.isclose(m["autocorr_lag1"], pd.Series(res[name]).autocorr(1), atol=1e-5)
    c = {(r["col_a"], r["col_b"]): r["corr"] for r in corr.collect()}
    assert np.isclose(c["v", "b"], np.corrcoef(res["v"], res["b"])[0, 1], atol=1e-5) and c["v", "v"] == 1.0 and len(c) == 4
    nested = S.nested_models(models, corr, ["s"]).first()
    assert set(nested["columns"]) == {"v", "b"} and nested["residual_correlation_matrix"]["b"]["v"] == c["b", "v"]


def test_short_and_constant_series(spark):
    df = frame(spark, [1, 2, 3]).unionByName(frame(spark, [4] * 9, key="c"))
    models, corr = S.analyze(df, ["s"], "ts", ["v"])
    m = models.collect()
    assert [r["s"] for r in m] == ["c"]
    assert m[0]["trend_slope"] == 0 and m[0]["residual_std"] == 0.001 and m[0]["autocorr_lag1"] == 0 and m[0]["value_max"] == 4


def test_harmonics_of_very_long_series_use_the_phase_means():
    p = np.sin(2 * np.pi * np.arange(24) / 24) + 0.4 * np.cos(4 * np.pi * np.arange(24) / 24)
    for n in (24 * 50, 24 * 50 + 7):
        full = np.fft.rfft(np.resize(p, n))
        bins, spec = S._spectrum(p, n)
        assert np.allclose(spec, full[bins], atol=1e-6)
        best = np.argsort(np.abs(full[1:]))[::-1][:2] + 1
        assert set(best) <= set(bins.tolist())


@pytest.mark.parametrize("seed", range(6))
def test_the_strongest_waves_are_found_without_the_whole_series(seed):
    rng = np.random.default_rng(seed)
    size = [2, 5, 24, 24, 97, 365][seed]
    p = [np.array([1.0, -1.0]), rng.normal(size=5), np.sin(2 * np.pi * np.arange(24) / 24), rng.exponential(size=24) ** 4, rng.normal(size=97), np.ones(365) + 1e-3 * rng.normal(size=365)][seed]
    for n in (size * 9 + 1, size * 40, size * 200 + size // 2, 5_000_011 if size < 50 else 60_013):
        full = np.abs(np.fft.rfft(np.resize(p, n)))[1:]
        bins, spec = S._spectrum(p, n)
        best = np.sort(full)[::-1][:2]
        got = np.sort(np.abs(spec[bins > 0]))[::-1][:2]
        live = best * 2 / n > 10 * S.FLOOR
        assert np.allclose(got[: live.sum()], best[live], rtol=1e-6)


def test_time_columns(spark):
    df = spark.createDataFrame([("2024-01-01", 5, "a", "2024-02-02", None)], "products string, year int, x string, y string, day string")
    got = [r["column"] for r in S.detect_time_columns(df).orderBy("rank").collect()]
    assert got == ["products", "y"]  # the hint "ts" sits in "products"; numbers and empty columns are no times


@pytest.mark.parametrize("a", [0.0, 0.7, -0.9, 0.99])
def test_ar1_equals_the_loop(a):
    e = np.random.default_rng(1).normal(size=1000)
    want = np.zeros(1000)
    want[0] = e[0] + 3
    for t in range(1, 1000):
        want[t] = a * want[t - 1] + e[t]
    assert np.allclose(SG._ar1(e, a, e[0] + 3), want)


def models(spark):
    m = spark.createDataFrame(
        [("s", c, "D", 10, 7, 0.01, 5.0, [1.0], [0.5], [1 / 7], 0.1, sd, ar, -100.0, 100.0) for c, sd, ar in (("a", 2.0, 0.99), ("b", 1.0, -0.5))],
        "s string, column string, frequency string, source_rows bigint, seasonal_period bigint, trend_slope double, trend_intercept double, seasonal_amplitudes array<double>, "
        "seasonal_phases array<double>, seasonal_freqs array<double>, residual_mean double, residual_std double, autocorr_lag1 double, value_min double, value_max double",
    ).withColumn("source_end", F.lit("2024-01-31 06:00:00").cast("timestamp_ntz"))
    c = spark.createDataFrame([("s", "a", "b", 0.8), ("s", "b", "a", 0.8)], "s string, col_a string, col_b string, corr double")
    return m, c


def test_generated_rows_do_not_depend_on_blocks(spark):
    m, c = models(spark)
    one = SG.generate(m, c, ["s"], 9000, block_rows=1 << 15).orderBy("column", "t").toPandas()
    many = SG.generate(m, c, ["s"], 9000, block_rows=1000).orderBy("column", "t").toPandas()
    assert np.allclose(one["value"], many["value"], atol=2e-4) and (one["ts"] == many["ts"]).all() and len(one) == 18000
    assert str(one["ts"][0]) == "2024-02-01 06:00:00"


def test_generated_noise_has_the_model_statistics(spark):
    m, c = models(spark)
    flat = m.withColumns({"trend_slope": F.lit(0.0), "seasonal_amplitudes": F.array(F.lit(0.0)), "autocorr_lag1": F.lit(0.0)})
    w = SG.wide(SG.generate(flat, c, ["s"], 6000), ["s"], ["a", "b"]).toPandas()
    assert abs(w["a"].std() - 2) < 0.1 and abs(w["b"].std() - 1) < 0.05 and abs(w["a"].corr(w["b"]) - 0.8) < 0.03
    tight = SG.generate(m.withColumns({"value_min": F.lit(4.0), "value_max": F.lit(6.0)}), c, ["s"], 200, start="2024-02-14", frequency="W").toPandas()
    assert tight["value"].between(4, 6).all() and str(tight["ts"].min()) == "2024-02-18 00:00:00"


def test_noise_factor_repairs():
    f = SG.noise_factor(np.array([1.0, 0.0, 2.0]), np.array([[1, 0.99, -0.99], [0.99, 1, 0.99], [-0.99, 0.99, 1.0]]))
    assert np.isfinite(f).all()


def test_unkeyed_series(spark):
    df = frame(spark, range(20)).drop("s")
    t = ordered_index(df, [], ["ts"]).where("t <> i").count()
    assert t == 0
    models_, corr = S.analyze(df.withColumn("s", F.lit("all")), ["s"], "ts", ["v"])
    assert models_.count() == 1 and corr.count() == 1
