"""STL against a plain statement of the method, one point at a time, with series that cross block edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.operators import series as S
from likeness.operators import stl as L


def plain_loess(y, span, w, at):
    n, out = len(y), []
    for x in at:
        far = sorted(abs(i - x) for i in range(n))
        if span >= n:
            near, reach = range(n), max(x, n - 1 - x) * span / n
        else:
            lo = int(min(max(np.ceil(x) - span // 2, 0), n - span))
            near = range(lo, lo + span)
            reach = max(abs(i - x) for i in near)
            assert reach <= far[span - 1] + 1e-9
        k = [(1 - min(abs(i - x) / reach, 1) ** 3) ** 3 if reach else 1.0 for i in near]
        kw = [a * w[i] for a, i in zip(k, near)]
        if sum(kw) <= 0:
            kw = k
        mean = sum(a * i for a, i in zip(kw, near)) / sum(kw)
        level = sum(a * y[i] for a, i in zip(kw, near)) / sum(kw)
        spread = sum(a * (i - mean) ** 2 for a, i in zip(kw, near))
        slope = sum(a * (i - mean) * y[i] for a, i in zip(kw, near)) / spread if spread > 1e-9 * sum(kw) else 0.0
        out.append(level + slope * (x - mean))
    return np.array(out)


def plain_stl(y, period, seasonal=7, inner=2, outer=0):
    y = np.asarray(y, float)
    n = len(y)
    odd = lambda v: int(np.ceil(v)) + (int(np.ceil(v)) % 2 == 0)
    trend_span, low_span = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period + 1)
    trend, w = np.zeros(n), np.ones(n)
    for r in range(outer + 1):
        for _ in range(inner):
            flat, cycles = y - trend, np.zeros(n + 2 * period)
            for p in range(period):
                sub = flat[p::period]
                cycles[p::period] = plain_loess(sub, seasonal, w[p::period], range(-1, len(sub) + 1))
            low = cycles
            for size in (period, period, 3):
                low = np.array([low[i : i + size].mean() for i in range(len(low) - size + 1)])
            season = cycles[period : period + n] - plain_loess(low, low_span, np.ones(n), range(n))
            trend = plain_loess(y - season, trend_span, w, range(n))
        rest = y - trend - season
        used = w
        if r < outer:
            middle = np.median(np.abs(rest))
            if middle > 1e-11 * np.abs(y).max():
                u = np.abs(rest) / (6 * middle)
                w = np.where(u < 1, (1 - u * u) ** 2, 0.0)
            else:
                w = np.ones(n)
    return trend, season, rest, used


def made(n, period, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 1e4 + 0.05 * t + 3 * np.sin(2 * np.pi * t / period) * (1 + t / n) + rng.normal(0, 0.3, n)
    y[rng.integers(0, n, max(1, n // 25))] += 20
    return y


SERIES = {"long": (700, 3), "short": (90, 12), "two seasons": (16, 8), "even": (240, 4)}


@pytest.mark.parametrize("outer", [0, 2])
def test_stl_equals_the_plain_method(spark, outer):
    data = {k: made(n, p, n) for k, (n, p) in SERIES.items()}
    long = spark.createDataFrame([(k, t, float(v)) for k, y in data.items() for t, v in enumerate(y)], "s string, t bigint, value double").repartition(5)
    info = spark.createDataFrame([(k, n, p) for k, (n, p) in SERIES.items()], "s string, n bigint, period bigint")
    got = L.stl(long, ["s"], info, outer=outer, rows=16).toPandas()
    assert 700 > 2 * 2 * L.halo(3, 7, 2)  # several blocks
    for k, (n, p) in SERIES.items():
        mine = got[got["s"] == k].sort_values("t")
        assert mine["t"].tolist() == list(range(n))
        for name, want in zip(("trend", "seasonal", "residual", "weight"), plain_stl(data[k], p, outer=outer)):
            assert np.allclose(mine[name], want, atol=1e-7), (k, name)


def test_weights_turn_away_from_outliers(spark):
    y = made(400, 4, 5)
    long = spark.createDataFrame([(t, float(v)) for t, v in enumerate(y)], "t bigint, value double")
    info = spark.createDataFrame([(400, 4)], "n bigint, period bigint")
    got = L.stl(long, [], info, outer=3).toPandas()  # a series without a key
    assert (got["weight"][got["residual"] > 15] == 0).all() and np.isclose(got["value"], got["trend"] + got["seasonal"] + got["residual"]).all()


def test_median_by_bits(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000)) for v in np.abs(np.round(rng.normal(0, 1, n), 2 if k == "c" else 12))]
    df = spark.createDataFrame(rows + [(None, 0.0), (None, 3.0)], "k string, v double").repartition(4)
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    monkeypatch.setattr(L, "WHOLE_MEDIAN", 0)
    got = {r["k"]: r["median"] for r in L.medians(df, ["k"], "v", counts, 1000).collect()}
    assert got == {k: float(np.median([v for x, v in rows + [(None, 0.0), (None, 3.0)] if x == k])) for k in ("a", "b", "c", "d", None)}


def test_constant_series(spark):
    long = spark.createDataFrame([(t, 5.0) for t in range(40)], "t bigint, value double")
    got = L.stl(long, [], spark.createDataFrame([(40, 4)], "n bigint, period bigint"), outer=1).toPandas()
    assert np.allclose(got["trend"], 5) and np.allclose(got["seasonal"], 0)


def test_analyze_with_stl(spark):
    y = made(300, 7, 9)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "s string, i bigint, v double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + i * interval 1 day"))
    models, _ = S.analyze(df, ["s"], "ts", ["v"], method="stl")
    r = models.first()
    t = np.arange(300)
    slope, icept = np.polyfit(t, y, 1)
    trend, season, rest, _ = plain_stl(y - slope * t - icept, 7, outer=15)
    assert r["seasonal_period"] == 7 and np.isclose(r["residual_std"], rest.std(), atol=1e-5) and np.isclose(r["trend_slope"], slope, atol=1e-6)
    assert np.isclose(r["autocorr_lag1"], np.corrcoef(rest[1:], rest[:-1])[0, 1], atol=1e-5)


def test_stl_query(spark):
    """The whole query on the smallest events, series by series."""
    from likeness.plans import series as Q

    sf = "/root/testdata/sf0.001"
    got = Q.ts_stl(spark, sf).toPandas()
    events = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values(["event_type", "ts", "event_id"])
    assert len(got) == len(events)
    for kind, mine in events.groupby("event_type"):
        rows = got[got["event_type"] == kind].sort_values("t")
        for name, want in zip(("trend", "seasonal", "residual", "weight"), plain_stl(mine["value"].to_numpy(), 12, outer=Q.STL_ROUNDS)):
            assert np.allclose(rows[name], want, atol=2e-6), (kind, name)
