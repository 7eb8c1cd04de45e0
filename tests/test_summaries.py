"""One-pass summaries and frequent values against plain counts."""

import datetime
import decimal
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.operators import profile as P
from likeness.operators import summaries as S


def top_of(values, top=6):
    return sorted(((v, n) for v, n in Counter(v for v in values if v is not None).items()), key=lambda x: (-x[1], x[0]))[:top]


def found(df, column, top=6):
    return [(r["value"], r["n"]) for r in P.value_counts(df, [column], top).orderBy("rank").collect()]


def shapes(rng):
    yield "few", [rng.choice("abc") for _ in range(3000)]
    yield "skewed", [f"v{min(int(rng.paretovariate(1.1)), 5000)}" for _ in range(6000)]
    yield "all different", [f"id{i}" for i in range(4000)]
    yield "two twice", [f"id{i}" for i in range(4000)] + ["id7", "id3999"]
    yield "pairs", [f"p{i}" for i in range(2500)] * 2
    yield "long texts", ["x" * 300 + str(i % 900) for i in range(3000)] + ["y" * 500] * 40
    yield "nulls", [None] * 500 + ["only"]
    yield "nothing", [None] * 50


@pytest.mark.parametrize("size", [512, 16])
def test_frequent_values(spark, monkeypatch, size):
    monkeypatch.setattr(P, "SUMMARY", size)
    monkeypatch.setattr(S, "HELD_ROWS", 400)
    rng = random.Random(size)
    for name, values in shapes(rng):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
        assert found(df, "v") == top_of(values), name
        got = P.column_evidence(df).first()
        assert got["cardinality"] == len({v for v in values if v is not None}), name
        assert got["sample_values"] == "|".join(v for v, _ in top_of(values)), name


def test_frequent_values_when_too_many_keys_tie(spark, monkeypatch):
    monkeypatch.setattr(P, "SUMMARY", 8)
    monkeypatch.setattr(P, "FETCHED", 100)
    values = [f"p{i}" for i in range(2500)] * 2
    assert found(spark.createDataFrame([(v,) for v in values], "v string"), "v") == top_of(values)


def test_summary_never_understates_what_it_left_out():
    rng = random.Random(4)
    for size in (3, 10, 40):
        stream = [rng.randint(0, 60) // rng.randint(1, 9) for _ in range(5000)]
        parts = [S.Frequent(size) for _ in range(4)]
        for i in range(0, 5000, 50):
            v, n = np.unique(stream[i : i + 50], return_counts=True)
            parts[i % 4].add(v, np.zeros(len(v), np.int64), n, np.array([None] * len(v), object))
        whole = S.Frequent(size)
        for p in parts:
            whole.add(p.a, p.b, p.n, p.text, p.error)
        true, kept = Counter(stream), dict(zip(whole.a.tolist(), whole.n.tolist()))
        assert len(kept) <= size
        assert all(n <= true[v] <= n + whole.error for v, n in kept.items())
        assert all(n <= whole.error for v, n in true.items() if v not in kept)


def test_profile_of_every_type(spark):
    rng = random.Random(6)
    rows = []
    for i in range(700):
        rows.append((
            i % 9, i * 10**14, rng.gauss(1e9, 1e-3), float("nan") if i == 600 else -0.0 if i % 2 else 0.0, decimal.Decimal(i) / 8 - 40, i % 2 == 0, datetime.date(2020, 1, 1) + datetime.timedelta(i % 40),
            datetime.datetime(2021, 1, 1) + datetime.timedelta(minutes=i), f"t{i % 50}" if i % 3 else None,
        ))
    df = spark.createDataFrame(rows, "a byte, b long, c double, d float, e decimal(20,5), f boolean, g date, h timestamp, i string").withColumn("j", F.col("h").cast("timestamp_ntz")).withColumn("k", F.lit(None))
    got = {r["column"]: r for r in P.profile(df.repartition(6), cardinality="exact").collect()}
    for at, c in enumerate("abcdefghi"):
        values = [r[at] for r in rows if r[at] is not None]
        real = [v for v in values if v == v]
        assert got[c]["nulls"] == 700 - len(values)
        assert got[c]["cardinality"] == len(set(real)) + (len(real) < len(values))
        want = df.select(F.min(c).cast("string"), F.max(c).cast("string")).first()
        if c not in "cd":
            assert (got[c]["min"], got[c]["max"]) == tuple(want)
        if c in "abe":
            x = [float(v) for v in values]
            mean = sum(x) / len(x)
            assert math.isclose(got[c]["variance"], sum((v - mean) ** 2 for v in x) / (len(x) - 1), rel_tol=1e-9)
    assert 0.5e-6 < got["c"]["variance"] < 2e-6  # moments keep their digits far from zero
    assert got["d"]["max"] == "NaN" and got["d"]["sd"] is None and got["d"]["cardinality"] == 2
    assert got["j"]["min"] == "2021-01-01 00:00:00" and got["k"]["min"] is None and got["k"]["nulls"] == 700


def test_sketch_merges_and_is_exact_below_its_size(spark):
    df = spark.range(60_000).select((F.col("id") % 3000).alias("few"), F.concat(F.lit("k"), F.col("id")).alias("many")).repartition(9)
    got = {r["column"]: r["cardinality"] for r in P.approx_distinct_counts(df, df.columns).collect()}
    assert got["few"] == 3000 and abs(got["many"] - 60_000) < 60_000 * 5 / math.sqrt(S.SKETCH)
    one = {r["column"]: r["cardinality"] for r in P.approx_distinct_counts(df.coalesce(1), df.columns).collect()}
    assert one == got  # the sketch does not depend on how rows are dealt


def test_profile_scans_once_or_twice(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(P.profile(li)).count("FileScan parquet") <= 1
    assert plan(P.profile(li, cardinality="exact")).count("lineitem.parquet") <= 1
