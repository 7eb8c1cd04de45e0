import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.streaming import drift


def exact_ks(a, b):
    points = np.union1d(a, b)
    return np.abs(np.searchsorted(np.sort(a), points, side="right") / len(a) - np.searchsorted(np.sort(b), points, side="right") / len(b)).max()


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(60_000).select(
        (F.col("id") % 6).alias("part"), F.rand(1).alias("same"), (F.randn(2) + F.when(F.col("id") % 6 >= 3, 0.8).otherwise(0.0)).alias("moved"),
        F.floor(F.rand(3) * F.when(F.col("id") % 6 >= 3, 4).otherwise(3)).alias("few"), F.when(F.col("id") % 6 >= 3, F.rand(4)).alias("late"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(F.col("id") % 7 != 0, F.lit(2.5)).alias("odd"), F.lit("text").alias("word"),
    )
    return x.persist()


def test_distances_of_merged_sketches_are_near_exact_ones(spark, rows):
    # states of 12 scattered pieces, added up
    pieces = [drift.partial_states(rows.where(F.pmod(F.hash("same"), F.lit(12)) == i), F.col("part")) for i in range(12)]
    states = pieces[0]
    for p in pieces[1:]:
        states = states.unionByName(p)
    got = {r["column"]: r for r in drift.between(states, F.col("period") < 3, F.col("period") >= 3).collect()}
    assert set(got) == {"part", "same", "moved", "few", "late", "odd"}
    pdf = rows.toPandas()
    early, late = pdf[pdf.part < 3], pdf[pdf.part >= 3]
    for c in ("part", "same", "moved", "few"):
        assert abs(got[c]["ks"] - exact_ks(early[c].to_numpy(), late[c].to_numpy())) < 1 / drift.POINTS + 0.012, c
        assert (got[c]["base_n"], got[c]["n"]) == (30_000, 30_000)
    edges = np.quantile(early["moved"], np.arange(1, 10) / 10)
    p, q = (np.diff(np.concatenate([[0], np.searchsorted(np.sort(s["moved"]), edges, side="right") / len(s), [1]])) for s in (early, late))
    assert abs(got["moved"]["psi"] - ((q - p) * np.log(q / p)).sum()) < 0.08 and got["same"]["psi"] < 0.02
    assert got["late"]["base_filled"] == 0 and got["late"]["ks"] is None and got["late"]["psi"] is None
    odd = pdf["odd"].notna()
    assert got["odd"]["filled"] + got["odd"]["base_filled"] == odd.sum() and got["odd"]["ks"] == 0 and got["odd"]["psi"] == 0


def test_periods_against_all_and_empty_states(spark, rows):
    states = drift.partial_states(rows, F.when(F.col("part") > 0, F.col("part")), ["moved"])
    got = {r["period"]: r["ks"] for r in drift.by_period(states).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5} and all(0.1 < v < 0.25 for v in got.values())
    none = drift.partial_states(rows.where("part > 9"), F.col("part"))
    assert drift.by_period(none).count() == 0 and drift.between(none, F.lit(True), F.lit(True)).count() == 0


def test_a_restart_adds_nothing(spark, rows, tmp_path):
    for i in range(3):
        rows.where(F.col("part") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"x={i}"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in" / "*"))
    for _ in range(2):
        drift.start(source, F.col("part"), str(tmp_path / "out"), str(tmp_path / "state"), ["same"]).awaitTermination()
    states = spark.read.parquet(str(tmp_path / "out" / "batch=*"))
    assert states.agg(F.sum("n")).first()[0] == 60_000
