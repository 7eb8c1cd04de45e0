import pytest
from pyspark.sql import functions as F

from likeness.functions import random as R
from likeness.operators import rows as W
from likeness.operators.joins import heavy_keys, skew_join


def hot(spark, n=3000):
    """A third of the rows under one key, some keys null."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 200 + 5).cast("int").alias("k")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how):
    left, right = hot(spark), spark.range(100).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    assert heavy_keys(left, ["k"], 100)
    a = skew_join(left, right, ["k"], how, slices=5, min_rows=100)
    b = left.join(right, ["k"], how)
    cols = sorted(b.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_skew_join_spreads_the_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        right = spark.range(10).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v"))
        out = skew_join(hot(spark).where("k = 1"), right, ["k"], "inner", slices=16, min_rows=100)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1000 and max(sizes) < 700
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_thresholds_are_exact_and_shared(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 7)
    c = W.thresholds(df, ["id"], [W.Choice("a", "a", 1234), W.Choice("b", "b", 11, F.col("g") == 2), W.Choice("none", "n", 0), W.Choice("all", "x", 10**6, F.col("g") == 1)], 3)
    row = df.agg(*[F.count_if(v).alias(k) for k, v in c.items()], F.count_if(c["b"] & (F.col("g") != 2)).alias("wrong")).first()
    assert (row["a"], row["b"], row["none"], row["all"], row["wrong"]) == (1234, 11, 0, 715, 0)


def test_thresholds_fine_rounds(spark, monkeypatch):
    monkeypatch.setattr(W, "_FINE", 0)
    df = spark.range(2000)
    hit = W.thresholds(df, ["id"], [W.Choice("a", "s", 777)], 1)["a"]
    got = {r["id"] for r in df.where(hit).collect()}
    best = {r["id"] for r in df.orderBy(R.bits(1, "s", "id")).limit(777).collect()}
    assert got == best


def test_thresholds_break_equal_draws_by_id(spark, monkeypatch):
    monkeypatch.setattr(R, "bits", lambda seed, stream, ids: F.lit(5).cast("bigint") + F.lit(0) * F.col("id"))
    df = spark.range(20)
    hit = W.thresholds(df, ["id"], [W.Choice("a", "s", 6)], 1)["a"]
    assert [r["id"] for r in df.where(hit).orderBy("id").collect()] == list(range(6))


def test_thresholds_refuse_repeated_ids(spark):
    df = spark.range(10).withColumn("same", F.lit(1))
    with pytest.raises(ValueError):
        W.thresholds(df, ["same"], [W.Choice("a", "s", 4)], 1)


def test_draws_do_not_depend_on_partitions(spark):
    def rows(p):
        return spark.range(0, 500, 1, p).select("id", R.u(1, "s", "id").alias("u"), R.normal(1, "s", "id").alias("z"), R.fast_u(1, "s", "id").alias("f")).orderBy("id").collect()

    assert rows(1) == rows(7)


def test_indexes_are_dense(spark):
    df = hot(spark)
    h = W.hashed_index(df, ["id"], 1, "s", buckets=9).agg(F.min("row_idx"), F.max("row_idx"), F.count_distinct("row_idx")).first()
    assert tuple(h) == (0, 2999, 3000)
    o = W.ordered_index(df, ["k"], ["id"], blocks=6)
    bad = o.groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count_distinct("t").alias("n"), F.count(F.lit(1)).alias("m")).where("a <> 0 OR b <> n - 1 OR n <> m")
    assert bad.count() == 0 and o.count() == 3000
    whole = W.ordered_index(df, [], ["id"], blocks=5).where("t <> id").count()
    assert whole == 0


def test_resample_sizes(spark):
    df = spark.range(50)
    up = W.resample(df, ["id"], 170, 1, "s")
    assert up.count() == 170 and up.where("copy = 0").count() == 50 and up.select("id").distinct().count() == 50
    assert W.resample(df, ["id"], 13, 1, "s").select("id").distinct().count() == 13
    assert W.resample(df, ["id"], 50, 1, "s").count() == 50
    assert W.resample(df.where("id < 0"), ["id"], 5, 1, "s").count() == 0
