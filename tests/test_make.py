import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.operators import copula as K
from likeness.operators import generate as G
from likeness.operators import multitable as M
from likeness.operators import postprocess as P
from likeness.operators.generate import ColumnSpec, Link
from likeness.plans import synthesis
from likeness.sources import bundle as B


# --- schema generation ---------------------------------------------------------------


def test_keys_nulls_and_weights(spark):
    cols = [
        ColumnSpec("p", "id", "uuid", is_pk=True), ColumnSpec("c", "id", "INT", is_pk=True), ColumnSpec("c", "p_id", "uuid", null_percent=50),
        ColumnSpec("c", "kind", "text", allowed_values="a|8,b|1,c|1,d|0"), ColumnSpec("c", "x", "float", null_percent=25), ColumnSpec("c", "y", "float", is_nullable=False, null_percent=90),
        ColumnSpec("c", "when", "datetime"), ColumnSpec("c", "span", "interval"),
    ]
    gen = G.SchemaGenerator(spark, cols, [Link("c", "p_id", "p", "id")], {"p": 40, "c": 8000}, seed=5)
    p, c = gen.table("p"), gen.table("c")
    assert p.select("id").distinct().count() == 40 and c.select("id").distinct().count() == 8000
    assert c.join(p, c.p_id == p.id, "left_anti").count() == 0 and c.select("p_id").distinct().count() == 40
    share = {r["kind"]: r["count"] / 8000 for r in c.groupBy("kind").count().collect()}
    assert set(share) == {"a", "b", "c"}
    for k, w in (("a", 0.8), ("b", 0.1), ("c", 0.1)):
        assert abs(share[k] - w) < 4 * math.sqrt(w * (1 - w) / 8000)
    nulls = c.agg(F.count_if(F.col("x").isNull()).alias("x"), F.count_if(F.col("y").isNull()).alias("y")).first()
    assert abs(nulls["x"] / 8000 - 0.25) < 0.02 and nulls["y"] == 0
    assert dict(c.dtypes) == {"id": "bigint", "p_id": "string", "kind": "string", "x": "double", "y": "double", "when": "timestamp_ntz", "span": "string"}


def test_same_seed_same_rows(spark):
    cols = [ColumnSpec("t", "id", "int", is_pk=True), ColumnSpec("t", "email", "text"), ColumnSpec("t", "n", "bigint")]
    gen = G.SchemaGenerator(spark, cols, rows=300, seed=9)
    a = gen.fill("t", spark.range(0, 300, 1, 1).withColumnRenamed("id", "_r"), F.col("_r")).collect()
    b = gen.fill("t", spark.range(0, 300, 1, 9).withColumnRenamed("id", "_r"), F.col("_r")).orderBy("_r").collect()
    assert a == b
    other = G.SchemaGenerator(spark, cols, rows=300, seeds={"t": 10}).table("t").collect()
    assert [r["n"] for r in other] != [r["n"] for r in a]


def test_cycles_and_self_links(spark):
    cols = [ColumnSpec("a", "id", "int", is_pk=True), ColumnSpec("a", "b_id", "int"), ColumnSpec("a", "boss_id", "int"), ColumnSpec("b", "id", "int", is_pk=True), ColumnSpec("b", "a_id", "int"), ColumnSpec("b", "ghost_id", "int")]
    links = [Link("a", "b_id", "b", "id"), Link("b", "a_id", "a", "id"), Link("a", "boss_id", "a", "id"), Link("b", "ghost_id", "nowhere", "id")]
    made = G.SchemaGenerator(spark, cols, links, {"a": 10, "b": 50}).all()
    assert made["a"].join(made["b"], made["a"].b_id == made["b"].id, "left_anti").count() == 0
    assert made["b"].join(made["a"], made["b"].a_id == made["a"].id, "left_anti").count() == 0
    assert made["a"].where("boss_id BETWEEN 1 AND 10").count() == 10 and made["b"].where("ghost_id IS NULL").count() == 0


def test_prices(spark):
    df = spark.createDataFrame([(" Pen ", 3), ("pen", 40), ("ink", None), (None, 2)], "product string, qty int").withColumns({"price": F.lit(0.0), "total": F.lit(0.0)})
    r = G.consistent_prices(df, [("product", "string"), ("qty", "bigint"), ("price", "double"), ("total", "double")]).collect()
    assert r[0]["price"] == r[1]["price"] and 1 <= r[0]["price"] <= 50.99 and r[3]["price"] is None and r[3]["total"] is None
    assert r[0]["total"] == round(r[0]["price"] * 3, 2) and r[1]["total"] == round(r[1]["price"] * 25, 2) and r[2]["total"] == r[2]["price"]
    assert G.consistent_prices(df.drop("price", "total"), [("product", "string"), ("qty", "bigint")]).columns == ["product", "qty"]


# --- changes -------------------------------------------------------------------------


def test_bounds_and_nulls(spark):
    df = spark.range(1000).select("id", (F.col("id") * 1.0).alias("a"), F.when(F.col("id") < 600, F.lit("x")).alias("b"), F.col("id").cast("int").alias("k"), F.col("id").alias("e"))
    cfg = [
        P.ColumnConfig("a", "DOUBLE", min_val=9, max_val="3", null_percent=20), P.ColumnConfig("b", "VARCHAR", null_percent=10), P.ColumnConfig("k", "INT", min_val=5, max_val=5),
        P.ColumnConfig("e", "BIGINT", null_percent=33.33, is_nullable="no"), P.ColumnConfig("id", "BIGINT", null_percent=100, is_pk=True),
    ]
    out = P.apply_config(df, "t", cfg, ["id"])
    row = out.agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("a").alias("a"), F.count("b").alias("b"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.count("e").alias("e"), F.count("id").alias("id")).first()
    assert 3 <= row["lo"] and row["hi"] <= 9 and row["a"] == 800 and row["b"] == 600 and row["k0"] == row["k1"] == 5 and row["e"] == 1000 and row["id"] == 1000


def test_randomize_constant_and_dates(spark):
    df = spark.range(200).select("id", F.lit(4.0).alias("c"), F.lit("2024-01-01").cast("date").alias("d"), F.col("id").cast("string").alias("s"))
    cfg = [P.ColumnConfig("c", "DOUBLE", randomization_pct=50), P.ColumnConfig("d", "DATE", randomization_pct=50), P.ColumnConfig("s", "VARCHAR", randomization_pct=0.001)]
    out = P.apply_config(df, "t", cfg, ["id"], as_of="2024-06-01").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.count_if(F.col("c") != 4).alias("n"), F.count_if(F.col("d") != F.lit("2024-01-01").cast("timestamp_ntz")).alias("d"),
        F.count_if(F.col("s").startswith("s_")).alias("s"), F.min("d").alias("d0"),
    ).first()
    assert out["lo"] == 4 and out["hi"] <= 5 and out["n"] == 100 and out["s"] == 1 and 95 <= out["d"] <= 100 and out["d0"].year >= 2014


def test_noise(spark):
    df = spark.range(4000).select("id", (F.col("id") % 100).cast("double").alias("x"), F.lit(2).alias("k"))
    assert P.add_noise(df, ["x"], ["id"], stddev_scale=0).schema == df.schema
    out = P.add_noise(df, ["x", "k"], ["id"], variation_pct=10)
    d = out.join(df.withColumnRenamed("x", "x0").drop("k"), "id").agg(F.stddev_pop(F.col("x") - F.col("x0")).alias("s"), F.avg(F.col("x") - F.col("x0")).alias("m")).first()
    assert abs(d["s"] - 28.866 * 0.1) < 0.15 and abs(d["m"]) < 0.2 and dict(out.dtypes)["k"] == "bigint"
    assert P.generation_parameters(df, [], ["id"], 1, {"variation_pct": 0, "stddev_scale": 0}).schema == df.schema


def test_knn_brute_force(spark):
    rng = np.random.default_rng(3)
    src = pd.DataFrame({"id": range(60), "a": rng.normal(size=60), "b": rng.normal(size=60)})
    rows = pd.DataFrame({"id": range(80), "a": rng.normal(size=80), "b": rng.normal(size=80)})
    rows.loc[5, "a"] = np.nan
    sdf = spark.createDataFrame(rows).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    got = {r["id"]: (r["a"], r["b"]) for r in P.knn_smooth(sdf, spark.createDataFrame(src), ["a", "b"], ["id"], smoothing=0.3, neighbors=4).collect()}
    m, s = src[["a", "b"]].to_numpy().mean(0), src[["a", "b"]].to_numpy().std(0)
    for i, x in enumerate(rows[["a", "b"]].to_numpy()):
        if np.isnan(x).any():
            assert got[i][0] is None and got[i][1] == x[1]
            continue
        near = np.argsort((((src[["a", "b"]].to_numpy() - x) / s) ** 2).sum(1), kind="stable")[:4]
        assert np.allclose(got[i], 0.7 * x + 0.3 * src[["a", "b"]].to_numpy()[near].mean(0))


# --- copula --------------------------------------------------------------------------


def source(spark, n=6000):
    x = spark.range(n).select("id", F.randn(3).alias("u"), F.randn(4).alias("v"))
    return x.select(
        F.col("id").alias("key"), (F.col("u") * 10 + 50).alias("a"), (F.col("u") * 2 + F.col("v")).alias("b"), F.when(F.col("id") % 5 != 0, F.round(F.col("v") * 2).cast("int")).alias("i"),
        F.when(F.col("u") > 0, F.lit("hi")).otherwise("lo").alias("c"), F.concat(F.lit("text "), (F.col("id") % 3000)).alias("t"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 4000).cast("int"))).alias("w"),
    )


def test_copula_keeps_marginals_and_correlation(spark):
    from likeness.session import cut_lineage

    src = cut_lineage(source(spark))
    out = cut_lineage(K.synthesize(src, 6000, seed=2, key="key"))
    a = src.agg(F.corr("a", "b").alias("r"), F.avg("a").alias("m"), F.stddev("a").alias("s"), F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("i").alias("i"), F.count_if(F.col("c") == "hi").alias("c")).first()
    b = out.agg(F.corr("a", "b").alias("r"), F.avg("a").alias("m"), F.stddev("a").alias("s"), F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("i").alias("i"), F.count_if(F.col("c") == "hi").alias("c")).first()
    assert abs(a["r"] - b["r"]) < 0.05 and abs(a["m"] - b["m"]) < 0.8 and abs(a["s"] - b["s"]) < 0.6 and b["lo"] >= a["lo"] - 1e-9 and b["hi"] <= a["hi"] + 1e-9
    assert abs(a["i"] - b["i"]) < 250 and abs(a["c"] - b["c"]) < 250
    assert out.select("key").distinct().count() == 6000 and dict(out.dtypes)["i"] == "int" and dict(out.dtypes)["w"] == "timestamp_ntz"
    assert out.join(src.select("t").distinct(), "t", "left_anti").count() == 0
    sides = out.groupBy("c").agg(F.avg("a").alias("m")).collect()
    assert abs(sides[0]["m"] - sides[1]["m"]) > 8


def test_copula_does_not_depend_on_the_number_of_values(spark):
    """2,000 codes and as many numbers, both tied to a side: no value that the source lacks, ties kept, and the same rows wherever the tables are kept."""
    src = spark.range(8000).select(
        F.when(F.col("id") % 7 != 0, (F.col("id") % 2000) * 1000 + 7).alias("code"), F.concat(F.when(F.col("id") % 2000 < 1000, F.lit("a")).otherwise("b"), F.col("id") % 2000).alias("name"),
        F.when(F.col("id") % 2000 < 1000, F.lit("low")).otherwise("high").alias("side"), (F.lit("2024-01-01").cast("date") + (F.col("id") % 1500).cast("int")).alias("day"),
    )
    out = K.synthesize(src, 8000, seed=3).toPandas()
    have = src.toPandas()
    assert len(out) == 8000
    for c in src.columns:
        assert set(out[c].dropna()) <= set(have[c].dropna()), c
        assert abs(out[c].isna().sum() - have[c].isna().sum()) < 200
    halves = out.groupby("side")["code"].mean()
    assert halves["high"] - halves["low"] > 700_000  # 1,000,000 in the source
    rank = {v: i for i, v in enumerate(sorted(have["name"].unique()))}
    assert abs(np.corrcoef(out["name"].map(rank), out["side"] == "low")[0, 1]) > 0.6  # 0.87 in the source
    cut, whole = (K.synthesize(src, 8000, seed=3, model=K.fit(src, value_limit=v)).orderBy("_row").collect() for v in (0, 10**6))
    assert cut == whole


def test_long_texts_are_drawn_by_name(spark):
    """Long texts, a third of the rows one text, nulls and equal heads: the same rows as with all values on the driver, and no text in the model."""
    text = F.concat(F.repeat(F.lit("the same beginning "), 4), (F.col("id") % 900).cast("string"), F.lit(" Ünd \U0001f600"))
    src = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot "), F.repeat(F.lit("x"), 200))).when(F.col("id") % 11 != 0, text).alias("long"), (F.col("id") % 3).alias("k"))
    model = K.fit(src, value_limit=0)
    named = model.marginals[0]
    assert dict(named.table.dtypes)["_value"] == "binary" and named.texts.count() == src.select("long").where("long IS NOT NULL").distinct().count()
    assert K._often_drawn(named) and len(K._often_drawn(named)) == 1
    cut, whole = (K.synthesize(src, 5000, seed=4, model=m).orderBy("_row").collect() for m in (model, K.fit(src, value_limit=10**6)))
    assert cut == whole and len(cut) == 5000
    hot, none = sum((r["long"] or "").startswith("hot") for r in cut), sum(r["long"] is None for r in cut)
    assert abs(hot - 5000 / 3) < 150 and abs(none - 5000 * 182 / 3000) < 100


def test_drawn_values_follow_frequencies_with_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 100)
    src = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("v"), "id")).alias("t"))
    out = K.draw_column(spark.range(9000), ["id"], src, "t", 1, "s")
    row = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == "hot").alias("h"), F.count_if(F.col("t").isNull()).alias("z")).first()
    assert row["n"] == 9000 and abs(row["h"] - 3000) < 250 and abs(row["z"] - 3000) < 250


def test_expanding_in_chunks_is_complete(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 7)
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 7), (4, 8), (5, 50)], "k int, n bigint")
    got = K.explode_counts(df, ["k"], "n", "i", 50).groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("i").alias("d"), F.max("i").alias("m")).collect()
    assert {r["k"]: (r["c"], r["d"], r["m"]) for r in got} == {2: (1, 1, 0), 3: (7, 7, 6), 4: (8, 8, 7), 5: (50, 50, 49)}


def test_repeated_rows_are_never_broadcast(spark):
    """A short value table stands for any number of rows; its places must not go through the driver."""
    src = spark.range(6000).select((F.col("id") % 30).alias("x"), F.concat(F.lit("v"), F.col("id") % 40).alias("t"))
    model = K.fit(src, value_limit=0)
    for df, keys in ((K.sample_on(spark.range(50), ["id"], model), ["_v0", "_v1"]), (K.draw_column(spark.range(50), ["id"], src, "t", 1, "s"), ["_place"])):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert all(f"SortMergeJoin [{k}#" in plan for k in keys) and df.count() == 50


def test_factor_repairs_bad_matrices():
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]])
    f = K.positive_factor(bad)
    assert np.allclose(np.diag(f @ f.T), 1) and np.isfinite(f).all()


def test_multi_table_synthesis(spark):
    parent = spark.range(30).select(F.concat(F.lit("p"), "id").alias("pid"), (F.col("id") * 1.5).alias("x"))
    child = spark.range(500).select("id", F.concat(F.lit("p"), F.col("id") % 30).alias("pid"), (F.col("id") % 9).alias("q"))
    out = M.synthesize_tables({"p": parent, "c": child}, [Link("c", "pid", "p", "pid"), Link("c", "nope", "p", "pid")], num_rows=200, row_counts={"p": 50})
    assert out["p"].count() == 50 and out["c"].count() == 200 and out["p"].select("pid").distinct().count() == 50
    assert out["c"].join(out["p"], "pid", "left_anti").count() == 0 and out["c"].columns == child.columns


def test_hierarchy_follows_parents(spark):
    parent = spark.range(400).select(F.col("id").alias("pid"), F.when(F.col("id") % 2 == 0, F.lit("big")).otherwise("none").alias("kind"))
    child = spark.range(400 * 6).select(F.col("id").alias("cid"), ((F.col("id") % 200) * 2).alias("pid"), ((F.col("id") % 200) * 1.0 + F.rand(1)).alias("v"))
    made = M.synthesize_hierarchy({"p": parent, "c": child}, [Link("c", "pid", "p", "pid")], 2400, keys={"p": "pid", "c": "cid"})
    assert made["p"].count() == 400 and made["c"].join(made["p"], "pid", "left_anti").count() == 0
    fan = made["p"].join(made["c"].groupBy("pid").agg(F.count(F.lit(1)).alias("n")), "pid", "left").groupBy("kind").agg(F.avg(F.coalesce("n", F.lit(0))).alias("m")).collect()
    by = {r["kind"]: r["m"] for r in fan}
    assert by["big"] > 9 and by["none"] < 3  # 12 and 0 in the source
    within = made["c"].groupBy("pid").agg(F.stddev("v").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 5").agg(F.avg("s")).first()[0]
    whole = made["c"].agg(F.stddev("v")).first()[0]
    assert within < whole / 5 and made["c"].select("cid").distinct().count() == made["c"].count()


def test_children_without_orphans_are_written_once(spark, monkeypatch):
    """Plans that read cleaned children hold none of the joins that cleaned them."""
    plans = []
    monkeypatch.setattr(M, "child_aggregates", lambda child, *a, made=M.child_aggregates: (plans.append(child._jdf.queryExecution().analyzed().toString()), made(child, *a))[1])
    parent = spark.range(20).select(F.col("id").alias("pid"), (F.col("id") * 2.0).alias("size"))
    child = spark.range(200).select(F.col("id").alias("cid"), (F.col("id") % 25).alias("pid"), (F.col("id") % 7).alias("v"))
    made = M.synthesize_hierarchy({"p": parent, "c": child}, [Link("c", "pid", "p", "pid")], 160, keys={"p": "pid", "c": "cid"})
    assert made["c"].join(made["p"], "pid", "left_anti").count() == 0 and plans and not any("Join" in p for p in plans)


def test_checks_of_tables_run_one_after_the_other(spark):
    """Rows, lost keys and bounds of made tables come as figures, not as one plan over all of them."""
    src = {"p": spark.createDataFrame([(1, 0.0), (2, 5.0)], "k int, x double"), "c": spark.createDataFrame([(1, 1), (2, 2)], "id int, k int")}
    made = {"p": spark.createDataFrame([(1, 0.0), (2, 9.0)], "k int, x double"), "c": spark.createDataFrame([(1, 1), (2, 7), (3, None)], "id int, k int")}
    out = synthesis._checks(src, made, [Link("c", "k", "p", "k")], rows=True)
    assert {r["check"]: r["n"] for r in out.collect()} == {"c.k": 1, "p out of bounds": 1, "p rows": 2, "c out of bounds": 0, "c rows": 3}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_bundles(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", None)], "id int, t string, d timestamp_ntz").withColumn("d", F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))
    cfg = {"x": [{"column_name": "d", "data_type": "TIMESTAMP", "output_format": "%d/%m/%Y %H:%M"}]}
    B.write_tables({"x": df.drop("t"), "y": df.drop("t")}, str(tmp_path / "csv"), "csv", cfg)
    back = B.read_tables(spark, str(tmp_path / "csv"), "csv")
    assert sorted(back) == ["x", "y"] and back["x"].first()["d"] == "06/05/2024 07:08"
    B.write_tables({"x": df}, str(tmp_path / "pq"), "parquet")
    assert B.read_tables(spark, str(tmp_path / "pq"), "parquet")["x"].collect() == df.collect()
    with pytest.raises(ValueError):
        B.write_tables({"x": df}, str(tmp_path / "z"), "zip")
    assert B.file_sizes(spark, [str(tmp_path / "pq" / "x")]).agg(F.sum("size_bytes")).first()[0] > 0
