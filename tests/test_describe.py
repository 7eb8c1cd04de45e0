import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.functions import dates as D
from likeness.functions import replies as J
from likeness.functions import text as X
from likeness.operators import pii
from likeness.operators import profile as P
from likeness.operators import relate as L


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("A|3,B|1", [("A", 0.75), ("B", 0.25)]), ("A|0", [("A", 1.0)]), ("A|x", [("A", 1.0)]), ("A|-2,B", [("A", 0.0), ("B", 1.0)]),
        ("A|0,B|0", [("A", 0.5), ("B", 0.5)]), ("a\nb;a|9,, \tc ", [("a", 1 / 3), ("b", 1 / 3), ("c", 1 / 3)]), ("", []), ("x|y|2", [("x|y", 1.0)]),
    ],
)
def test_weights(spark, text, want):
    got = [(e["value"], e["weight"]) for e in one(spark, X.weighted_values("t"), t=text)]
    assert [v for v, _ in got] == [v for v, _ in want] and np.allclose([w for _, w in got], [w for _, w in want])
    assert [v for v, _ in X.parse_weighted(text)] == [v for v, _ in want] and np.allclose([w for _, w in X.parse_weighted(text)], [w for _, w in want])


@pytest.mark.parametrize("word,want", [("categories", "category"), ("ies", "ie"), ("buses", "bus"), ("ses", "se"), ("users", "user"), ("s", "s"), ("id", "id")])
def test_singular(spark, word, want):
    assert one(spark, X.singular(F.col("w")), w=word) == want


def test_replies_and_dates(spark):
    assert one(spark, J.json_object("t"), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, J.json_object("t"), t='x {"a": {"b": 2}} y') == '{"a": {"b": 2}}'
    assert one(spark, J.json_object("t"), t="[1, 2]") is None and one(spark, J.json_object("t"), t="{no") is None
    assert one(spark, J.other_details("t"), t='{"b": {"z": 1}, "a": "x", "total_tokens": 5}') == '{"a": "x", "b": {"z":1}}'
    assert one(spark, J.token_count("t"), t='{"total_tokens": 5}') == "5" and one(spark, J.other_details("t"), t=" plain ") == "plain"
    assert one(spark, D.display_time("t", "Asia/Kolkata"), t="1704449472") == "2024-01-05 15:41:12"
    assert one(spark, D.display_time("t"), t="") == "Never"
    assert one(spark, D.format_datetime(F.col("t"), "%d.%m.%y"), t="2024-02-03 04:05:06") == "03.02.24"
    assert one(spark, D.format_datetime(F.col("t"), "%d.%m.%y"), t="soon") == "soon"
    with pytest.raises(ValueError):
        D.spark_pattern("%U")


def test_profile_edges(spark):
    schema = "n double, c int, z string, a array<int>, d decimal(10,2), b boolean"
    df = spark.createDataFrame([(1.0, 7, None, [1], None, True), (float("nan"), 7, None, [2], None, False), (float("inf"), 7, None, None, None, None)], schema)
    rows = {r["column"]: r for r in P.profile(df, cardinality="exact").collect()}
    assert "a" not in rows and rows["z"]["nulls"] == 3 and rows["z"]["min"] is None and rows["z"]["cardinality"] == 0
    assert rows["c"]["sd"] == 0.0 and rows["n"]["sd"] is None and rows["b"]["min"] == "false" and rows["d"]["null_value_percent"] == 100.0
    empty = P.profile(df.where("c = 0")).collect()
    assert all(r["nulls"] == 0 and r["profiled_rows"] == 0 and r["null_value_percent"] is None for r in empty)
    sampled = P.profile(spark.range(100), sample_rows=10).first()
    assert sampled["profile_mode"] == "sampled" and sampled["total_rows"] is None and 0 < sampled["profiled_rows"] < 40


def test_sketch_is_close_and_wide_tables_match(spark, monkeypatch):
    df = spark.range(20000).select("id", (F.col("id") % 37).alias("m"), F.lit(None).cast("string").alias("e"))
    got = {r["column"]: r["cardinality"] for r in P.approx_distinct_counts(df, df.columns).collect()}
    assert abs(got["id"] - 20000) < 1000 and got["m"] == 37 and got["e"] == 0
    per = {r["column"]: r["cardinality"] for r in P.distinct_counts(df, ["id", "m"]).collect()}
    monkeypatch.setattr(P, "LONG_FROM", 1)
    assert {r["column"]: r["cardinality"] for r in P.distinct_counts(df, ["id", "m"]).collect()} == per == {"id": 20000, "m": 37}


@pytest.mark.parametrize("method", ["expression", "matrix"])
def test_pearson_against_pandas(spark, method):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) + 1e6
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=400)
    x[:, 3] = 5.0
    import pandas as pd

    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::5, "c"] = np.nan
    want = pdf.corr().fillna(0.0)
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in L.pearson(df, top_k=None, method=method).collect()}
    assert len(got) == 6
    for (a, b), r in got.items():
        assert math.isclose(r, want.loc[a, b], abs_tol=1e-6)
    top = L.pearson(df, top_k=1, method=method).collect()
    assert [(r["col_a"], r["col_b"]) for r in top] == [("a", "b")]


def test_cramers_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, 500), rng.integers(0, 3, 500)
    b = np.where(a == 0, 0, b)
    df = spark.createDataFrame([(f"a{x}", f"b{y}", "same", str(i)) for i, (x, y) in enumerate(zip(a, b))], "a string, b string, k string, u string")
    obs = np.zeros((4, 3))
    np.add.at(obs, (a, b), 1)
    exp = obs.sum(1, keepdims=True) @ obs.sum(0, keepdims=True) / obs.sum()
    want = math.sqrt(((obs - exp) ** 2 / exp).sum() / (obs.sum() * 2))
    got = L.cramers_v(df, max_unique=50).collect()
    assert {(r["col_a"], r["col_b"]) for r in L.cramers_v(df).collect()} == {("a", "b"), ("a", "u"), ("b", "u")}
    assert [(r["col_a"], r["col_b"]) for r in got] == [("a", "b")] and math.isclose(got[0]["score"], want, rel_tol=1e-9)


def test_drop_orphans_with_hot_key(spark):
    child = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 3 == 1, F.col("id")).cast("bigint").alias("fk"))
    parent = spark.range(10)
    out = L.drop_orphans(child, "fk", parent, "id", min_rows=50)
    assert out.where("fk IS NULL").count() == 300 and out.where("fk = 5").count() == 300 and out.where("fk > 9").count() == 0


def test_pii_quirks(spark):
    def name(c, match="contains"):
        return one(spark, pii.name_signal("c", match), c=c)["pii_type"]

    assert name("company") == "ssn" and name("hotel") == "phone" and name("company", "token") == "unknown" and name("Customer Name") == "person_name" and name("qty") == "unknown"
    rows = [("4111111111111",) if i % 2 else ("\t4111111111111 ",) for i in range(8)] + [("",), (None,)]
    got = pii.detect(spark.createDataFrame(rows, "v string")).first()
    assert got["pii_type"] == "phone" and got["confidence"] == 0.98  # 13 digits are a phone before a card
    ssn = pii.detect(spark.createDataFrame([("123-45-6789",)] * 3 + [("x",)], "v string")).first()
    assert ssn["pii_type"] == "ssn" and ssn["regex_score"] == round(0.55 + 0.75 * 0.45, 4)
    weak = pii.detect(spark.createDataFrame([("a@b.org",)] + [("x",)] * 5, "v string")).first()
    assert not weak["is_pii"] and weak["pii_type"] == "unknown"


def test_entity_hook(spark):
    df = spark.createDataFrame([(i, "Paris" if i % 2 else "abc") for i in range(20)], "id int, w string")
    got = pii.detect(df, ["w"], tagger=lambda texts: [{"GPE"} if t == "Paris" else set() for t in texts], ids=["id"]).first()
    assert got["pii_type"] == "address" and got["ner_score"] == 0.7


def test_top_values_keep_few_rows_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 50).cast("string").alias("v"))
    plan = P.value_counts(df, ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_profile_reads_only_its_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = P.profile(df, ["l_tax"])._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "l_tax" in plan


@pytest.mark.parametrize("method", ["expression", "matrix"])
def test_constant_columns_spread_over_partitions(spark, method):
    df = spark.range(900).repartition(7).select((F.col("id") * 1.0).alias("x"), F.lit(0.1).alias("c"), (F.lit(1e9) + F.col("id") / 1e5).alias("far")).where("x >= 0")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in L.pearson(df.repartition(11), top_k=None, method=method).collect()}
    assert got["x", "c"] == 0.0 and got["c", "far"] == 0.0 and got["x", "far"] > 0.999999
