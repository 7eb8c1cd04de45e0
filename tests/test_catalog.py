import pytest
from pyspark.sql import functions as F

from likeness.operators import catalog as C
from likeness.plans import columns
from likeness.operators import graph as G

SHOP = {
    "orders": ["order_id", "created_at", "website_session_id", "user_id", "primary_product_id"], "order_items": ["order_item_id", "order_id", "product_id", "price_usd", "cogs_usd"],
    "products": ["product_id", "created_at", "product_name"], "website_sessions": ["website_session_id", "user_id", "city", "country", "sub_category", "type"],
}


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(t, c, i, "varchar", False, i > 0) for t, cols in SHOP.items() for i, c in enumerate(cols, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string, is_pk boolean, is_nullable boolean")


def test_links_by_name(spark, shop):
    got = {(r["from_table"], r["from_column"], r["to_table"], r["to_column"]) for r in C.infer_links(shop).collect()}
    assert got == {
        ("order_items", "order_id", "orders", "order_id"), ("order_items", "product_id", "products", "product_id"), ("orders", "website_session_id", "website_sessions", "website_session_id"),
    }
    assert {tuple(r) for r in C.infer_links(shop, min_rows=1).select("from_table", "from_column", "to_table", "to_column").collect()} == got
    assert C.infer_links(shop.where("table_name = 'orders'")).count() == 0


def test_key_rules(spark):
    rows = [("users", "name", 1, False), ("users", "id", 2, False), ("buses", "x", 1, False), ("buses", "bus_id", 2, False), ("t", "a", 1, False), ("t", "b", 2, True), ("z", "q", 1, False), ("z", "r", 2, False)]
    cols = spark.createDataFrame(rows, "table_name string, column_name string, position int, is_pk boolean")
    assert {r["table_name"]: r["pk_column"] for r in C.pick_keys(cols).collect()} == {"users": "id", "buses": "bus_id", "t": "b", "z": "q"}


def test_associations(spark, shop):
    got = {(r["col_a"], r["col_b"]): r["association"] for r in C.associations(shop).where("table_name = 'order_items'").collect()}
    assert got == {("order_item_id", "order_id"): "identifier", ("order_item_id", "product_id"): "identifier", ("order_id", "product_id"): "identifier", ("price_usd", "cogs_usd"): "derived"}
    wide = spark.range(40).select(F.lit("w").alias("table_name"), F.concat(F.lit("c"), "id", F.lit("_id")).alias("column_name"), F.col("id").cast("int").alias("position"))
    rows = C.associations(wide).orderBy("rank").collect()
    assert len(rows) == 12 and [r["col_b"] for r in rows] == [f"c{i}_id" for i in range(1, 13)]


@pytest.mark.parametrize(
    "text,want",
    [("VARCHAR(20)", "varchar"), ("double  precision", "double"), ("timestamp with time zone", "timestamp"), ("NUMERIC(8,2)", "decimal"), ("Character Varying(3)", "varchar"), ("interval", "varchar"), ("", "varchar"), ("Int", "integer")],
)
def test_types(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.normal_type("t")).first()[0] == want


def test_category_families(spark):
    rows = [
        (1, "gender", "m, F", "auto", "varchar", True), (2, "anything", "phd; bachelors", "categorical", "varchar", True), (3, "notes", "x, y", "auto", "varchar", True),
        (4, "gender", "m", "auto", "varchar", True), (5, "gender", "m, f", "auto", "int", True), (6, "gender", "m, f", "auto", "varchar", False), (7, "mood", "prefer not to say, other", "auto", "text", True),
    ]
    df = spark.createDataFrame(rows, "id int, column_name string, allowed_values string, generator_type string, data_type string, expand_categories boolean")
    got = {r["id"]: r["expanded_values"] for r in C.expand_categories(df).collect()}
    assert got == {
        1: "Male, Female, Non-binary, Prefer not to say", 2: "Doctorate, Bachelor, High School, Associate, Master", 3: "x, y",
        7: "Prefer not to say, Non-binary, Male, Female",
    }
    assert {r["id"]: r["expanded_values"] for r in C.expand_categories(df, 3).collect()}[1] == "Male, Female, Non-binary"


def edges(spark, rows):
    return spark.createDataFrame(rows, "parent string, child string, cardinality string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_layers_and_rows(spark):
    e = edges(spark, [("a", "b", "1:N"), ("a", "c", "1:1"), ("b", "d", "1:1"), ("c", "d", "1:N"), ("b", "d", "1:1")])
    got = {r["node"]: (r["tier"], r["rows"]) for r in G.plan_rows(nodes(spark, "abcde"), e, 10).collect()}
    assert got == {"a": (0, 10), "e": (0, 10), "b": (1, 50), "c": (1, 10), "d": (2, 50)}


def test_cycles_form_the_last_layer(spark):
    e = edges(spark, [("a", "b", "1:N"), ("b", "c", "1:N"), ("c", "b", "1:N"), ("c", "d", "1:1")])
    got = {r["node"]: (r["tier"], r["rows"]) for r in G.plan_rows(nodes(spark, "abcd"), e, 10).collect()}
    assert got["a"] == (0, 10) and got["b"] == (1, 50) and got["c"] == (1, 50) and got["d"] == (1, 10)
    two = {r["node"]: r["tier"] for r in G.tiers(nodes(spark, ["company", "users"]), edges(spark, [("company", "users", "1:N"), ("users", "company", "1:N")])).collect()}
    assert set(two.values()) == {1} or set(two.values()) == {0}


def test_long_chain(spark):
    e = edges(spark, [(f"n{i}", f"n{i + 1}", "1:1") for i in range(12)])
    got = {r["node"]: r["tier"] for r in G.tiers(nodes(spark, ["n0"]), e).collect()}
    assert got == {f"n{i}": i for i in range(13)}


def test_deep_chain_with_branches(spark):
    n = 20_000
    chain = spark.range(n).select(F.concat(F.lit("n"), "id").alias("parent"), F.concat(F.lit("n"), F.col("id") + 1).alias("child"), F.when(F.col("id") < 3, "1:N").otherwise("1:1").alias("cardinality"))
    more = edges(spark, [("n5", "side", "1:N"), ("side", "n9", "1:1"), (f"n{n}", "x", "1:1"), ("x", "y", "1:1"), ("y", "x", "1:1")])
    got = {r["node"]: (r["tier"], r["rows"]) for r in G.plan_rows(nodes(spark, ["n0"]), chain.unionByName(more), 2).collect()}
    assert all(got[f"n{i}"] == (i, 2 * 5 ** min(i, 3) * (5 if i >= 9 else 1)) for i in range(n + 1))
    assert got["side"] == (6, 1250) and got["x"] == (n + 1, 1250) and got["y"] == (n + 1, 2)


def test_document_pages(spark):
    cols = spark.range(2500).select(F.lit(1).alias("table_id"), (F.col("id") + 1).alias("position"), F.concat(F.lit("c"), "id").alias("column_name"), F.lit("int").alias("data_type"))
    tables = spark.createDataFrame([(1, "big"), (2, "none")], "table_id int, table_name string")
    got = sorted((r["table_id"], r["page"], len(r["columns"] or [])) for r in C.project_documents(tables, cols).collect())
    assert got == [(1, 0, 1000), (1, 1, 1000), (1, 2, 500), (2, 0, 0)]


def test_all_associations_and_the_first_few(spark):
    names = ["a_id", "city", "b_id", "state", "c_id", "price", "unit_cost", "d_id"]
    df = spark.createDataFrame([("t", i, n) for i, n in enumerate(names)] + [("u", 0, "city"), ("u", 1, "country"), ("v", 0, "x")], "table_name string, position int, column_name string")
    ids = [n for n in names if n.endswith("_id")]
    want = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]] + [("city", "state"), ("price", "unit_cost")]
    got = [(r["col_a"], r["col_b"]) for r in C.associations(df, None).where("table_name = 't'").orderBy("rank").collect()]
    assert got == want
    few = [(r["col_a"], r["col_b"]) for r in C.associations(df, 3).where("table_name = 't'").orderBy("rank").collect()]
    assert few == want[:3]
    assert [(r["col_a"], r["col_b"]) for r in C.associations(df, None).where("table_name = 'u'").collect()] == [("city", "country")]


def test_proposed_links_and_their_catalog_are_made_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "one two three two one"), (2, "two one id"), (None, "three one")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    monkeypatch.setattr(columns, "word_links", lambda *a, of=columns.word_links: made.append(of(*a)) or made[-1])
    got = columns.link_validate(spark, str(tmp_path))
    assert len(made) == 1 and got.exceptAll(columns.C.validate_links(columns._raw_links(made[0]), made[0])).count() == 0
