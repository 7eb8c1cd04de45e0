from pyspark.sql import functions as F

from likeness.operators import catalog as C
from likeness.operators import documents as N

PROJECTS = [("a", "CSV"), ("b", "SQL"), (None, "X")]
TABLES = [("a", i, f"t{i:03d}", i * 10) for i in range(23)] + [("a", None, "lost", 1), (None, 99, "lost", 1), ("gone", 50, "u", None)]
COLUMNS = [(0, f"0/{i}", i, f"c{i}", i % 3 == 0, None if i % 2 else "x" * 100) for i in range(17)] + [(1, "1/0", 5, "k", None, ""), (1, "1/1", 5, "k", True, "m"), (77, "77/0", 1, "z", True, "m")]
LINKS = [("a", f"t{i:03d}", "id", f"t{i + 1:03d}", "id") for i in range(9)] + [("a", "t000", "id", "t001", "id"), (None, "x", "y", "z", "w")]


def inputs(spark, tables=TABLES, columns=COLUMNS, links=LINKS, projects=PROJECTS):
    return (
        spark.createDataFrame(projects, "project_id string, source_type string"), spark.createDataFrame(tables, "project_id string, table_id long, table_name string, row_count long"),
        spark.createDataFrame(columns, "table_id long, column_id string, position int, column_name string, is_pii boolean, min string"),
        spark.createDataFrame(links, "project_id string, from_table string, from_column string, to_table string, to_column string"),
    )


def test_pages_hold_everything_once_and_in_order(spark):
    pages, more = N.project_pages(*inputs(spark), tables_page=5, columns_page=4, links_page=3)
    rows = {(r["project_id"], r["page"]): r for r in pages.collect()}
    assert sorted(rows) == [("a", p) for p in range(5)] + [("b", 0)]
    assert [rows["a", p]["next_page"] for p in range(5)] == [1, 2, 3, 4, None] and rows["b", 0]["next_page"] is None
    assert [t["table_id"] for p in range(5) for t in rows["a", p]["tables"]] == list(range(23))
    assert [len(rows["a", p]["relations"]) for p in range(5)] == [3, 3, 3, 1, 0] and rows["a", 0]["relation_count"] == 10
    assert (rows["b", 0]["tables"], rows["b", 0]["relations"], rows["b", 0]["table_count"], rows["b", 0]["source_type"]) == ([], [], 0, "SQL")
    first, second, third = rows["a", 0]["tables"][:3]
    assert (first["column_count"], first["pii_count"], first["next_columns"], len(first["columns"])) == (17, 6, 1, 4)
    assert [c["column_id"] for c in second["columns"]] == ["1/0", "1/1"] and second["next_columns"] is None and second["pii_count"] == 1
    assert third["columns"] == [] and third["column_count"] == 0
    rest = {r["page"]: r for r in more.where("table_id = 0").collect()}
    assert [rest[p]["next_page"] for p in range(1, 5)] == [2, 3, 4, None]
    names = [c["column_name"] for c in first["columns"]] + [c["column_name"] for p in range(1, 5) for c in rest[p]["columns"]]
    assert names == [f"c{i}" for i in range(17)]


def test_digest_is_short_and_counts_all(spark):
    values = spark.range(200).select(F.lit(0).cast("long").alias("table_id"), F.concat(F.lit("c"), F.col("id") % 8).alias("column_name"), "id", F.when(F.col("id") >= 16, F.when(F.col("id") < 24, F.lit("  ")).otherwise(F.repeat(F.col("id").cast("string"), 30))).alias("value"))
    values = values.withColumnRenamed("id", "row")
    rows = {r["project_id"]: r for r in N.project_digests(*inputs(spark), values).collect()}
    assert sorted(rows) == ["a", "b"]
    a = rows["a"]
    assert (a["table_count"], a["relation_count"], len(a["tables"]), len(a["relations"])) == (23, 10, 8, 10)
    first = a["tables"][0]
    assert (first["column_count"], first["pii_count"], len(first["columns"])) == (17, 6, 17)
    assert first["columns"][0]["min"] == "x" * 64 + "..." and first["columns"][1]["min"] is None
    # nulls are passed over, the blank one of the first four left out, columns after the sixth have none
    assert [v[:4] for v in first["columns"][0]["samples"]] == ["2424", "3232", "4040"] and all(len(v) == 35 for v in first["columns"][0]["samples"])
    assert first["columns"][6]["samples"] == [] and a["tables"][1]["columns"][0]["samples"] == []
    assert rows["b"]["tables"] == [] and rows["b"]["relations"] == []


def test_empty_catalog(spark):
    none = inputs(spark, [], [], [], [])
    pages, more = N.project_pages(*none)
    assert pages.count() == 0 and more.count() == 0
    values = spark.createDataFrame([], "table_id long, column_name string, row long, value string")
    assert N.project_digests(*none, values).count() == 0


def test_digest_bounds_rows_before_the_shuffle(spark):
    values = spark.createDataFrame([], "table_id long, column_name string, row long, value string")
    plan = N.value_samples(values)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_columns_that_lie_by_table_are_not_shuffled_again(spark):
    cols = spark.range(400).select((F.col("id") % 9).alias("table_id"), F.concat(F.lit("c"), "id").alias("column_id"), F.col("id").alias("position"), (F.col("id") % 2 == 0).alias("is_pii"))
    plan = N.column_pages(cols.repartition(4, "table_id"), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_wide_tables_have_the_same_pages(spark, monkeypatch):
    """A table that is numbered by a range shuffle, and one that is numbered in a task."""
    rows = [(t, f"c{i}", i // 2, i % 3 == 0) for t, n in ((1, 23), (2, 4), (3, 11)) for i in range(n)] + [(None, "c", 1, True)]
    cols = spark.createDataFrame(rows, "table_id int, column_id string, position int, is_pii boolean")
    pages = lambda: sorted(tuple(r) for r in N._column_lists(cols, 5).collect())
    whole = pages()
    monkeypatch.setattr(N, "heavy_keys", lambda df, on: df.where("table_id IN (1, 3)").select(*on).distinct().collect())
    assert pages() == whole and len(whole) == 5 + 1 + 3
    assert {(r[0], r[3], r[4]) for r in whole} == {(1, 23, 8), (2, 4, 2), (3, 11, 4)} and [r[2] for r in whole if r[0] == 3] == [1, 2, None]
    assert [c["column_id"] for r in whole if r[0] == 1 for c in r[5]] == [f"c{i}" for i in range(23)]


def test_profiles_that_name_their_table(spark):
    """The join with profiles by table and column gives the rows of the join by column."""
    cols = spark.createDataFrame([(1, "1/a"), (1, "1/b"), (2, "2/a"), (2, "2/a")], "table_id int, column_id string")
    prof = spark.createDataFrame([(1, "1/a", 5), (2, "2/a", 6)], "table_id int, column_id string, cardinality int")
    both = [sorted((r["table_id"], r["column_id"], r["cardinality"] or 0) for r in C.columns_with_stats(cols, p).collect()) for p in (prof, prof.drop("table_id"))]
    assert both[0] == both[1] == [(1, "1/a", 5), (1, "1/b", 0), (2, "2/a", 6), (2, "2/a", 6)]
