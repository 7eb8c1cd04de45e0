"""Nested documents of whole projects: pages of bounded size, and a short digest.

A page holds so many tables, each with its first columns, and so many links; ``next_page`` names the page to read next.
Columns beyond a table's first page come as rows of their own. Tables, links and the columns of very wide tables are numbered by a
range shuffle, so a project with most of all tables, or a table with most of all columns, is never in one task; no array is longer
than its page. The columns of all other tables are numbered where they lie, if that is by table.

Rows without a project or table id belong to no document and are left out. Columns and links of unknown tables or projects
are left out as well. Projects without tables, and tables without columns, have empty lists and counts of 0. Rows repeated
in every column are all listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, quote
from ..session import cut_lineage
from .joins import heavy_keys, skew_join
from .rows import ordered_index

LINK_FIELDS = ["from_table", "from_column", "to_table", "to_column"]


def _entries(df: DataFrame, keys: list[str], number: str, fields: list[str], name: str, same: list[str] = ()) -> DataFrame:
    """One list per key, in the order of ``number``; the caller bounds how many rows a key has. ``same`` columns have one value per key."""
    entry = F.struct(F.col(number).alias("_n"), *[F.col(quote(f)) for f in fields])
    ordered = F.array_sort(F.collect_list(entry))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias(name), *[F.max(c).alias(c) for c in same])


def _column_fields(columns: DataFrame) -> list[str]:
    return [c for c in columns.columns if c != "table_id"]


def _paged(df: DataFrame, key: str, order: list[str], size: int, page: str) -> DataFrame:
    """Rows with their number inside the key and the page this falls on."""
    numbered = ordered_index(df, [key], order, "_i")
    return numbered.withColumn(page, F.floor(F.col("_i") / size).cast("bigint"))


def column_pages(columns: DataFrame, size: int = 200) -> DataFrame:
    """(table_id, page, next_page, column_count, columns): all columns of all tables by position, ``size`` to a page."""
    return _column_lists(columns, size).drop("pii_count")


def _column_lists(columns: DataFrame, size: int, counted: DataFrame | None = None) -> DataFrame:
    """``column_pages`` with the pii_count of the table.

    Tables are numbered inside one task each, next to their counts, so that rows that lie by table are not shuffled again;
    only the few tables with so many columns that a task could not hold them are numbered by a range shuffle.
    """
    known = columns.where("table_id IS NOT NULL")
    flags = F.count_if("is_pii") if "is_pii" in columns.columns else F.count_if(F.lit(False))
    counts = {"column_count": F.count(F.lit(1)), "pii_count": flags}
    wide = [r["table_id"] for r in heavy_keys(known if counted is None else counted.where("table_id IS NOT NULL"), ["table_id"])]
    whole = Window.partitionBy("table_id")
    place = F.row_number().over(whole.orderBy("position", "column_id")) - 1
    rows = known.where(~F.col("table_id").isin(wide)) if wide else known
    rows = rows.withColumn("_i", place.cast("bigint")).withColumns({n: c.over(whole) for n, c in counts.items()})
    if wide:
        many = known.where(F.col("table_id").isin(wide))
        total = many.groupBy("table_id").agg(*[c.alias(n) for n, c in counts.items()])
        rows = rows.unionByName(ordered_index(many, ["table_id"], ["position", "column_id"], "_i").join(F.broadcast(total), "table_id"))
    rows = rows.withColumn("page", F.floor(F.col("_i") / size).cast("bigint"))
    lists = _entries(rows, ["table_id", "page"], "_i", _column_fields(columns), "columns", list(counts))
    more = (F.col("page") + 1) * size < F.col("column_count")
    return lists.select("table_id", "page", F.when(more, F.col("page") + 1).alias("next_page"), "column_count", "pii_count", "columns")


def project_pages(
    projects: DataFrame, tables: DataFrame, columns: DataFrame, relations: DataFrame, tables_page: int = 50, columns_page: int = 200, links_page: int = 1000, counted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pages of all projects, and the columns that their tables' entries leave for further pages.

    Pages are (project_id, page, next_page, source_type, table_count, relation_count, tables, relations). An entry of ``tables`` has
    table_id, table_name, row_count, column_count, pii_count, its first ``columns_page`` columns with all their fields, and
    ``next_columns``, the page of the second result to go on with (null: none). ``counted`` are the same columns by a shorter plan, if
    there is one, to find the tables with very many of them.
    """
    known = projects.where("project_id IS NOT NULL")
    lists = _column_lists(columns, columns_page, counted)
    first = lists.where("page = 0").select("table_id", "column_count", "pii_count", "columns", F.col("next_page").alias("next_columns"))
    numbered = _paged(tables.where("project_id IS NOT NULL AND table_id IS NOT NULL").select("project_id", "table_id", "table_name", "row_count"), "project_id", ["table_id", "table_name"], tables_page, "page")
    full = numbered.join(first, "table_id", "left").na.fill(0, ["column_count", "pii_count"])
    full = full.withColumn("columns", F.coalesce("columns", F.array().cast(lists.schema["columns"].dataType)))
    table_lists = _entries(full, ["project_id", "page"], "_i", ["table_id", "table_name", "row_count", "column_count", "pii_count", "columns", "next_columns"], "tables")

    some = relations.where("project_id IS NOT NULL")
    fields = [c for c in relations.columns if c != "project_id"]
    links = _paged(some, "project_id", [f for f in LINK_FIELDS if f in fields], links_page, "page")
    link_lists = _entries(links, ["project_id", "page"], "_i", fields, "relations")

    spine = _with_counts(known, tables, some)
    last = F.greatest(F.ceil(F.col("table_count") / tables_page), F.ceil(F.col("relation_count") / links_page), F.lit(1)).cast("bigint") - 1
    spine = spine.withColumn("_last", last).withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")))
    pages = spine.join(table_lists, ["project_id", "page"], "left").join(link_lists, ["project_id", "page"], "left")
    return (
        pages.select(
            "project_id", "page", F.when(F.col("page") < F.col("_last"), F.col("page") + 1).alias("next_page"), "source_type", "table_count", "relation_count",
            *[F.coalesce(n, F.array().cast(df.schema[n].dataType)).alias(n) for n, df in (("tables", table_lists), ("relations", link_lists))],
        ),
        lists.where("page > 0").drop("pii_count"),
    )


def _with_counts(projects: DataFrame, tables: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per project with its numbers of tables and links."""
    one = projects.groupBy("project_id").agg(F.min("source_type").alias("source_type"))
    nt = tables.where("table_id IS NOT NULL").groupBy("project_id").agg(F.count(F.lit(1)).alias("table_count"))
    nr = relations.groupBy("project_id").agg(F.count(F.lit(1)).alias("relation_count"))
    return one.join(nt, "project_id", "left").join(nr, "project_id", "left").na.fill(0, ["table_count", "relation_count"])


def _first(df: DataFrame, keys: list[str], order: list[str | Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows per key, numbered from 1; every task keeps no more than ``n`` per key before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def value_samples(values: DataFrame, per_column: int = 4, width: int = 32) -> DataFrame:
    """(table_id, column_name, samples): the first values that are not null, clipped; blank ones among them are left out.

    ``values`` has table_id, column_name, row (the order) and value.
    """
    top = _first(values.where("value IS NOT NULL"), ["table_id", "column_name"], ["row", "value"], per_column, "_v")
    shown = top.withColumn("value", clip("value", width))
    ordered = F.array_sort(F.collect_list(F.struct("_v", "value")))
    return shown.groupBy("table_id", "column_name").agg(F.filter(F.transform(ordered, lambda e: e["value"]), lambda v: v.isNotNull()).alias("samples"))


def project_digests(
    projects: DataFrame, tables: DataFrame, columns: DataFrame, relations: DataFrame, values: DataFrame,
    max_tables: int = 8, max_columns: int = 20, max_links: int = 24, sampled_tables: int = 3, sampled_columns: int = 6, per_column: int = 4,
) -> DataFrame:
    """One short nested row per project: counts over everything, the first tables, columns and links, value samples of the first few.

    (project_id, source_type, table_count, relation_count, tables, relations); an entry of ``tables`` has table_id, table_name, row_count,
    column_count, pii_count (among the columns shown) and ``columns`` with all fields, long ``min`` and ``max`` clipped, and ``samples``.
    """
    shown = _first(tables.where("project_id IS NOT NULL AND table_id IS NOT NULL").select("project_id", "table_id", "table_name", "row_count"), ["project_id"], ["table_id", "table_name"], max_tables, "_t")
    shown = cut_lineage(shown)
    ids = shown.groupBy("table_id").agg(F.min("_t").alias("_t"))
    near = cut_lineage(skew_join(columns, ids.select("table_id"), ["table_id"], "left_semi"))  # few rows, read by several steps
    counts = near.groupBy("table_id").agg(F.count(F.lit(1)).alias("column_count"))
    top = _first(near, ["table_id"], ["position", "column_id"], max_columns, "_c")
    clipped = [c for c in ("min", "max", "min_val", "max_val") if c in columns.columns]
    top = top.withColumns({c: clip(c) for c in clipped}) if clipped else top
    asked = top.join(ids.where(F.col("_t") <= sampled_tables), "table_id").where(F.col("_c") <= sampled_columns).select("table_id", "column_name").distinct()
    asked = cut_lineage(asked)
    inside = skew_join(values, asked.select("table_id").distinct(), ["table_id"], "left_semi")  # before values move by column
    samples = value_samples(skew_join(inside, asked, ["table_id", "column_name"], "left_semi"), per_column)
    top = top.join(samples, ["table_id", "column_name"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    flags = F.count_if("is_pii") if "is_pii" in columns.columns else F.lit(0).cast("bigint")
    lists = _entries(top, ["table_id"], "_c", [*_column_fields(columns), "samples"], "columns")
    parts = [lists, counts, top.groupBy("table_id").agg(flags.alias("pii_count"))]
    full = reduce(lambda a, b: a.join(b, "table_id", "left"), [shown, *parts]).na.fill(0, ["column_count", "pii_count"])
    full = full.withColumn("columns", F.coalesce("columns", F.array().cast(lists.schema["columns"].dataType)))
    table_lists = _entries(full, ["project_id"], "_t", ["table_id", "table_name", "row_count", "column_count", "pii_count", "columns"], "tables")
    some = relations.where("project_id IS NOT NULL")
    fields = [c for c in relations.columns if c != "project_id"]
    link_lists = _entries(_first(some, ["project_id"], [f for f in LINK_FIELDS if f in fields], max_links, "_l"), ["project_id"], "_l", fields, "relations")
    one = _with_counts(projects.where("project_id IS NOT NULL"), tables, some)
    out = one.join(table_lists, "project_id", "left").join(link_lists, "project_id", "left")
    return out.select(
        "project_id", "source_type", "table_count", "relation_count",
        *[F.coalesce(n, F.array().cast(df.schema[n].dataType)).alias(n) for n, df in (("tables", table_lists), ("relations", link_lists))],
    )
