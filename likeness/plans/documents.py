"""Registered queries on nested project documents and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import documents as N
from ..session import session_with
from .columns import STAR_SQL, _star_catalog, words

TABLES_PAGE, COLUMNS_PAGE, LINKS_PAGE = 25, 40, 60


def _by_table(spark):
    """A session that joins rows lying by table_id where they are, also by table_id and column; else it would shuffle all words again."""
    return session_with(spark, spark__sql__requireAllClusterKeysForCoPartition="false")


def _catalog(spark, d) -> dict[str, DataFrame]:
    """The star catalog; columns carry their profile, and those with long names count as personal."""
    c = _star_catalog(spark, d, dealt=True)
    columns = C.columns_with_stats(c["columns"], c["column_profiles"]).withColumn("is_pii", F.length("column_name") > 6)
    return {**c, "columns": columns, "counted": c["columns"]}


_FULL_SQL = f"""{STAR_SQL}, col AS (SELECT c.*, p.cardinality, length(column_name) > 6 AS is_pii, row_number() OVER (PARTITION BY table_id ORDER BY position, column_id) - 1 AS k,
 count(*) OVER (PARTITION BY table_id) AS n_all, count_if(length(column_name) > 6) OVER (PARTITION BY table_id) AS n_pii FROM columns c LEFT JOIN profiles p USING (column_id)),
tab AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY table_id, table_name) - 1 AS j FROM tables WHERE project_id IS NOT NULL),
rel AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY from_table, to_table) - 1 AS l FROM relations WHERE project_id IS NOT NULL),
pro AS (SELECT project_id, count(*) AS table_count, (SELECT count(*) FROM relations r WHERE r.project_id = t.project_id) AS relation_count FROM tables t WHERE project_id IS NOT NULL GROUP BY 1)"""
_COLUMN_SQL = "column_name || ':' || coalesce(CAST(cardinality AS VARCHAR), '')"


def _column_text(c: Column) -> Column:
    return F.concat(c["column_name"], F.lit(":"), F.coalesce(c["cardinality"].cast("string"), F.lit("")))


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def _digest(items: str, text) -> Column:
    """MD5 of a list as text; null for an empty list."""
    return F.when(F.size(items) > 0, F.md5(F.array_join(F.transform(items, text), ";")))


def _links(r: Column) -> Column:
    return F.concat(r["from_table"], F.lit(">"), r["to_table"])


def project_pages(spark, d):
    """Project, tables, columns with statistics and links as pages, read back through every level of nesting."""
    spark = _by_table(spark)
    c = _catalog(spark, d)
    pages, _ = N.project_pages(c["projects"], c["tables"], c["columns"], c["relations"], TABLES_PAGE, COLUMNS_PAGE, LINKS_PAGE, c["counted"])

    def text(t: Column) -> Column:
        inner = F.array_join(F.transform(t["columns"], _column_text), ",")
        return F.concat_ws("|", _number(t["table_id"]), t["table_name"], _number(t["row_count"]), _number(t["column_count"]), _number(t["pii_count"]), _number(t["next_columns"]), inner)

    return pages.select("project_id", "page", "next_page", "source_type", "table_count", "relation_count", _digest("tables", text).alias("tables"), _digest("relations", _links).alias("relations"))


PAGES_SQL = f"""WITH {_FULL_SQL}, head AS (SELECT table_id, max(n_all) AS n_all, max(n_pii) AS n_pii, string_agg({_COLUMN_SQL}, ',' ORDER BY k) FILTER (WHERE k < {COLUMNS_PAGE}) AS txt FROM col GROUP BY 1),
tp AS (SELECT project_id, j // {TABLES_PAGE} AS page, md5(string_agg(concat_ws('|', CAST(table_id AS VARCHAR), table_name, coalesce(CAST(row_count AS VARCHAR), '-'), CAST(coalesce(n_all, 0) AS VARCHAR),
 CAST(coalesce(n_pii, 0) AS VARCHAR), CASE WHEN n_all > {COLUMNS_PAGE} THEN '1' ELSE '-' END, coalesce(txt, '')), ';' ORDER BY j)) AS tables FROM tab LEFT JOIN head USING (table_id) GROUP BY ALL),
rp AS (SELECT project_id, l // {LINKS_PAGE} AS page, md5(string_agg(from_table || '>' || to_table, ';' ORDER BY l)) AS relations FROM rel GROUP BY ALL),
sp AS (SELECT *, greatest((table_count + {TABLES_PAGE - 1}) // {TABLES_PAGE}, (relation_count + {LINKS_PAGE - 1}) // {LINKS_PAGE}) - 1 AS last FROM pro), pg AS (SELECT *, unnest(range(0, last + 1)) AS page FROM sp)
SELECT project_id, page, CASE WHEN page < last THEN page + 1 END AS next_page, 'CSV' AS source_type, table_count, relation_count, tables, relations
FROM pg LEFT JOIN tp USING (project_id, page) LEFT JOIN rp USING (project_id, page)"""


def project_more_columns(spark, d):
    """The pages of columns beyond the first of every table."""
    spark = _by_table(spark)
    c = _catalog(spark, d)
    _, more = N.project_pages(c["projects"], c["tables"], c["columns"], c["relations"], TABLES_PAGE, COLUMNS_PAGE, LINKS_PAGE, c["counted"])
    return more.select("table_id", "page", "next_page", "column_count", F.size("columns").cast("bigint").alias("n"), _digest("columns", _column_text).alias("columns"))


MORE_SQL = f"""WITH {_FULL_SQL} SELECT table_id, k // {COLUMNS_PAGE} AS page, CASE WHEN (k // {COLUMNS_PAGE} + 1) * {COLUMNS_PAGE} < max(n_all) THEN k // {COLUMNS_PAGE} + 1 END AS next_page, max(n_all) AS column_count, count(*) AS n,
md5(string_agg({_COLUMN_SQL}, ';' ORDER BY k)) AS columns FROM col WHERE k >= {COLUMNS_PAGE} GROUP BY table_id, k // {COLUMNS_PAGE}"""


def project_digest(spark, d):
    """A short digest per project; the values of a column are the places of its word."""
    spark = _by_table(spark)
    c = _catalog(spark, d)
    values = words(spark, d, dealt=True).select(F.col("doc_id").alias("table_id"), F.col("word").alias("column_name"), F.col("position").alias("row"), F.concat(F.lit(" at "), "position").alias("value"))
    out = N.project_digests(c["projects"], c["tables"], c["columns"], c["relations"], values)

    def text(t: Column) -> Column:
        inner = F.array_join(F.transform(t["columns"], lambda x: F.concat(_column_text(x), F.lit("="), F.array_join(x["samples"], "/"))), ",")
        return F.concat_ws("|", t["table_name"], _number(t["row_count"]), _number(t["column_count"]), _number(t["pii_count"]), inner)

    return out.select("project_id", "source_type", "table_count", "relation_count", _digest("tables", text).alias("tables"), _digest("relations", _links).alias("relations"))


PROJECT_DIGEST_SQL = f"""WITH {_FULL_SQL}, val AS (SELECT doc_id AS table_id, word AS column_name, position, row_number() OVER (PARTITION BY doc_id, word ORDER BY position) AS v FROM words),
smp AS (SELECT table_id, column_name, string_agg('at ' || position, '/' ORDER BY v) AS txt FROM val WHERE v <= 4 GROUP BY ALL),
few AS (SELECT t.project_id, t.j, t.table_name, t.row_count, max(n_all) AS n_all, count_if(is_pii AND k < 20) AS n_pii,
 string_agg({_COLUMN_SQL} || '=' || CASE WHEN t.j < 3 AND k < 6 THEN s.txt ELSE '' END, ',' ORDER BY k) FILTER (WHERE k < 20) AS txt
 FROM tab t LEFT JOIN col c USING (table_id) LEFT JOIN smp s USING (table_id, column_name) WHERE t.j < 8 GROUP BY ALL),
tp AS (SELECT project_id, md5(string_agg(concat_ws('|', table_name, coalesce(CAST(row_count AS VARCHAR), '-'), CAST(coalesce(n_all, 0) AS VARCHAR), CAST(n_pii AS VARCHAR), coalesce(txt, '')), ';' ORDER BY j)) AS tables FROM few GROUP BY 1),
rp AS (SELECT project_id, md5(string_agg(from_table || '>' || to_table, ';' ORDER BY l)) AS relations FROM rel WHERE l < 24 GROUP BY 1)
SELECT project_id, 'CSV' AS source_type, table_count, relation_count, tables, relations FROM pro LEFT JOIN tp USING (project_id) LEFT JOIN rp USING (project_id)"""

QUERIES = {"project_pages": project_pages, "project_more_columns": project_more_columns, "project_digest": project_digest}
ORACLES = {"project_pages": PAGES_SQL, "project_more_columns": MORE_SQL, "project_digest": PROJECT_DIGEST_SQL}
