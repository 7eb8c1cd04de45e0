"""Registered queries on keys that the data shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import keys as K
from .common import COLUMNS, columns_of, load

_KINDS = {"int": "whole", "bigint": "whole", "string": "text", "timestamp_ntz": "time"}
#: The scalar columns of the tables that ``COLUMNS`` leaves out.
_OTHERS = {"embeddings": "vec_id:bigint label:int", "pages": "page_id:bigint url:string html:string"}
MIN_OVERLAP = 0.95


def fk_by_data(spark, d):
    """Columns of all given tables whose values lie in a key of another table, with exact overlaps."""
    tables = {t: load(spark, d, t) for t in [*COLUMNS, *_OTHERS]}
    return K.discover_links(tables, MIN_OVERLAP).withColumns({c: F.round(c, 6) for c in ("overlap", "coverage")})


def _columns(table: str) -> list[tuple[str, str]]:
    every = columns_of(table) if table in COLUMNS else [tuple(c.split(":")) for c in _OTHERS[table].split()]
    return [(c, _KINDS[k]) for c, k in every if k in _KINDS]


def _links_sql(tables: dict[str, list[tuple[str, str]]], source: dict[str, str]) -> str:
    """CTEs ``good``: (from_table, from_column, to_table, to_column, child_keys, parent_keys, shared_keys), by joining all distinct values."""
    values = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, '{k}' AS k, CAST({c} AS VARCHAR) AS v FROM {source[t]} WHERE {c} IS NOT NULL GROUP BY {c}" for t, cols in tables.items() for c, k in cols
    )
    rows = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {source[t]}" for t in tables)
    return f"""vals AS MATERIALIZED ({values}), rowsof AS ({rows}), sizes AS (SELECT t, c, k, count(*) AS keys FROM vals GROUP BY ALL),
pkeys AS (SELECT s.t, s.c, s.k, s.keys FROM sizes s JOIN rowsof r ON s.t = r.t AND s.keys = r.n),
pairs AS (SELECT a.t AS from_table, a.c AS from_column, p.t AS to_table, p.c AS to_column, count(*) AS shared_keys
  FROM vals a JOIN vals b ON a.k = b.k AND a.v = b.v AND a.t <> b.t JOIN pkeys p ON p.t = b.t AND p.c = b.c GROUP BY ALL),
good AS (SELECT p.*, a.keys AS child_keys, b.keys AS parent_keys FROM pairs p JOIN sizes a ON a.t = from_table AND a.c = from_column JOIN sizes b ON b.t = to_table AND b.c = to_column
  WHERE shared_keys >= {MIN_OVERLAP} * a.keys)"""


_ALL = [*COLUMNS, *_OTHERS]
BY_DATA_SQL = f"""WITH {_links_sql({t: _columns(t) for t in _ALL}, {t: t for t in _ALL})}
SELECT from_table, from_column, to_table, to_column, child_keys, parent_keys, shared_keys, round(shared_keys / child_keys, 6) AS overlap, round(shared_keys / parent_keys, 6) AS coverage,
row_number() OVER (PARTITION BY from_table, from_column ORDER BY shared_keys / parent_keys DESC, to_table, to_column) = 1 AS best FROM good"""

# --- names and data together --------------------------------------------------------------

_SHOP = {
    "customers": ("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer", [("id", "whole"), ("name", "text"), ("nation", "whole")]),
    "orders": ("SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderpriority AS priority FROM orders", [("id", "whole"), ("customer_id", "whole"), ("priority", "text")]),
    "parts": ("SELECT p_partkey AS id, p_name AS label FROM part", [("id", "whole"), ("label", "text")]),
    "suppliers": ("SELECT CAST(s_suppkey AS STRING) AS id, s_name AS name FROM supplier", [("id", "text"), ("name", "text")]),
    "lines": (
        "SELECT l_orderkey AS order_id, CASE WHEN l_quantity > 5 THEN l_partkey ELSE -l_partkey END AS part_id, -1 - l_suppkey AS customer_id, l_suppkey AS supplier_id, CAST(l_suppkey AS STRING) AS vendor FROM lineitem",
        [("order_id", "whole"), ("part_id", "whole"), ("customer_id", "whole"), ("supplier_id", "whole"), ("vendor", "text")],
    ),
}
_GUESSED = [("orders", "customer_id", "customers", "id"), ("lines", "order_id", "orders", "id"), ("lines", "part_id", "parts", "id"), ("lines", "customer_id", "customers", "id"), ("lines", "supplier_id", "suppliers", "id")]


def fk_evidence(spark, d):
    """Links guessed from names in a shop's tables, held against the data, and links that only the data shows."""
    names = ["customer", "orders", "part", "supplier", "lineitem"]
    given = {n: load(spark, d, n) for n in names}
    tables = {}
    for t, (sql, _) in _SHOP.items():
        source = sql.rsplit(" ", 1)[1]
        tables[t] = spark.sql(sql.removesuffix(source) + "{src}", src=given[source])
    columns = spark.createDataFrame([(t, i, c, "INTEGER", False, c == "id") for t, (_, cols) in _SHOP.items() for i, (c, _) in enumerate(cols)], "table_name string, position int, column_name string, data_type string, is_nullable boolean, is_pk boolean")
    out = C.infer_links(columns, tables=tables)
    return out.withColumns({c: F.round(c, 6) for c in ("overlap", "coverage")})


_SHOP_COLS = {t: cols for t, (_, cols) in _SHOP.items()}
EVIDENCE_SQL = f"""WITH {', '.join(f's_{t} AS ({sql})' for t, (sql, _) in _SHOP.items())}, {_links_sql(_SHOP_COLS, {t: f's_{t}' for t in _SHOP})},
g(from_table, from_column, to_table, to_column) AS (VALUES {', '.join(str(x) for x in _GUESSED)}),
named AS (SELECT g.*, a.keys AS child_keys, b.keys AS parent_keys, (SELECT count(*) FROM vals x JOIN vals y USING (v) WHERE x.t = g.from_table AND x.c = g.from_column AND y.t = g.to_table AND y.c = g.to_column) AS shared_keys
  FROM g JOIN sizes a ON a.t = from_table AND a.c = from_column JOIN sizes b ON b.t = to_table AND b.c = to_column WHERE a.k = b.k),
ranked AS (SELECT from_table, from_column, to_table, to_column, child_keys, parent_keys, shared_keys, row_number() OVER (PARTITION BY from_table, from_column ORDER BY shared_keys / parent_keys DESC, to_table, to_column) AS r FROM good),
every AS (SELECT *, true AS by_name FROM named WHERE shared_keys > 0 UNION ALL SELECT * EXCLUDE (r), false FROM ranked WHERE r = 1 AND (from_table, from_column, to_table, to_column) NOT IN (SELECT (from_table, from_column, to_table, to_column) FROM g)),
o AS (SELECT *, shared_keys / child_keys AS overlap, shared_keys / parent_keys AS coverage FROM every)
SELECT from_table, from_column, to_table, to_column, child_keys, parent_keys, shared_keys, round(overlap, 6) AS overlap, round(coverage, 6) AS coverage,
CASE WHEN NOT by_name THEN 'data' WHEN overlap >= {MIN_OVERLAP} THEN 'both' ELSE 'name' END AS source,
round(CASE WHEN by_name THEN 0.62 + 0.33 * overlap ELSE 0.5 * overlap * (1 + 0.6 * coverage) END, 6) AS confidence, NOT by_name AS is_optional, '1:N' AS cardinality FROM o""".replace("AS STRING", "AS VARCHAR")

QUERIES = {"fk_by_data": fk_by_data, "fk_evidence": fk_evidence}
ORACLES = {"fk_by_data": BY_DATA_SQL, "fk_evidence": EVIDENCE_SQL}
