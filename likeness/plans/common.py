"""Shared pieces of the registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.bundle import spread

STAR_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]

COLUMNS = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double"
    " l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "benchmark": "item_id:bigint text:string",
    "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[table].split()]


def load(spark: SparkSession, sf_dir: str, table: str, *spread_by: str) -> DataFrame:
    """A given table; with ``spread_by`` columns a small file is dealt over all cores for work that is heavy per row."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df, *spread_by) if spread_by else df


# --- the random columns in DuckDB SQL ------------------------------------------------


def _md5(seed, stream: str, ids) -> str:
    ids = ids if isinstance(ids, (list, tuple)) else [ids]
    parts = ", ".join(f"CAST({i} AS VARCHAR)" for i in ids)
    return f"md5(concat_ws('|', '{seed}', '{stream}', {parts}))"


def sql_bits(seed, stream: str, ids, start: int = 1) -> str:
    return f"CAST('0x' || substr({_md5(seed, stream, ids)}, {start}, 13) AS BIGINT)"


def sql_u(seed, stream: str, ids) -> str:
    return f"({sql_bits(seed, stream, ids)} / 4503599627370496.0::DOUBLE)"


def sql_below(seed, stream: str, ids, n) -> str:
    return f"CAST(floor({sql_u(seed, stream, ids)} * {n}) AS BIGINT)"


def sql_normal(seed, stream: str, ids) -> str:
    a = f"(({sql_bits(seed, stream, ids)} + 1) / 4503599627370497.0::DOUBLE)"
    b = f"({sql_bits(seed, stream, ids, 14)} / 4503599627370496.0::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({a})) * cos(2.0::DOUBLE * pi() * {b}))"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values, index: str) -> str:
    return f"{sql_list(values)}[CAST({index} AS BIGINT) + 1]"


def sql_weighted(entries, draw: str) -> str:
    total, out = 0.0, []
    live = [i for i, (_, w) in enumerate(entries) if w > 0]
    last = live[-1] if live else len(entries) - 1
    for v, w in entries[:last]:
        total += w
        out.append(f"WHEN {draw} < {total!r}::DOUBLE THEN '{v}'")
    end = entries[last][0]
    return f"CASE {' '.join(out)} ELSE '{end}' END" if out else f"'{end}'"
