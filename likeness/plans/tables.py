"""Registered queries that describe the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import relate as L
from ..session import together
from .common import COLUMNS, STAR_KEYS, columns_of, load, sql_bits

NUMBERS = {"int", "bigint", "double"}


def _profile(table: str, cardinality: str = "exact"):
    def run(spark, d) -> DataFrame:
        out = P.profile(load(spark, d, table), cardinality=cardinality)
        return out.withColumn("sd", F.round("sd", 4)).withColumn("variance", F.round("variance", 2))

    return run


def _profile_sql(table: str) -> str:
    parts = []
    for pos, (c, kind) in enumerate(columns_of(table)):
        var = f"var_samp(CAST({c} AS DOUBLE))" if kind in NUMBERS else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"""SELECT {pos} AS position, '{c}' AS "column", '{kind}' AS type, count(*) - count({c}) AS nulls,
            round((count(*) - count({c})) * 100.0::DOUBLE / nullif(count(*), 0), 2) AS null_value_percent,
            CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, count(DISTINCT {c}) AS cardinality,
            round(sqrt({var}), 4) AS sd, round({var}, 2) AS variance,
            count(*) AS total_rows, count(*) AS profiled_rows, 'full' AS profile_mode FROM {table}"""
        )
    return "\nUNION ALL\n".join(parts)


def profile_sketch(spark, d):
    """Sketch cardinalities next to exact ones: whether each lies within the sketch's error bound."""
    parts = []
    for t in ("lineitem", "orders"):
        df = load(spark, d, t)
        exact = F.create_map(*[x for c, n in df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict().items() for x in (F.lit(c), F.lit(n))])[F.col("column")]
        near = F.abs(F.col("cardinality") - exact) <= 0.1 * exact + 1
        parts.append(P.profile(df).select(F.lit(t).alias("table"), "column", "nulls", "profiled_rows", near.alias("cardinality_near")))
    return reduce(DataFrame.unionByName, parts)


SKETCH_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS profiled_rows, count(DISTINCT {c}) > 0 OR count({c}) = 0 AS cardinality_near FROM {t}"
    for t in ("lineitem", "orders") for c, _ in columns_of(t)
)


def profile_nested(spark, d):
    """A table with an array column: the array is left out."""
    out = P.profile(load(spark, d, "embeddings"), cardinality="exact")
    return out.withColumn("sd", F.round("sd", 4)).withColumn("variance", F.round("variance", 2))


def row_counts(spark, d):
    parts = [P.row_counts(load(spark, d, t)).withColumn("table", F.lit(t)) for t in COLUMNS]
    return reduce(DataFrame.unionByName, parts)


def _pearson(table: str, top_k, method="auto"):
    def run(spark, d):
        return L.pearson(load(spark, d, table), top_k=top_k, method=method).withColumn("corr", F.round("corr", 6))

    return run


def _pearson_sql(table: str, top_k: int | None) -> str:
    cols = [c for c, k in columns_of(table) if k in NUMBERS]
    parts = [
        f"SELECT {i} AS i, {j} AS j, '{a}' AS col_a, '{b}' AS col_b, coalesce(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 0.0) AS c FROM {table}"
        for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j
    ]
    limit = f"ORDER BY round(abs(c), 12) DESC, i, j LIMIT {top_k}" if top_k else ""
    return f"SELECT col_a, col_b, round(c, 6) AS corr FROM ({' UNION ALL '.join(parts)}) {limit}"


def _with_gaps(spark, d):
    """Lineitem numbers with nulls on one side, a constant column and their pairwise correlations."""
    li = load(spark, d, "lineitem")
    t = li.select(
        F.when(F.col("l_discount") < 0.08, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).alias("price"),
        "l_discount", F.lit(3.0).alias("fixed"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey"),
    )
    return L.pearson(t, top_k=None).withColumn("corr", F.round("corr", 6))


def _with_gaps_sql() -> str:
    cols = ["quantity", "price", "l_discount", "fixed", "l_suppkey", "l_linenumber", "l_partkey"]
    parts = [
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {'0.0' if 'fixed' in (a, b) else f'round(coalesce(corr({a}, {b}), 0.0), 6)'} AS corr FROM t"
        for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j
    ]
    return f"""WITH t AS (SELECT CASE WHEN l_discount < 0.08 THEN l_quantity END AS quantity,
      CASE WHEN l_tax > 0.01 THEN l_extendedprice END AS price, l_discount, 3.0::DOUBLE AS fixed,
      l_suppkey::DOUBLE AS l_suppkey, l_linenumber::DOUBLE AS l_linenumber, l_partkey::DOUBLE AS l_partkey FROM lineitem)
    SELECT col_a, col_b, max(corr) AS corr FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"""


def _cramers(table: str):
    def run(spark, d):
        return L.cramers_v(load(spark, d, table), max_unique=50, top_k=30).withColumn("score", F.round("score", 6))

    return run


def _cramers_sql(table: str) -> str:
    cols = [c for c, k in columns_of(table) if k not in NUMBERS]
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                parts.append(
                    f"""SELECT {i} AS i, {j} AS j, '{a}' AS col_a, '{b}' AS col_b,
                    CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*)::DOUBLE AS o FROM {table}, sizes
                    WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND d{i} BETWEEN 2 AND 50 AND d{j} BETWEEN 2 AND 50 GROUP BY ALL"""
                )
    sizes = ", ".join(f"count(DISTINCT {c}) AS d{i}" for i, c in enumerate(cols))
    return f"""WITH sizes AS (SELECT {sizes} FROM {table}), cells AS ({' UNION ALL '.join(parts)}),
    m AS (SELECT *, sum(o) OVER (PARTITION BY i, j, a) AS r, sum(o) OVER (PARTITION BY i, j, b) AS c,
          sum(o) OVER (PARTITION BY i, j) AS n FROM cells),
    s AS (SELECT i, j, col_a, col_b, sum(o * o / (r * c)) AS s, count(DISTINCT a) AS ra, count(DISTINCT b) AS cb FROM m GROUP BY ALL)
    SELECT col_a, col_b, round(sqrt(greatest(s - 1, 0) / (least(ra, cb) - 1)), 6) AS score, 'Cramer''s V' AS metric
    FROM s WHERE least(ra, cb) > 1 ORDER BY score DESC, i, j LIMIT 30"""


SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?-("  # one column each


def cramers_wide(spark, d):
    """Association of seventy columns: how often each of seventy signs stands in a whole text, in classes."""
    text = F.col("text")
    often = [(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) % (3 + i % 5) for i, c in enumerate(SIGNS)]
    wide = load(spark, d, "documents", "doc_id").select(*[F.concat(F.lit("k"), n).alias(f"w{i}") for i, n in enumerate(often)])
    return L.cramers_v(wide).withColumn("score", F.round("score", 6))


_OFTEN = ", ".join(f"(length(text) - length(replace(text, '{c}', ''))) % {3 + i % 5}" for i, c in enumerate(SIGNS))
WIDE_SQL = f"""WITH w AS (SELECT doc_id, [{_OFTEN}] AS s FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, unnest(range({len(SIGNS)})) AS i, unnest(s) AS x FROM w),
cells AS (SELECT a.i, b.i AS j, a.x AS a, b.x AS b, count(*)::DOUBLE AS o FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.i < b.i GROUP BY ALL),
m AS (SELECT *, sum(o) OVER (PARTITION BY i, j, a) AS r, sum(o) OVER (PARTITION BY i, j, b) AS c FROM cells),
s AS (SELECT i, j, sum(o * o / (r * c)) AS s, count(DISTINCT a) AS ra, count(DISTINCT b) AS cb FROM m GROUP BY ALL)
SELECT 'w' || i AS col_a, 'w' || j AS col_b, round(sqrt(greatest(s - 1, 0) / (least(ra, cb) - 1)), 6) AS score, 'Cramer''s V' AS metric FROM s WHERE least(ra, cb) > 1"""


def contingency(spark, d):
    cols = ["l_returnflag", "l_linestatus", "l_linenumber"]
    out = L.contingency(load(spark, d, "lineitem"), cols)
    names = F.array(*[F.lit(c) for c in cols])
    return out.select(F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b"), "a", "b", "o")


CONTINGENCY_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM lineitem GROUP BY ALL"
    for a, b in [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber")]
)


def value_counts(spark, d):
    return P.value_counts(load(spark, d, "part"), [c for c, _ in columns_of("part")])


def _counts_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY ALL"
        for i, (c, _) in enumerate(columns_of(table))
    )


VALUE_COUNTS_SQL = f"""SELECT "column", value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
FROM ({_counts_sql('part')})) WHERE rank <= 6"""

_KIND_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS data_type" for c, k in columns_of("customer"))
EVIDENCE_SQL = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM ({_counts_sql('customer')}))
SELECT "column", any_value(data_type) AS data_type, count(*) AS cardinality,
string_agg(value, '|' ORDER BY rank) FILTER (WHERE rank <= 6) AS sample_values
FROM r JOIN ({_KIND_SQL}) k USING ("column") GROUP BY "column" """


def column_evidence(spark, d):
    return P.column_evidence(load(spark, d, "customer"))


def value_sample(spark, d):
    return P.value_sample(load(spark, d, "orders"), ["o_orderstatus", "o_totalprice", "o_orderpriority"], ["o_orderkey"], 50)


VALUE_SAMPLE_SQL = f"""WITH v AS (
{' UNION ALL '.join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, o_orderkey FROM orders WHERE {c} IS NOT NULL" for c in ('o_orderstatus', 'o_totalprice', 'o_orderpriority'))}),
r AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY {sql_bits(42, 'value_sample', ['col', 'o_orderkey'])}, o_orderkey) AS rank FROM v)
SELECT col AS "column", rank, value FROM r WHERE rank <= 50"""


def pk_candidates(spark, d):
    found = together(*[lambda t=t: P.key_candidates(load(spark, d, t)) for t in COLUMNS])
    parts = [df.withColumn("table", F.lit(t)) for t, df in zip(COLUMNS, found)]
    return reduce(DataFrame.unionByName, parts)


def _pk_sql() -> str:
    parts = [
        f"SELECT '{t}' AS \"table\", {i} AS pos, '{c}' AS \"column\", count(DISTINCT {c}) AS cardinality, count(*) AS n FROM {t}"
        for t in COLUMNS for i, (c, _) in enumerate(columns_of(t))
    ]
    return f"""SELECT "table", "column", cardinality, regexp_matches(lower("column"), '(id|key)$') AS id_like,
    row_number() OVER (PARTITION BY "table" ORDER BY CASE WHEN regexp_matches(lower("column"), '(id|key)$') THEN 0 ELSE 1 END, pos) AS rank
    FROM ({' UNION ALL '.join(parts)}) WHERE cardinality = n AND n > 0"""


def fk_overlap(spark, d):
    names = {n for edge in STAR_KEYS for n in (edge[0], edge[2])}
    out = L.fk_overlaps({n: load(spark, d, n) for n in names}, STAR_KEYS)
    return out.withColumn("overlap", F.round("overlap", 6))


def _overlap_sql() -> str:
    parts = [
        f"""SELECT '{ct}' AS from_table, '{cc}' AS from_column, '{pt}' AS to_table, '{pc}' AS to_column,
        (SELECT count(DISTINCT {cc}) FROM {ct}) AS child_keys, (SELECT count(DISTINCT {pc}) FROM {pt}) AS parent_keys,
        (SELECT count(DISTINCT {cc}) FROM {ct} WHERE {cc} IN (SELECT {pc} FROM {pt})) AS shared_keys"""
        for ct, cc, pt, pc in STAR_KEYS
    ]
    return f"""SELECT *, round(coalesce(shared_keys / nullif(child_keys, 0), 0), 6) AS overlap,
    child_keys > 0 AND parent_keys > 0 AND shared_keys = 0 AS disjoint FROM ({' UNION ALL '.join(parts)})"""


def _clean_input(spark, d):
    """Line items with some null order keys, against finished orders only."""
    li = load(spark, d, "lineitem").withColumn("l_orderkey", F.when(F.col("l_discount") > 0.005, F.col("l_orderkey")))
    return li, load(spark, d, "orders").where("o_orderstatus = 'F'")


def ref_clean(spark, d):
    li, orders = _clean_input(spark, d)
    return L.drop_orphans(li, "l_orderkey", orders, "o_orderkey").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_orderkey").alias("with_key"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


REF_CLEAN_SQL = """WITH t AS (SELECT CASE WHEN l_discount > 0.005 THEN l_orderkey END AS k, l_returnflag, l_quantity FROM lineitem)
SELECT l_returnflag, count(*) AS n, count(k) AS with_key, round(sum(l_quantity), 2) AS quantity FROM t
WHERE k IS NULL OR k IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_returnflag"""

PROFILED = ["orders", "lineitem", "customer", "part", "events", "documents", "conversations"]

QUERIES = {
    **{f"profile_{t}": _profile(t) for t in PROFILED},
    "profile_nested": profile_nested,
    "profile_sketch": profile_sketch,
    "row_counts": row_counts,
    "pearson_lineitem": _pearson("lineitem", None),
    "pearson_topk_orders": _pearson("orders", 2),
    "pearson_gaps": _with_gaps,
    "cramers_orders": _cramers("orders"),
    "cramers_part": _cramers("part"),
    "cramers_wide": cramers_wide,
    "contingency_lineitem": contingency,
    "value_counts_top6": value_counts,
    "column_evidence": column_evidence,
    "value_sample": value_sample,
    "pk_candidates": pk_candidates,
    "fk_overlap": fk_overlap,
    "ref_clean": ref_clean,
}

ORACLES = {
    "profile_sketch": SKETCH_SQL,
    **{f"profile_{t}": _profile_sql(t) for t in PROFILED},
    "profile_nested": """SELECT 0 AS position, 'vec_id' AS "column", 'bigint' AS type, count(*) - count(vec_id) AS nulls,
        round((count(*) - count(vec_id)) * 100.0::DOUBLE / count(*), 2) AS null_value_percent, CAST(min(vec_id) AS VARCHAR) AS min,
        CAST(max(vec_id) AS VARCHAR) AS max, count(DISTINCT vec_id) AS cardinality, round(stddev_samp(vec_id), 4) AS sd,
        round(var_samp(vec_id), 2) AS variance, count(*) AS total_rows, count(*) AS profiled_rows, 'full' AS profile_mode FROM embeddings
        UNION ALL SELECT 1, 'label', 'int', count(*) - count(label), round((count(*) - count(label)) * 100.0::DOUBLE / count(*), 2),
        CAST(min(label) AS VARCHAR), CAST(max(label) AS VARCHAR), count(DISTINCT label), round(stddev_samp(label), 4),
        round(var_samp(label), 2), count(*), count(*), 'full' FROM embeddings""",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS total_rows, count(*) AS profiled_rows FROM {t}" for t in COLUMNS),
    "pearson_lineitem": _pearson_sql("lineitem", None),
    "pearson_topk_orders": _pearson_sql("orders", 2),
    "pearson_gaps": _with_gaps_sql(),
    "cramers_orders": _cramers_sql("orders"),
    "cramers_part": _cramers_sql("part"),
    "cramers_wide": WIDE_SQL,
    "contingency_lineitem": CONTINGENCY_SQL,
    "value_counts_top6": VALUE_COUNTS_SQL,
    "column_evidence": EVIDENCE_SQL,
    "value_sample": VALUE_SAMPLE_SQL,
    "pk_candidates": _pk_sql(),
    "fk_overlap": _overlap_sql(),
    "ref_clean": REF_CLEAN_SQL,
}
