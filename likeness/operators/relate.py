"""Correlation, association and key overlap between columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote
from .joins import skew_join
from .keys import key_kind, shared_keys, with_overlap
from .profile import approx_distinct_counts, distinct_counts, numeric_columns, scalar_columns

CONSTANT = 1e-28  # variance / mean^2 up to which a column is constant: below the resolution of a double
EXPRESSION_LIMIT = 6  # columns; beyond it co-moment matrices per Arrow batch are faster


def _c(name: str) -> Column:
    return F.col(quote(name))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation on complete pairs; 0 where a side is constant or nothing is left."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    vx, vy = F.var_pop(x), F.var_pop(y)
    # merged partial variances of a constant can leave rounding noise
    spread = F.when((vx > F.lit(CONSTANT) * F.avg(x) * F.avg(x)) & (vy > F.lit(CONSTANT) * F.avg(y) * F.avg(y)), F.sqrt(vx) * F.sqrt(vy))
    r = F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
    return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))


def pearson(df: DataFrame, columns: list[str] | None = None, top_k: int | None = None, method: str = "auto") -> DataFrame:
    """Upper triangle of the correlation matrix, strongest first: (col_a, col_b, corr); ``top_k`` leaves out weaker pairs."""
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    if method == "auto":
        method = "expression" if len(columns) <= EXPRESSION_LIMIT else "matrix"
    pairs = _pearson_expression(df, columns) if method == "expression" else _pearson_matrix(df, columns)
    names = F.array(*[F.lit(c) for c in columns])
    out = pairs.select(
        F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b"), "corr", "i", "j"
    )
    if top_k:
        out = out.orderBy(F.desc(F.round(F.abs("corr"), 12)), "i", "j").limit(int(top_k))
    return out.drop("i", "j")


def _pearson_expression(df: DataFrame, columns: list[str]) -> DataFrame:
    d = {c: _c(c).cast("double") for c in columns}
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]

    def batch(some: list[tuple[int, int]]) -> DataFrame:
        row = df.agg(*[safe_corr(d[columns[i]], d[columns[j]]).alias(f"r{i}_{j}") for i, j in some])
        cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{i}_{j}").alias("corr")) for i, j in some]
        return row.select(F.inline(F.array(*cells)))

    # few pairs per aggregation: larger generated methods would run interpreted
    return reduce(DataFrame.unionByName, [batch(pairs[k : k + 3]) for k in range(0, len(pairs), 3)])


_PARTIAL = "i int, j int, n double, mx double, my double, cxx double, cyy double, cxy double"


def _co_moments(batches):
    """Pairwise-complete co-moments of one partition, one row per column pair."""
    shift, acc = None, None
    for pdf in batches:
        x = pdf.to_numpy(dtype="float64", na_value=np.nan)
        if not len(x):
            continue
        mask = ~np.isnan(x)
        if shift is None:
            shift = np.where(mask.any(axis=0), np.nansum(x, axis=0) / np.maximum(mask.sum(axis=0), 1), 0.0)
            shift[~np.isfinite(shift)] = 0.0
        m = mask.astype("float64")
        x = np.where(mask, x - shift, 0.0)
        step = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        acc = step if acc is None else acc + step
    if acc is None:
        return
    n, s, q, p = acc
    k = len(shift)
    i, j = np.triu_indices(k, 1)
    cnt = n[i, j]
    safe = np.maximum(cnt, 1.0)
    sx, sy = s[i, j], s[j, i]
    yield pd.DataFrame(
        {
            "i": i, "j": j, "n": cnt,
            "mx": np.where(cnt > 0, sx / safe + shift[i], 0.0),
            "my": np.where(cnt > 0, sy / safe + shift[j], 0.0),
            "cxx": q[i, j] - sx * sx / safe,
            "cyy": q[j, i] - sy * sy / safe,
            "cxy": p[i, j] - sx * sy / safe,
        }
    )


def merge_co_moments(parts: DataFrame) -> DataFrame:
    """Add the per-partition co-moments up: (i, j, n, mx, my, cxx, cyy, cxy)."""
    # deviations from a common point (any partition's mean) keep the between-partition part exact
    ref = parts.where("n > 0").groupBy("i", "j").agg(F.min("mx").alias("ax"), F.min("my").alias("ay"))
    d = parts.join(F.broadcast(ref), ["i", "j"]).withColumn("dx", F.col("mx") - F.col("ax")).withColumn("dy", F.col("my") - F.col("ay"))
    g = d.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.first("ax").alias("ax"), F.first("ay").alias("ay"),
        F.sum(F.expr("n*dx")).alias("sx"), F.sum(F.expr("n*dy")).alias("sy"),
        F.sum(F.expr("cxx + n*dx*dx")).alias("xx"), F.sum(F.expr("cyy + n*dy*dy")).alias("yy"), F.sum(F.expr("cxy + n*dx*dy")).alias("xy"),
    )
    return g.selectExpr(
        "i", "j", "n", "ax + sx/n AS mx", "ay + sy/n AS my", "xx - sx*sx/n AS cxx", "yy - sy*sy/n AS cyy", "xy - sx*sy/n AS cxy"
    )


def _pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = df.select(*[_c(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).mapInPandas(_co_moments, _PARTIAL)
    g = merge_co_moments(parts)
    # a constant column leaves only rounding noise in cxx
    noise = F.expr(f"cxx <= {CONSTANT}D * n * mx*mx OR cyy <= {CONSTANT}D * n * my*my")
    r = F.when(noise, F.lit(0.0)).otherwise(F.col("cxy") / F.nullif(F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy")), F.lit(0.0)))
    found = g.select("i", "j", F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("corr"))
    k = len(columns)
    every = df.sparkSession.createDataFrame([(i, j) for i in range(k) for j in range(i + 1, k)], "i int, j int")
    return every.join(F.broadcast(found), ["i", "j"], "left").withColumn("corr", F.coalesce("corr", F.lit(0.0)))


# --- categorical association ---------------------------------------------------------


def small_columns(df: DataFrame, columns: list[str], limit: int | None = None) -> list[str]:
    """Columns with 2..limit distinct values: a sketch drops the large ones, the rest is counted exactly."""
    if not columns:
        return []
    if limit is None:
        return columns
    sketch = {r["column"]: r["cardinality"] for r in approx_distinct_counts(df, columns).collect()}
    few = [c for c in columns if sketch[c] <= 2 * limit]
    if not few:
        return []
    exact = {r["column"]: r["cardinality"] for r in distinct_counts(df, few).collect()}
    return [c for c in few if 2 <= exact.get(c, 0) <= limit]


_CELLS = "i int, j int, a string, b string, o bigint"


def _count_pairs(limit: int = 1_000_000):
    """Counts the value pairs of all column pairs of a partition, as packed codes; gives the cells out beyond ``limit`` of them."""

    def work(batches):
        codes: list[dict] | None = None
        cells: dict[tuple[int, int], dict[int, int]] = {}
        held = 0

        def out():
            names = [list(c) for c in codes]
            for (i, j), got in cells.items():
                at = np.fromiter(got, np.int64, len(got))
                left, right = at >> 32, at & 0xFFFFFFFF
                yield pd.DataFrame({"i": i, "j": j, "a": [names[i][x] for x in left], "b": [names[j][x] for x in right], "o": list(got.values())})

        for pdf in batches:
            if codes is None:
                codes = [{} for _ in pdf.columns]
            numbers = []
            for k, name in enumerate(pdf.columns):
                known = codes[k]
                where, values = pd.factorize(pdf[name])  # null: -1
                table = np.array([known.setdefault(v, len(known)) for v in values] + [-1], np.int64)
                numbers.append(table[where])
            for i in range(len(numbers)):
                for j in range(i + 1, len(numbers)):
                    both = (numbers[i] >= 0) & (numbers[j] >= 0)
                    packed, n = np.unique(numbers[i][both] << 32 | numbers[j][both], return_counts=True)
                    got = cells.setdefault((i, j), {})
                    before = len(got)
                    for p, c in zip(packed.tolist(), n.tolist()):
                        got[p] = got.get(p, 0) + c
                    held += len(got) - before
            if held > limit:
                yield from out()
                codes, cells, held = None, {}, 0
        if codes is not None:
            yield from out()

    return work


def contingency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Observed cells of every column pair in one scan: (i, j, a, b, o), for any number of columns and values.

    Each partition counts its pairs (Arrow batches) and the counts are added; no row is multiplied.
    """
    named = df.select(*[_c(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)])
    return named.mapInPandas(_count_pairs(), _CELLS).groupBy("i", "j", "a", "b").agg(F.sum("o").alias("o"))


def cramers_v(df: DataFrame, columns: list[str] | None = None, max_unique: int | None = None, top_k: int | None = None) -> DataFrame:
    """Cramer's V of every categorical pair, strongest first: (col_a, col_b, score, metric).

    ``max_unique`` leaves out columns with more distinct values, ``top_k`` weaker pairs; by default nothing is left out.
    """
    if columns is None:
        numeric = set(numeric_columns(df))
        columns = [c for c in scalar_columns(df) if c not in numeric]
    columns = small_columns(df, columns, max_unique)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, score double, metric string")
    cells = contingency(df, columns)
    rows = cells.groupBy("i", "j", "a").agg(F.sum("o").cast("double").alias("r"))
    cols = cells.groupBy("i", "j", "b").agg(F.sum("o").cast("double").alias("c"))
    full = cells.join(rows, ["i", "j", "a"]).join(cols, ["i", "j", "b"])
    o = F.col("o").cast("double")
    stat = full.groupBy("i", "j").agg(
        F.sum(o).alias("n"), F.sum(o * o / (F.col("r") * F.col("c"))).alias("s"),
        F.count_distinct("a").alias("ra"), F.count_distinct("b").alias("cb"),
    )
    small = F.least(F.col("ra"), F.col("cb")) - 1
    score = F.sqrt(F.greatest(F.col("s") - 1.0, F.lit(0.0)) / F.nullif(small, F.lit(0)))
    names = F.array(*[F.lit(c) for c in columns])
    out = stat.where(small > 0).select(
        F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b"),
        score.alias("score"), F.lit("Cramer's V").alias("metric"), "i", "j",
    )
    if top_k:
        out = out.orderBy(F.desc(F.round("score", 12)), "i", "j").limit(int(top_k))
    return out.drop("i", "j")


# --- key sets ------------------------------------------------------------------------


def key_overlap(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Distinct non-null keys on both sides, how many match, and the share of child keys that match."""
    c = child.select(_c(child_col).alias("k")).where("k IS NOT NULL").distinct()
    p = parent.select(_c(parent_col).alias("k")).where("k IS NOT NULL").distinct()
    both = c.withColumn("c", F.lit(1)).join(p.withColumn("p", F.lit(1)), "k", "full")
    n = both.agg(F.count("c").alias("child_keys"), F.count("p").alias("parent_keys"), F.count_if(F.expr("c = 1 AND p = 1")).alias("shared_keys"))
    return n.select(
        "child_keys", "parent_keys", "shared_keys",
        F.coalesce(F.col("shared_keys") / F.nullif(F.col("child_keys"), F.lit(0)), F.lit(0.0)).alias("overlap"),
        F.expr("child_keys > 0 AND parent_keys > 0 AND shared_keys = 0").alias("disjoint"),
    )


def fk_overlaps(tables: dict[str, DataFrame], relations: list[tuple[str, str, str, str]]) -> DataFrame:
    """``key_overlap`` of (child table, column, parent table, column) edges: those between columns of one kind read every table once."""
    def kind(table: str, column: str) -> str | None:
        return key_kind(tables[table].schema[column].dataType)

    alike = [r for r in relations if kind(*r[:2]) and kind(*r[:2]) == kind(*r[2:])]
    parts = [with_overlap(shared_keys(tables, alike)).drop("coverage")] if alike else []
    parts += [
        key_overlap(tables[ct], cc, tables[pt], pc).select(
            F.lit(ct).alias("from_table"), F.lit(cc).alias("from_column"), F.lit(pt).alias("to_table"), F.lit(pc).alias("to_column"), "*"
        )
        for ct, cc, pt, pc in relations if (ct, cc, pt, pc) not in alike
    ]
    return reduce(DataFrame.unionByName, parts)


def drop_orphans(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, min_rows: int = 1_000_000) -> DataFrame:
    """Child rows whose non-null key exists in the parent; rows with a null key stay."""
    keys = parent.select(_c(parent_col).alias("_k")).where("_k IS NOT NULL").distinct()
    # the null keys never meet the join, so they cannot pile up in one task
    known = skew_join(child.where(_c(child_col).isNotNull()).withColumn("_k", _c(child_col)), keys, ["_k"], "left_semi", min_rows=min_rows)
    return known.drop("_k").unionByName(child.where(_c(child_col).isNull()))
