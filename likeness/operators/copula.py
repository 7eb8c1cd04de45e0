"""Look-alike tables: empirical marginals joined by a Gaussian copula.

Every column keeps the exact counts of its values, however many there are, and all columns are in
the model. The driver holds the tables of columns with few values and a k x k matrix; longer tables
stay in Spark, where values are scored and drawn ranks are looked up by equi-joins. Where a table is
kept does not change the result.

Long texts are modelled and drawn by their 128-bit names (MD5); the texts themselves are shuffled once,
when the drawn names are turned back into texts.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import random as R
from ..functions.text import quote
from ..session import cut_lineage, together
from .profile import _c, approx_distinct_counts
from .relate import _PARTIAL, _co_moments, merge_co_moments
from .joins import shuffle_width, skew_join
from .rows import hashed_index, ordered_index
from .series import running_sum

VALUE_LIMIT = 1000  # value tables of at most so many rows are kept on the driver, longer ones in Spark
CHUNK = 100_000  # rows one task may make from one input row
NAMED_FROM = 48  # mean bytes from which texts travel by name; this changes the plan only
HEAD = 32  # texts of one count are ordered by so many first characters, then by name

_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class Marginal:
    name: str
    kind: str  # discrete (values on the driver) | ranked (values in a Spark table)
    dtype: T.DataType
    null_share: float = 0.0
    values: list[str] = field(default_factory=list)  # discrete: texts in z order
    cuts: np.ndarray | None = None  # discrete: upper z of each value
    mids: np.ndarray | None = None  # discrete: z of the middle of each value
    table: DataFrame | None = None  # ranked: _value, _start (rows before it), _cnt, _z (of its middle)
    filled: int = 0  # ranked: rows with a value
    largest: int = 0  # ranked: rows of the most frequent value
    texts: DataFrame | None = None  # ranked by name: _value (name), _text


@dataclass
class Copula:
    marginals: list[Marginal]
    corr: np.ndarray
    rows: int

    @property
    def factor(self) -> np.ndarray:
        return positive_factor(self.corr)


def positive_factor(corr: np.ndarray) -> np.ndarray:
    """Lower factor of a correlation matrix, repaired by its eigenvalues when needed."""
    if not len(corr):
        return corr
    try:
        return np.linalg.cholesky(corr)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(corr)
        fixed = vectors @ np.diag(np.clip(values, 1e-8, None)) @ vectors.T
        scale = np.sqrt(np.diag(fixed))
        return np.linalg.cholesky(fixed / np.outer(scale, scale))


def _ppf(p: float, n: int) -> float:
    edge = 0.5 / max(n, 1)
    return NormalDist().inv_cdf(min(max(p, edge), 1 - edge))


def numeric_view(c: Column, dtype: T.DataType) -> Column:
    """Numbers as they are, times as microseconds."""
    if isinstance(dtype, _TIMES):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def typed(c: Column, dtype: T.DataType) -> Column:
    """Back from the numeric view."""
    if isinstance(dtype, _TIMES):
        return F.timestamp_micros(F.round(c).cast("bigint")).cast(dtype)
    if isinstance(dtype, T.IntegralType):
        return F.bround(c).cast(dtype)
    return c.cast(dtype)


# --- fit -----------------------------------------------------------------------------


def value_tables(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of all columns in one scan; repeats combine before the shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _is_ordered(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, *_TIMES))


def value_name(c: Column) -> Column:
    """16 bytes that stand for a text; two of n texts share a name with probability below n^2 / 2^128."""
    return F.unhex(F.md5(c.cast("string")))


def long_texts(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns whose values have ``NAMED_FROM`` bytes or more on average; one aggregation."""
    if not columns:
        return []
    mean = df.agg(*[F.avg(F.octet_length(_c(c))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [c for c, m in zip(columns, mean) if m is not None and m >= NAMED_FROM]


def value_ranks(df: DataFrame, column: str, dtype: T.DataType, n: int, named: bool = False) -> DataFrame:
    """(_value, _start, _cnt, _z) of the ``n`` filled rows: numbers and times in their order, texts by falling count, first characters and name.

    ``named`` puts the name of a text in its place.
    """
    c, text = _c(column), not _is_ordered(dtype)
    value = value_name(c) if named else c
    head = [F.substring(c.cast("string"), 1, HEAD).alias("_head")] if text else []
    counts = df.where(c.isNotNull()).groupBy(value.alias("_value"), *head).agg(F.count(F.lit(1)).alias("_cnt"))
    if text:
        counts = counts.withColumns({"_less": -F.col("_cnt"), "_name": F.col("_value") if named else value_name(F.col("_value"))})
    numbered = ordered_index(counts, [], ["_less", "_head", "_name"] if text else ["_value"], "_t")
    placed = running_sum(numbered, [], "_cnt", "_end", "_t").withColumn("_end", F.col("_end").cast("bigint"))

    @F.pandas_udf("double")
    def score(middle: pd.Series) -> pd.Series:
        return pd.Series([_ppf(x / n, n) for x in middle], dtype="float64")

    return cut_lineage(placed.select("_value", (F.col("_end") - F.col("_cnt")).alias("_start"), "_cnt", score(F.col("_end") - F.col("_cnt") / 2).alias("_z")))


def exact_quantiles(df: DataFrame, columns: list[str], ids: list[str], points: int) -> DataFrame:
    """(column, prob, value): exact interpolated quantiles of all columns by one distributed sort."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), numeric_view(_c(c), kinds[c]).alias("value")) for c in columns])
    long = df.select(*ids, F.explode(cells).alias("x")).select(*ids, "x.*").where("value IS NOT NULL")
    # equal values are interchangeable, the ids only spread them over the sort
    ranked = ordered_index(long, ["column"], ["value", *ids], "r").select("column", "value", "r")
    sizes = ranked.groupBy("column").agg((F.max("r") + 1).alias("n"))
    probs = F.explode(F.array(*[F.lit(i / (points - 1)) for i in range(points)]))
    want = sizes.withColumn("prob", probs).withColumn("h", F.col("prob") * (F.col("n") - 1))
    lo, hi = F.floor("h").cast("bigint"), F.ceil("h").cast("bigint")
    want = want.select("column", "prob", "h", F.explode(F.array_distinct(F.array(lo, hi))).alias("r"))
    hit = want.join(ranked, ["column", "r"])
    part = F.when(F.col("r") == F.col("h"), 1.0).otherwise(1.0 - F.abs(F.col("r") - F.col("h")))
    return hit.groupBy("column", "prob").agg(F.sum(F.col("value") * part).alias("value"))


def scalar_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def fit(df: DataFrame, columns: list[str] | None = None, value_limit: int = VALUE_LIMIT) -> Copula:
    """Marginals and normal-score correlations of a table."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = scalar_names(df) if columns is None else columns
    seen = {r["column"]: r for r in approx_distinct_counts(df, columns).collect()} if columns else {}
    n = next((r["n"] for r in seen.values()), 0)
    filled = {c: seen[c]["filled"] for c in columns}
    distinct = {c: seen[c]["cardinality"] for c in columns}
    discrete = [c for c in columns if distinct[c] <= value_limit]
    ranked = [c for c in columns if c not in discrete]

    named = long_texts(df, [c for c in ranked if isinstance(kinds[c], T.StringType)])
    tables: dict[str, list] = {c: [] for c in discrete}
    counted, *ranks = together(
        lambda: value_tables(df, discrete).where("value IS NOT NULL").collect() if discrete else [],
        *[lambda c=c: value_ranks(df, c, kinds[c], filled[c], c in named) for c in ranked],
    )
    for r in counted:
        tables[r["column"]].append((r["value"], r["n"]))
    marginals = []
    for c in columns:
        m = Marginal(c, "discrete", kinds[c], 1 - filled[c] / n if n else 1.0)
        if c in tables:
            _set_values(m, tables[c], filled[c])
        else:
            m.kind, m.table, m.filled = "ranked", ranks[ranked.index(c)], filled[c]
            m.largest = m.table.agg(F.coalesce(F.max("_cnt"), F.lit(0))).first()[0]
            if c in named:
                texts = df.select(value_name(_c(c)).alias("_value"), _c(c).alias("_text")).where("_value IS NOT NULL")
                m.texts = texts.dropDuplicates(["_value"])
        marginals.append(m)
    model = Copula(marginals, np.eye(0), n)
    model.corr = score_correlation(df, model)
    return model


def _set_values(m: Marginal, table: list[tuple[str, int]], n: int) -> None:
    if isinstance(m.dtype, T.NumericType):
        table = sorted(table, key=lambda v: float(v[0]))
    elif isinstance(m.dtype, _TIMES):
        table = sorted(table)
    else:
        table = sorted(table, key=lambda v: (-v[1], v[0][:HEAD], hashlib.md5(v[0].encode()).digest()))
    cum = np.cumsum([k for _, k in table]) if table else np.array([])
    m.values = [v for v, _ in table]
    m.cuts = np.array([np.inf if c >= n else _ppf(c / n, n) for c in cum])
    m.mids = np.array([_ppf((c - k / 2) / n, n) for c, (_, k) in zip(cum, table)])


def _scores(pdf: pd.DataFrame, mids: list[dict | None]) -> pd.DataFrame:
    """Normal scores of the columns in order: texts are looked up in ``mids``, others are scores already."""
    return pd.DataFrame({i: (pdf.iloc[:, i] if m is None else pdf.iloc[:, i].map(m)).astype("float64") for i, m in enumerate(mids)})


def _heavy_values(m: Marginal, rows: int) -> list:
    """Values (also null) with so many rows that a join must deal them, from the counts at hand."""
    limit = max(1_000_000, rows // (4 * shuffle_width(m.table)))
    heavy = [(r[0],) for r in m.table.where(F.col("_cnt") > limit).select("_value").collect()] if m.largest > limit else []
    return heavy + ([(None,)] if rows - m.filled > limit else [])


def _often_drawn(m: Marginal) -> list:
    """Names that take a quarter of an even shuffle partition or more of the rows drawn; at most four per partition."""
    limit = max(64, m.filled // (4 * shuffle_width(m.table)))  # of the source's rows, whose shares the draws have
    return [(r[0],) for r in m.table.where(F.col("_cnt") > limit).select("_value").collect()] if m.largest > limit else []


def score_correlation(df: DataFrame, model: Copula) -> np.ndarray:
    """Correlation of the normal scores: each partition adds up one small matrix."""
    some = model.marginals
    k = len(some)
    corr = np.eye(k)
    if k < 2:
        return corr
    def place(m: Marginal) -> Column:
        if m.texts is not None:
            return value_name(_c(m.name))
        return _c(m.name).cast("string") if m.kind == "discrete" else _c(m.name)

    view = df.select(*[place(m).alias(f"x{i}") for i, m in enumerate(some)])
    for i, m in enumerate(some):
        if m.kind == "ranked":
            scored = m.table.select(F.col("_value").alias(f"x{i}"), F.col("_z").alias(f"z{i}"))
            view = skew_join(view, scored, [f"x{i}"], "left", heavy=_heavy_values(m, model.rows)).drop(f"x{i}")
    view = view.select(*[f"x{i}" if m.kind == "discrete" else f"z{i}" for i, m in enumerate(some)])
    mids = [dict(zip(m.values, m.mids)) if m.kind == "discrete" else None for m in some]
    parts = view.mapInPandas(lambda it: _co_moments(_scores(p, mids) for p in it), _PARTIAL)
    for r in merge_co_moments(parts).collect():
        if r["cxx"] > 1e-12 and r["cyy"] > 1e-12:
            corr[r["i"], r["j"]] = corr[r["j"], r["i"]] = float(np.clip(r["cxy"] / np.sqrt(r["cxx"] * r["cyy"]), -1, 1))
    return corr


# --- sample --------------------------------------------------------------------------


def _fast_normal(seed: int, stream: str, ids) -> Column:
    a = F.lit(1.0) - R.fast_u(seed, stream + ".a", ids)
    return F.sqrt(F.lit(-2.0) * F.log(a)) * F.cos(F.lit(2 * np.pi) * R.fast_u(seed, stream + ".b", ids))


def sample_on(base: DataFrame, ids: list[str], model: Copula, seed: int = 42, stream: str = "copula", portable: bool = False) -> DataFrame:
    """Adds synthetic columns to rows identified by ``ids``. ``portable`` uses the MD5 draws instead of the fast ones."""
    some = model.marginals
    if some:
        normal = R.normal if portable else _fast_normal
        z = [normal(seed, f"{stream}.{m.name}", ids) for m in some]
        shape = T.StructType([T.StructField(f"v{i}", T.StringType() if m.kind == "discrete" else T.LongType()) for i, m in enumerate(some)])
        lower = model.factor
        maps = [(m.kind, np.array(m.values, dtype=object), m.cuts, m.filled) for m in some]

        @F.pandas_udf(shape)
        def draw(*cols: pd.Series) -> pd.DataFrame:
            w = np.column_stack([c.to_numpy(dtype="float64") for c in cols]) @ lower.T
            out = {}
            for i, (kind, values, cuts, n) in enumerate(maps):
                if kind == "ranked":  # the place of the value among the n filled rows
                    share = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in w[:, i].tolist()])
                    out[f"v{i}"] = np.minimum(np.floor(share * n), n - 1).astype(np.int64)
                elif len(values):
                    out[f"v{i}"] = values[np.minimum(np.searchsorted(cuts, w[:, i], side="right"), len(values) - 1)]
                else:
                    out[f"v{i}"] = np.full(len(w), None, dtype=object)
            return pd.DataFrame(out)

        base = base.withColumn("_v", draw(*z))
        base = base.withColumns({f"_v{i}": F.col(f"_v.v{i}") for i in range(len(some))}).drop("_v")
        for i, m in enumerate(some):
            if m.kind == "ranked":
                places = value_places(m.table, m.largest).select(F.col("_place").alias(f"_v{i}"), F.col("_value").alias(f"_w{i}"))
                # places are drawn evenly: only where there are few of them can one be large
                heavy = [(p,) for p in range(m.filled)] if m.filled <= 4 * shuffle_width(base) else []
                base = skew_join(base, places, [f"_v{i}"], heavy=heavy, grown=True)
        for i, m in enumerate(some):
            if m.texts is not None:  # last, so that no text goes through the joins above
                texts = m.texts.select(F.col("_value").alias(f"_w{i}"), F.col("_text").alias(f"_x{i}"))
                base = skew_join(base, texts, [f"_w{i}"], heavy=_often_drawn(m)).drop(f"_w{i}").withColumnRenamed(f"_x{i}", f"_w{i}")
        cols = {}
        for i, m in enumerate(some):
            v = F.col(f"_v{i}").cast(m.dtype) if m.kind == "discrete" else F.col(f"_w{i}")
            if m.null_share > 0:
                v = F.when(R.fast_u(seed, f"{stream}.{m.name}.null", ids) >= m.null_share, v)
            cols[m.name] = v
        base = base.withColumns(cols).drop(*[f"_{x}{i}" for i in range(len(some)) for x in "vw"])
    return base


def value_places(table: DataFrame, largest: int) -> DataFrame:
    """(_place, _value): each value at as many places, counted from ``_start``, as it has rows."""
    places = explode_counts(table.select("_value", "_start", "_cnt"), ["_start"], "_cnt", "_i", largest)
    return places.select((F.col("_start") + F.col("_i")).alias("_place"), "_value")


def draw_column(base: DataFrame, ids: list[str], source: DataFrame, column: str, seed: int, stream: str) -> DataFrame:
    """Fill a column with many values by drawing from the source's own value frequencies.

    Each value owns as many places 0..n-1 as it has rows; a drawn place is an equi-join on
    evenly spread integers. A value with very many rows is expanded in bounded chunks.
    """
    counts = source.groupBy(_c(column).alias("_value")).agg(F.count(F.lit(1)).alias("_cnt"))
    n, largest = counts.agg(F.sum("_cnt"), F.max("_cnt")).first()
    if not n:
        return base.withColumn(column, F.lit(None).cast(source.schema[column].dataType))
    keyed = counts.withColumn("_key", F.coalesce(F.sha2(F.col("_value").cast("string"), 256), F.lit("")))
    numbered = hashed_index(keyed, ["_key"], seed, f"{stream}.values", "_t")
    placed = running_sum(numbered, [], "_cnt", "_end", "_t").withColumn("_end", F.col("_end").cast("bigint"))
    places = value_places(placed.withColumn("_start", F.col("_end") - F.col("_cnt")), largest).withColumnRenamed("_value", column)
    drawn = base.withColumn("_place", F.floor(R.fast_u(seed, f"{stream}.{column}", ids) * n).cast("bigint"))
    return skew_join(drawn, places, ["_place"], grown=True).drop("_place")  # a small source makes few, large places


def explode_counts(df: DataFrame, keys: list[str], count: str, name: str, largest: int) -> DataFrame:
    """Repeat every row ``count`` times with ``name`` = 0..count-1.

    ``largest`` is the largest count. Beyond ``CHUNK`` the rows are cut into chunks that are
    dealt over all tasks before they are expanded.
    """
    total = F.col(count).cast("bigint")
    none = F.array().cast("array<bigint>")
    if largest <= CHUNK:
        return df.withColumn(name, F.explode(F.when(total > 0, F.sequence(F.lit(0).cast("bigint"), total - 1)).otherwise(none)))
    chunks = F.when(total > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((total - 1) / CHUNK).cast("bigint"))).otherwise(none)
    some = df.withColumn("_chunk", F.explode(chunks)).repartition(*keys, "_chunk")
    first = F.col("_chunk") * CHUNK
    return some.withColumn(name, F.explode(F.sequence(first, F.least(first + CHUNK, total) - 1))).drop("_chunk")


def synthesize(
    source: DataFrame, rows: int, seed: int = 42, key: str | None = None, skip: list[str] = (), stream: str = "table", portable: bool = False, model: Copula | None = None
) -> DataFrame:
    """A look-alike table. ``key`` becomes 1..rows (or a stable id text), ``skip`` columns are left out."""
    columns = [c for c in scalar_names(source) if c != key and c not in skip]
    model = model or fit(source, columns)
    base = source.sparkSession.range(0, max(1, int(rows))).withColumnRenamed("id", "_row")
    out = sample_on(base, ["_row"], model, seed, stream, portable)
    if key:
        out = out.withColumn(key, key_value(F.col("_row"), source.schema[key].dataType, seed, stream))
    order = [f.name for f in source.schema.fields if f.name in columns or f.name == key]
    return out.select("_row", *[quote(c) for c in order])


def key_value(row: Column, dtype: T.DataType, seed: int, stream: str) -> Column:
    """Key of a 0-based row."""
    if isinstance(dtype, T.NumericType):
        return (row + 1).cast(dtype)
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream + ".key"), row.cast("string"))), 1, 32).cast(dtype)
