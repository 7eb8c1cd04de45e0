"""Column profiles, value evidence and key candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import random as R
from ..functions.text import plain_number, quote
from ..session import cut_lineage
from . import summaries

BATCH = 3  # columns per aggregation of a stream or an expression, keeps the generated code small
SKETCH_BITS = 12
LONG_FROM = 32  # columns per scan of exact distinct counts
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns a profile can describe; nested ones are left out."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, _NESTED)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _c(name: str) -> Column:
    return F.col(quote(name))


def _text(c: Column, dtype: T.DataType) -> Column:
    return plain_number(c.cast("double")) if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType) else c.cast("string")


def _batches(columns: list[str]) -> list[list[str]]:
    return [columns[i : i + BATCH] for i in range(0, len(columns), BATCH)]


def _drawn(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows drawn over the whole table (all of a smaller one), not its first ones."""
    n = df.count()
    return df if n <= rows else df.sample(min(1.0, max(1, rows) / n), seed)


def profile(df: DataFrame, columns: list[str] | None = None, cardinality: str = "approx", sample_rows: int | None = None) -> DataFrame:
    """One row per column: type, nulls, null percent, min, max, cardinality, sd, variance.

    One scan learns all of it (``summaries``). ``cardinality``: ``approx`` (a sketch, exact below
    ``summaries.SKETCH`` values) or ``exact``: columns beyond that are read once more and their values
    counted by key.
    """
    if sample_rows:
        df = _drawn(df, int(sample_rows))
    columns = columns or scalar_columns(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    seen = summaries.summarize(df, columns)
    if cardinality != "approx":
        seen = cut_lineage(seen)
        wide = [columns[r["position"]] for r in seen.where(F.size("sketch") >= summaries.SKETCH).select("position").collect()]
    seen = seen.withColumn("distinct", summaries.estimate(F.col("sketch")))
    if cardinality != "approx" and wide:
        exact = distinct_counts(df, wide).withColumnRenamed("cardinality", "_exact")
        names = F.array(*[F.lit(c) for c in columns])
        seen = seen.withColumn("column", F.element_at(names, F.col("position") + 1)).join(F.broadcast(exact), "column", "left")
        seen = seen.withColumn("distinct", F.coalesce("_exact", "distinct"))
    slots = summaries.slots(df, columns)
    every = df.sparkSession.createDataFrame([(i, c, kinds[c].simpleString()) for i, c in enumerate(columns)], "position int, column string, type string")
    place = F.create_map(*[x for i, k in enumerate(slots) for x in (F.lit(i), F.lit(k))])[F.col("position")]

    def bound(which: str) -> Column:
        out = F.lit(None).cast("string")
        for k, kind in enumerate(summaries.slot_types(df, columns)):
            out = F.when(place == k, _text(F.col(f"{which}{k}"), kind)).otherwise(out)
        return out

    n, filled = F.coalesce("n", F.lit(0)).cast("bigint"), F.coalesce("filled", F.lit(0)).cast("bigint")
    is_number = F.array_contains(F.array(*[F.lit(i) for i, c in enumerate(columns) if isinstance(kinds[c], T.NumericType)]).cast("array<int>"), F.col("position"))
    v = F.when(is_number & (filled > 1), F.col("m2") / (filled - 1))
    v = F.when(~F.isnan(v), v)
    nulls = n - filled
    out = every.join(F.broadcast(seen.drop("column")), "position", "left").select(
        "position", "column", "type", nulls.alias("nulls"), F.round(nulls * 100.0 / F.nullif(n, F.lit(0)), 2).alias("null_value_percent"),
        bound("low").alias("min"), bound("high").alias("max"), F.coalesce("distinct", F.lit(0)).cast("bigint").alias("cardinality"), F.sqrt(v).alias("sd"), v.alias("variance"),
        (F.lit(None).cast("bigint") if sample_rows else n).alias("total_rows"), n.alias("profiled_rows"), F.lit("sampled" if sample_rows else "full").alias("profile_mode"),
    )
    return out


def distinct_sketch(c: Column) -> Column:
    """Mergeable HyperLogLog sketch (about 1.6 % error) of the non-null values."""
    return F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), SKETCH_BITS)


def approx_distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, cardinality, filled, n): sketch estimates with non-null and row counts, all columns in one scan."""
    seen = summaries.summarize(df, columns).select("position", summaries.estimate(F.col("sketch")).alias("cardinality"), "filled", "n")
    every = df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column string")
    zero = F.lit(0).cast("bigint")
    return every.join(F.broadcast(seen), "position", "left").select("column", *[F.coalesce(c, zero).alias(c) for c in ("cardinality", "filled", "n")])


def long_values(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(column, value as text) for all columns in one scan, nulls dropped."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(n).alias("column"), _text(_c(n), kinds[n]).alias("value")) for n in columns])
    return df.select(*(keep or []), F.explode(cells).alias("cell")).select(*(keep or []), "cell.column", "cell.value").where(F.col("value").isNotNull())


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct counts; repeated values collapse in each task, then 128-bit keys are shuffled instead of values.

    One scan takes up to ``LONG_FROM`` columns, so a task holds the values of no more than those.
    """

    def some(names: list[str]) -> DataFrame:
        counts = summaries.key_counts(df, names).groupBy("position").agg(F.count(F.lit(1)).alias("cardinality"))
        every = df.sparkSession.createDataFrame(list(enumerate(names)), "position int, column string")
        return every.join(F.broadcast(counts), "position", "left").select("column", F.coalesce("cardinality", F.lit(0)).alias("cardinality"))

    return reduce(DataFrame.unionByName, [some(columns[i : i + LONG_FROM]) for i in range(0, len(columns), LONG_FROM)])


def row_counts(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Total and profiled row counts; the total is unknown for a sample."""
    seen = _drawn(df, int(sample_rows)) if sample_rows else df
    n = seen.agg(F.count(F.lit(1)).alias("profiled_rows"))
    return n.select((F.lit(None).cast("bigint") if sample_rows else F.col("profiled_rows")).alias("total_rows"), "profiled_rows")


def value_counts(df: DataFrame, columns: list[str], top: int = 6) -> DataFrame:
    """(column, value, n, rank): the most frequent values per column as text, ties by value."""
    found, _ = _frequent(df, columns, top, False)
    return _ranked(found, columns, top)


def _ranked(found: DataFrame, columns: list[str], top: int) -> DataFrame:
    named = found.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("position") + 1).alias("column"), "value", "n")
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _texts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[_text(_c(c), df.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(columns)])


def _frequent(df: DataFrame, columns: list[str], top: int, cardinalities: bool) -> tuple[DataFrame, dict[str, int]]:
    """(position, value, n) of values among which the ``top`` of every column are, and, if wanted, the number of distinct values per column.

    A summary of frequent values is enough where nothing was left out of it. Where the ``top``-th
    value has more rows than any value outside can have, the candidates are counted in a second
    scan. For the other columns values are counted by key; where the ``top`` ends among values with
    one row the smallest values decide, else only values of the keys at the top are read.
    Where too many keys tie for that, the texts themselves are counted.
    """
    spark, view = df.sparkSession, _texts(df, columns)
    names = view.columns
    seen = {r["position"]: r for r in summaries.summarize(view, names, max(SUMMARY, 4 * top), 2 * top).select("position", "filled", "keys", "error", "least", F.size("sketch").alias("sketched"), summaries.estimate(F.col("sketch")).alias("distinct")).collect()}
    parts, recount, by_key, sizes = [], {}, [], {}
    for i, r in seen.items():
        best = sorted(r["keys"], key=lambda k: -k["n"])
        if r["sketched"] < summaries.SKETCH:
            sizes[i] = r["distinct"]
        if not r["error"] and all(k["text"] is not None for k in best):
            parts.append([(i, k["text"], k["n"]) for k in best])
        elif not r["error"] or len(best) >= top and best[top - 1]["n"] > r["error"]:
            # more rows than a value outside can have, also by the lower bound: only these are candidates
            bar = best[min(top, len(best)) - 1]["n"] - r["error"]
            recount[i] = [k for k in best if k["n"] >= bar]
        else:
            by_key.append(i)
    rows = spark.createDataFrame([x for p in parts for x in p], _VALUES)
    if recount:
        rows = rows.unionByName(summaries.fetch(view, names, {i: ([k["a"] for k in some], [k["b"] for k in some]) for i, some in recount.items()}))
    uncounted = by_key + ([i for i in recount if i not in sizes] if cardinalities else [])
    if uncounted:
        counts = cut_lineage(summaries.key_counts(view.select(*[names[i] for i in uncounted]), [names[i] for i in uncounted]))
        at = {k: i for k, i in enumerate(uncounted)}
        if cardinalities:
            sizes.update({at[r["position"]]: r["count"] for r in counts.groupBy("position").count().collect()})
        rows = rows.unionByName(_by_key(view, names, counts, {k: i for k, i in at.items() if i in by_key}, top, {i: seen[i]["least"] for i in by_key}))
    return rows, {columns[i]: n for i, n in sizes.items()}


_VALUES = "position int, value string, n bigint"
SUMMARY = 512  # frequent values kept per column
FETCHED = 65_536  # keys whose values are looked for in one scan


def _by_key(view: DataFrame, names: list[str], counts: DataFrame, at: dict[int, int], top: int, least: dict[int, list[str]]) -> DataFrame:
    """The most frequent values of columns whose distinct values were counted by key; ``at``: position in ``counts`` -> position in ``names``."""
    spark = view.sparkSession
    w = Window.partitionBy("position").orderBy(F.desc("n"), "a", "b")
    mine = counts.where(F.col("position").isin(*at))
    bars = {r["position"]: r["n"] for r in mine.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).groupBy("position").agg(F.min("n").alias("n")).collect()}
    bar = F.create_map(*[x for p, n in bars.items() for x in (F.lit(p), F.lit(max(n, 2)))])[F.col("position")] if bars else F.lit(0)
    high = mine.where(F.col("n") >= bar)
    sizes = {r["position"]: r["count"] for r in high.groupBy("position").count().collect()}
    few, total = [], 0
    for p, n in sorted(sizes.items(), key=lambda x: x[1]):
        total += n
        if total <= FETCHED:
            few.append(p)
    rows = spark.createDataFrame([], _VALUES)
    wanted: dict[int, tuple[list, list]] = {}
    for r in high.where(F.col("position").isin(*few)).collect() if few else []:
        a, b = wanted.setdefault(at[r["position"]], ([], []))
        a.append(r["a"])
        b.append(r["b"])
    if wanted:
        rows = cut_lineage(summaries.fetch(view, names, wanted))
    ones = [(at[p], v) for p, n in bars.items() if n == 1 for v in least[at[p]]]
    if ones:  # all other values have one row: the smallest of them come first
        rest = spark.createDataFrame(ones, "position int, value string").join(rows.select("position", "value"), ["position", "value"], "left_anti")
        rows = rows.unionByName(rest.withColumn("n", F.lit(1).cast("bigint")))
    for p in set(sizes) - set(few):
        i = at[p]
        rows = rows.unionByName(view.select(F.lit(i).alias("position"), F.col(names[i]).alias("value")).where("value is not null").groupBy("position", "value").agg(F.count(F.lit(1)).alias("n")))
    return rows


def column_evidence(df: DataFrame, columns: list[str] | None = None, top: int = 6) -> DataFrame:
    """Type, exact cardinality and the ``top`` values of every column."""
    columns = columns or scalar_columns(df)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found, sizes = _frequent(df, columns, top, True)
    best = _ranked(found, columns, top)
    best = best.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]), "|").alias("sample_values"))
    every = df.sparkSession.createDataFrame([(i, n, kinds[n], sizes.get(n, 0)) for i, n in enumerate(columns)], "position int, column string, data_type string, cardinality bigint")
    return every.join(best, "column", "left").select("column", "data_type", "cardinality", F.coalesce("sample_values", F.lit("")).alias("sample_values"))


def value_sample(df: DataFrame, columns: list[str], ids: list[str], size: int = 50, seed: int = 42) -> DataFrame:
    """Up to ``size`` non-null values per column, all columns in one scan.

    The choice is random by row id, so it is unbiased and repeatable.
    """
    cells = long_values(df, columns, ids).withColumn("_h", R.bits(seed, "value_sample", ["column", *ids]))
    w = Window.partitionBy("column").orderBy("_h", *ids)
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).select("column", "rank", "value")


def key_candidates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns without nulls whose values are all different; the id-like name comes first.

    A sketch pass (HyperLogLog) drops most columns; only the rest pays for exact counts.
    """
    columns = columns or scalar_columns(df)
    seen = approx_distinct_counts(df, columns).collect()
    n = seen[0]["n"]
    likely = [r["column"] for r in seen if n > 0 and r["filled"] == n and r["cardinality"] >= 0.8 * n]
    if not likely:
        return df.sparkSession.createDataFrame([], "column string, cardinality bigint, id_like boolean, rank int")
    exact = distinct_counts(df.select(*[_c(c) for c in likely]), likely).where(F.col("cardinality") == F.lit(n))
    id_like = F.lower("column").rlike("(id|key)$")
    pos = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    out = exact.withColumn("id_like", id_like).withColumn("_pos", pos)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("id_like"), "_pos"))).drop("_pos")
