"""Drift: how far the values of two spans of a stream lie apart, from mergeable quantile sketches.

Every micro-batch writes one row per period and column: counts and a KLL sketch of the numbers (times as microseconds). Rows
add up over batches in any order, so late files and restarts change nothing, and any two spans of periods can be compared
later without the data. Null, NaN and non-numeric text count as missing. A column without values in one of the spans has
null distances; rows without a time belong to the period null.

The sketch's ranks are off by about 0.004 (``K`` = 800) and distances are looked up at ``POINTS`` quantiles of both
sides, so a Kolmogorov-Smirnov distance is off by at most about 1 / POINTS + 0.01.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quote
from ..operators.copula import numeric_view
from ..operators.profile import _batches
from ..session import work_folder

K = 800
POINTS = 128
FINE = 1000  # quantiles that shares of bins are read from
BINS = 10
LEAST = 1e-4  # least share of a bin in the population stability index
_KINDS = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _KINDS)]


def partial_states(df: DataFrame, period: Column, columns: list[str] | None = None) -> DataFrame:
    """(period, column, n, filled, sketch) of the rows at hand."""
    columns = numeric_columns(df) if columns is None else columns
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def batch(names: list[str]) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, name in enumerate(names):
            x = numeric_view(F.col(quote(name)), kinds[name])
            x = F.when(~F.isnan(x), x)
            aggs += [F.count(x).alias(f"c{i}"), F.kll_sketch_agg_double(x, K).alias(f"s{i}")]
        cells = [F.struct(F.lit(name).alias("column"), F.col("n"), F.col(f"c{i}").alias("filled"), F.col(f"s{i}").alias("sketch")) for i, name in enumerate(names)]
        return df.groupBy(period.alias("period")).agg(*aggs).select("period", F.inline(F.array(*cells)))

    return reduce(DataFrame.unionByName, [batch(b) for b in _batches(columns)])


def merged(states: DataFrame, *keys: str) -> DataFrame:
    """States added up by column and the given further columns."""
    return states.groupBy("column", *keys).agg(
        F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.kll_merge_agg_double(F.when(F.col("filled") > 0, F.col("sketch"))).alias("sketch")
    )


def _quantiles(sketch: str, points: int) -> Column:
    """The values at 1/points, 2/points, ... of all values."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / points) for i in range(1, points + 1)]))


def _share(quantiles: str, x: Column) -> Column:
    """Share of the values up to ``x``: a quantile lies at or below it exactly when its rank does."""
    return F.size(F.filter(quantiles, lambda v: v <= x)) / F.size(quantiles)


def _measured(pairs: DataFrame) -> DataFrame:
    """Adds ks and psi to rows with base_sketch, base_filled, sketch and filled."""
    both = (F.col("base_filled") > 0) & (F.col("filled") > 0)
    sides = {"a": "base_sketch", "b": "sketch"}
    df = pairs.withColumns({f"_{n}{p}": F.when(both, _quantiles(c, p)) for n, c in sides.items() for p in (POINTS, FINE)})
    ks = F.array_max(F.transform(F.array_union(f"_a{POINTS}", f"_b{POINTS}"), lambda x: F.abs(_share(f"_a{POINTS}", x) - _share(f"_b{POINTS}", x))))
    edges = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda i: F.element_at(f"_a{FINE}", (i * (FINE // BINS)).cast("int"))))
    df = df.withColumn("_edges", F.when(both, edges))
    df = df.withColumns({"_a": F.transform("_edges", lambda x: _share(f"_a{FINE}", x)), "_b": F.transform("_edges", lambda x: _share(f"_b{FINE}", x))})

    def shares(name: str) -> Column:
        above, below = F.concat(F.col(name), F.array(F.lit(1.0))), F.concat(F.array(F.lit(0.0)), F.col(name))
        return F.zip_with(above, below, lambda hi, lo: F.greatest(hi - lo, F.lit(LEAST)))

    psi = F.aggregate(F.zip_with(shares("_a"), shares("_b"), lambda p, q: (q - p) * F.log(q / p)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumns({"ks": ks, "psi": psi})


def _against(base: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    named = base.select("column", F.col("n").alias("base_n"), F.col("filled").alias("base_filled"), F.col("sketch").alias("base_sketch"))
    # one row per column, a sketch has a few kilobytes
    return _measured(other.join(F.broadcast(named), "column")).select("column", *keys, "base_n", "base_filled", "n", "filled", "ks", "psi")


def between(states: DataFrame, base: Column, other: Column) -> DataFrame:
    """(column, base_n, base_filled, n, filled, ks, psi) of two spans, given as conditions on ``period``."""
    return _against(merged(states.where(base)), merged(states.where(other)))


def by_period(states: DataFrame) -> DataFrame:
    """Every period against all periods together."""
    return _against(merged(states), merged(states, "period"), "period")


def start(source: DataFrame, period: Column, target: str, checkpoint: str, columns: list[str] | None = None):
    """Keep the states of a stream; a repeated micro-batch overwrites its own folder."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the column batches read it several times
        partial_states(batch, period, columns).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        batch.unpersist()

    return source.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, period: Column, files_per_batch: int = 1, columns: list[str] | None = None) -> DataFrame:
    """The states of all files of a folder that match."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    work = work_folder(spark, "drift")
    start(source, period, f"{work}/out", f"{work}/state", columns).awaitTermination()
    return spark.read.parquet(f"{work}/out/batch=*")
