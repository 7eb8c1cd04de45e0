"""A column profile kept up to date by a stream: partial statistics per micro-batch, merged on reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import _batches, _c, _text, distinct_sketch, scalar_columns
from ..session import work_folder


def partial_profile(df: DataFrame) -> DataFrame:
    """One mergeable row per column: counts, bounds, mean and squared deviations, distinct sketch."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def batch(names: list[str]) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, name in enumerate(names):
            c = _c(name)
            aggs += [F.count(c).alias(f"c{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), distinct_sketch(c).alias(f"k{i}")]
            if isinstance(kinds[name], T.NumericType):
                x = c.cast("double")
                aggs += [F.avg(x).alias(f"m{i}"), (F.var_pop(x) * F.count(x)).alias(f"q{i}")]
        none = F.lit(None).cast("double")

        def cell(i: int, name: str):
            number = isinstance(kinds[name], T.NumericType)
            bounds = [(F.col(f"{w}{i}").cast("double") if number else none) for w in ("lo", "hi")]
            return F.struct(
                F.lit(name).alias("column"), F.col("n"), F.col(f"c{i}").alias("filled"), _text(F.col(f"lo{i}"), kinds[name]).alias("lo"),
                _text(F.col(f"hi{i}"), kinds[name]).alias("hi"), bounds[0].alias("lo_number"), bounds[1].alias("hi_number"),
                (F.col(f"m{i}") if number else none).alias("mean"), (F.col(f"q{i}") if number else none).alias("m2"), F.col(f"k{i}").alias("sketch"),
            )

        return df.agg(*aggs).select(F.inline(F.array(*[cell(i, n) for i, n in enumerate(names)])))

    return reduce(DataFrame.unionByName, [batch(b) for b in _batches(scalar_columns(df))])


def merge(parts: DataFrame) -> DataFrame:
    """(column, n, nulls, min, max, cardinality, sd) from any number of partial profiles."""
    some = F.when(F.col("filled") > 0, F.col("filled").cast("double"))
    # means relative to one of them, so that large offsets do not cancel
    anchored = parts.join(F.broadcast(parts.groupBy("column").agg(F.min("mean").alias("a"))), "column").withColumn("d", F.col("mean") - F.col("a"))
    g = anchored.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("filled").alias("filled"),
        F.coalesce(F.min_by("lo", "lo_number"), F.min("lo")).alias("min"), F.coalesce(F.max_by("hi", "hi_number"), F.max("hi")).alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cardinality"),
        F.sum("m2").alias("m2"), F.sum(some * F.col("d")).alias("s"), F.sum(some * F.col("d") * F.col("d")).alias("q"),
    )
    spread = (F.col("m2") + F.col("q") - F.col("s") * F.col("s") / F.nullif(F.col("filled"), F.lit(0))) / F.nullif(F.col("filled") - 1, F.lit(0))
    return g.select("column", "n", (F.col("n") - F.col("filled")).alias("nulls"), "min", "max", "cardinality", F.when(spread.isNotNull(), F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("sd"))


def start(source: DataFrame, target: str, checkpoint: str):
    """Profile every micro-batch of a stream into its own folder; a repeated batch overwrites its folder."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the column batches below read it several times
        partial_profile(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        batch.unpersist()

    return source.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    work = work_folder(spark, "profile")
    start(source, f"{work}/out", f"{work}/state").awaitTermination()
    return merge(spark.read.parquet(f"{work}/out/batch=*"))
