"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, on: list[str], min_rows: int = 1_000_000) -> list:
    """Keys with more rows than a quarter of an even shuffle partition and than ``min_rows``.

    Counts are combined before the shuffle. At most four keys per shuffle partition can
    pass, so the list is small whatever the data.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    total, largest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(min_rows, total // (4 * shuffle_width(df)))
    if largest <= limit:
        return []
    return counts.where(F.col("n") > limit).select(*on).collect()


def skew_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", slices: int = 16, min_rows: int = 1_000_000, heavy: list | None = None, grown: bool = False
) -> DataFrame:
    """Equi-join with few ``right`` rows per key and any number of ``left`` rows per key.

    Left rows of heavy (or null) keys are dealt over ``slices`` by a hash of the row, the
    matching right rows are copied to every slice; all other keys join as usual. A caller
    that joins shrinking parts of one table passes the ``heavy`` keys of the whole.
    Sides that rows were repeated in are ``grown``: Spark takes them for as small as the table
    they came from, so they are merged and never sent to the driver for a broadcast.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    heavy = heavy_keys(left, on, min_rows) if heavy is None else heavy
    if not heavy:
        return left.join(right.hint("merge") if grown else right, on, how)
    schema = left.select(*on).schema
    marks = F.broadcast(left.sparkSession.createDataFrame(heavy, schema).na.drop().withColumn("_heavy", F.lit(True)))
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    slot = F.pmod(F.xxhash64(*left.columns), F.lit(slices)).cast("int")
    l = left.join(marks, on, "left").withColumn("_slice", F.when(F.col("_heavy") | no_key, slot).otherwise(0)).drop("_heavy")
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))
    r = right.join(marks, on, "left").withColumn("_slice", F.explode(copies)).drop("_heavy")
    return l.join(r.hint("merge") if grown else r, [*on, "_slice"], how).drop("_slice")


def match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi-join in which null keys meet null keys, so that no group gets lost."""
    renamed = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(renamed, same).drop(*[f"_on_{c}" for c in on])
