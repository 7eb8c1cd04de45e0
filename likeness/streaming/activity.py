"""Activity rollup as a stream: events and tokens per hour and action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_folder, work_folder, written_folders

_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
_PARTIAL = "hour timestamp_ntz, action string, events bigint, tokens bigint, late bigint, seen timestamp_ntz"


def prepare(events: DataFrame) -> DataFrame:
    """(at, action, tokens) of raw events; the token count comes from the JSON props."""
    return events.select(
        F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("action"), F.get_json_object("props", "$.k").try_cast("bigint").alias("tokens")
    )


def rollup(activity: DataFrame) -> DataFrame:
    """Events and token sum per hour and action; works on batches and streams."""
    g = activity.groupBy(F.window("at", "1 hour").alias("w"), "action").agg(F.count(F.lit(1)).alias("events"), F.sum("tokens").alias("tokens"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "action", "events", "tokens")


def _parts(spark: SparkSession, target: str) -> tuple[int, list[str]]:
    """The last batch that the newest compacted table holds (-1: none), and the folders that make up the whole."""
    compacted = written_folders(spark, target, "upto")
    last = compacted[-1] if compacted else -1
    fresh = [f"{target}/batch={n}" for n in written_folders(spark, target, "batch") if n > last]
    return last, ([f"{target}/upto={last}"] if compacted else []) + fresh


def _added(spark: SparkSession, folders: list[str]) -> DataFrame:
    rows = spark.read.schema(_PARTIAL).parquet(*folders) if folders else spark.createDataFrame([], _PARTIAL)
    return rows.groupBy("hour", "action").agg(F.sum("events").alias("events"), F.sum("tokens").alias("tokens"), F.sum("late").alias("late"), F.max("seen").alias("seen"))


def watermark(spark: SparkSession, folders: list[str], delay: str = "1 hour"):
    """Largest event time in written folders less the delay; None before the first event."""
    if not folders:
        return None
    return spark.read.schema(_PARTIAL).parquet(*folders).agg((F.max("seen") - F.expr(f"INTERVAL {delay}")).alias("w")).first()["w"]


def _is_closed(mark) -> Column:
    """Whether an hour had ended at a watermark."""
    return F.lit(False) if mark is None else F.coalesce(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(mark), F.lit(False))


def start(spark: SparkSession, source: DataFrame, target: str, checkpoint: str, delay: str = "1 hour", compact_every: int = 16):
    """Start the rollup of a streaming source; every micro-batch writes its own partial sums to its own folder.

    Sums can be added in any order, so no state is held and no event is lost. Events of an hour that had ended ``delay`` before the
    latest event of earlier batches are late: they are counted in the sums and apart in ``late``. After ``compact_every`` batches
    their sums go into one table ``upto=<batch>``, and what it holds is removed, so at most so many folders stay.

    A repeated batch overwrites its own folder, or does nothing when a compacted table holds it; a table counts only
    when it is whole, and what an ended run did not remove is not read. So a restart at any point changes nothing.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        last, folders = _parts(spark, target)
        if batch_id <= last:
            return
        mark = watermark(spark, [f for f in folders if f != f"{target}/batch={batch_id}"], delay)  # not from a first try of this batch
        sums = rollup(prepare(batch)).withColumn("late", F.when(_is_closed(mark), F.col("events")).otherwise(F.lit(0)).cast("bigint"))
        latest = batch.agg(F.max("ts")).first()[0]
        sums.withColumn("seen", F.lit(latest).cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if batch_id - last >= compact_every:
            compact(spark, target)

    return source.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, target: str) -> None:
    """One table of all sums so far, then the folders that it holds are removed."""
    fresh = written_folders(spark, target, "batch")
    last, folders = _parts(spark, target)
    if fresh and fresh[-1] > last:
        last = fresh[-1]
        _added(spark, folders).write.mode("overwrite").parquet(f"{target}/upto={last}")
    for prefix in ("batch", "upto"):
        for n in written_folders(spark, target, prefix):
            if n < last or (prefix == "batch" and n == last):
                remove_folder(spark, f"{target}/{prefix}={n}")


def result(spark: SparkSession, target: str) -> DataFrame:
    """The partial sums of all batches added up."""
    return _added(spark, _parts(spark, target)[1]).select("hour", "action", "events", "tokens")


def hours(spark: SparkSession, target: str, delay: str = "1 hour") -> DataFrame:
    """(hour, action, events, tokens, late, closed): the sums, how many events came late, and whether the hour has ended by the watermark."""
    folders = _parts(spark, target)[1]
    return _added(spark, folders).withColumn("closed", _is_closed(watermark(spark, folders, delay))).drop("seen")


def run(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 1) -> DataFrame:
    """Process all files of a folder that match and give the result."""
    source = spark.readStream.schema(_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    work = work_folder(spark, "rollup")
    start(spark, source, f"{work}/out", f"{work}/state").awaitTermination()
    return result(spark, f"{work}/out")
