import numpy as np
from pyspark.sql import functions as F

from likeness.operators import profile as P
from likeness.streaming import activity, running_profile


def parts(spark, tmp_path, n=4):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(n):
        e.where(F.floor((F.col("event_id") - 0) * n / 1000) == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    return e, str(tmp_path / "in" / "*")


def test_rollup_over_many_batches_equals_the_batch(spark, tmp_path):
    e, folder = parts(spark, tmp_path)
    got = activity.run(spark, folder, "*.parquet").orderBy("hour", "action").collect()
    want = activity.rollup(activity.prepare(e)).orderBy("hour", "action").collect()
    assert got == want


def test_restart_does_not_count_twice(spark, tmp_path):
    e, folder = parts(spark, tmp_path, 2)
    source = spark.readStream.schema(activity._SCHEMA).parquet(folder)
    for _ in range(2):
        activity.start(spark, source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert activity.result(spark, str(tmp_path / "out")).agg(F.sum("events")).first()[0] == e.count()


def test_running_profile_equals_one_profile(spark, tmp_path):
    e, folder = parts(spark, tmp_path)
    got = {r["column"]: r for r in running_profile.run(spark, folder, "*.parquet", e.schema).collect()}
    want = {r["column"]: r for r in P.profile(e).collect()}
    assert set(got) == set(want)
    for c, w in want.items():
        g = got[c]
        assert (g["nulls"], g["min"], g["max"], g["n"]) == (w["nulls"], w["min"], w["max"], w["total_rows"])
        assert abs(g["cardinality"] - w["cardinality"]) <= 0.05 * w["cardinality"] and (g["sd"] is None) == (w["sd"] is None)
        assert w["sd"] is None or np.isclose(g["sd"], w["sd"])


def test_compacted_sums_late_files_and_an_ended_run(spark, tmp_path):
    """Many files in mixed order, compaction every second batch: few folders, the batch answer; an ended run's leftovers change nothing."""
    from likeness.session import written_folders

    e, out = spark.read.parquet("/root/testdata/sf0.001/events.parquet"), str(tmp_path / "out")
    want = activity.rollup(activity.prepare(e)).orderBy("hour", "action").collect()
    for i in range(5):
        e.where(F.pmod(F.col("event_id"), F.lit(5)) == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        source = spark.readStream.schema(activity._SCHEMA).parquet(str(tmp_path / "in" / "*"))
        activity.start(spark, source, out, str(tmp_path / "state"), "30 days", 2).awaitTermination()
        assert len(written_folders(spark, out, "batch")) < 2 and len(written_folders(spark, out, "upto")) <= 1
    assert activity.result(spark, out).orderBy("hour", "action").collect() == want
    assert activity.hours(spark, out, "30 days").agg(F.sum("late")).first()[0] == 0
    # a run that ended between writing the compacted table and removing its parts, and one that wrote half a table
    activity.compact(spark, out)
    (last,) = written_folders(spark, out, "upto")
    spark.read.parquet(f"{out}/upto={last}").write.parquet(f"{out}/batch={last}")
    spark.read.parquet(f"{out}/upto={last}").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/upto={last + 1}")
    assert activity.result(spark, out).orderBy("hour", "action").collect() == want
    activity.compact(spark, out)
    assert written_folders(spark, out, "batch") == [] and activity.result(spark, out).orderBy("hour", "action").collect() == want
