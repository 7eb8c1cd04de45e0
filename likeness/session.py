"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "likeness", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LIKENESS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in extra.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def session_with(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of the same application that differs from the given one in these SQL settings only."""
    other = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in settings.items():
        other.conf.set(key.replace("__", "."), value)
    return other


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="likeness-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def _session_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/likeness-{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, below the checkpoint folder and so shared by all machines."""
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_work_folders(spark: SparkSession) -> None:
    """Remove what this session wrote; DataFrames made from it can no longer be used."""
    remove_folder(spark, _session_folder(spark))


def _hadoop_path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove_folder(spark: SparkSession, folder: str) -> None:
    files, path = _hadoop_path(spark, folder)
    files.delete(path, True)


def written_folders(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers n of the completely written tables ``prefix=n`` in a folder, in order."""
    files, path = _hadoop_path(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith(f"{prefix}=")]
    return sorted(int(p.getName().split("=")[1]) for p in names if files.exists(p.suffix("/_SUCCESS")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a written table: computed once, safe when executors are lost.

    A written table is preferred to ``checkpoint()``, which computes the last stage twice
    and leaves the optimizer without a size for the joins that follow.
    """
    path = work_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*calls: Callable[[], object], at_once: int = 4) -> list:
    """Results of independent driver calls; their Spark jobs run side by side."""
    if len(calls) < 2:
        return [c() for c in calls]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda c: c(), calls))
