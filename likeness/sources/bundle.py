"""Reading and writing tables: CSV, Parquet, one folder per table, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import DATE_FORMAT, TIMESTAMP_FORMAT, format_datetime
from ..functions.text import finite, quote


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False, escaped: bool = False) -> DataFrame:
    """CSV with a header. Without a schema the types are sniffed, which reads the data twice.

    ``escaped`` undoes the line-break escapes of ``write_tables``, whose files hold one row per line and
    stay splittable. ``multi_line`` reads foreign files with line breaks inside quotes; such a file
    is read by one task.
    """
    r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    return _unescaped(df) if escaped else df


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _escaped(df: DataFrame) -> DataFrame:
    """Backslashes and line breaks of text columns as two characters."""

    def one(c: str):
        out = F.replace(F.col(quote(c)), F.lit("\\"), F.lit("\\\\"))
        for plain, mark in (("\n", "\\n"), ("\r", "\\r")):
            out = F.replace(out, F.lit(plain), F.lit(mark))
        return out

    return df.withColumns({c: one(c) for c in _texts(df)}) if _texts(df) else df


def _unescaped(df: DataFrame) -> DataFrame:
    """Escapes are split off at doubled backslashes first, so that a written backslash and n stay apart from a line break."""

    def one(c: str):
        parts = F.transform(F.split(F.col(quote(c)), r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
        return F.when(F.contains(F.col(quote(c)), F.lit("\\")), F.array_join(parts, "\\")).otherwise(F.col(quote(c)))

    return df.withColumns({c: one(c) for c in _texts(df)}) if _texts(df) else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table out again when it arrives in fewer pieces than there are cores; larger tables stay as they are."""
    cores = int(df.sparkSession.conf.get("spark.sql.leafNodeDefaultParallelism", None) or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df


def head(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first rows in a given order, or any ``n`` rows."""
    return (df.orderBy(*order) if order else df).limit(max(1, int(n)))


def finite_rows(df: DataFrame) -> DataFrame:
    """NaN and infinities of float columns become null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: finite(F.col(quote(n))) for n in floats}) if floats else df


def preview(df: DataFrame, rows: int = 25, order: list[str] | None = None) -> DataFrame:
    """The first ``rows`` rows ready for display."""
    return finite_rows(head(df, rows, order))


def is_datetime(config: dict) -> bool:
    dtype = str(config.get("data_type") or "").upper()
    return str(config.get("generator_type") or "").strip().lower() == "datetime" or "DATE" in dtype or "TIME" in dtype


def format_dates(df: DataFrame, configs: list[dict]) -> DataFrame:
    """Date and time columns as text in their configured output format (CSV output only)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    changed = {}
    for cfg in configs:
        name = str(cfg.get("column_name") or "")
        if name not in kinds or not is_datetime(cfg):
            continue
        dtype = str(cfg.get("data_type") or "").upper()
        default = DATE_FORMAT if "DATE" in dtype and "TIME" not in dtype else TIMESTAMP_FORMAT
        fmt = str(cfg.get("output_format") or "").strip() or default
        changed[name] = format_datetime(F.col(quote(name)), fmt, kinds[name])
    return df.withColumns(changed) if changed else df


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", configs: dict[str, list[dict]] | None = None) -> None:
    """One folder per table under ``path``. CSV text keeps all characters: line breaks and backslashes are escaped, spaces at the ends stay."""
    for name, df in tables.items():
        if fmt == "csv":
            rows = _escaped(format_dates(df, (configs or {}).get(name, [])))
            keep = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
            rows.write.mode("overwrite").options(**keep).csv(f"{path}/{name}")
        elif fmt == "parquet":
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            raise ValueError(f"unknown format {fmt!r}")


def read_tables(spark: SparkSession, path: str, fmt: str, names: dict[str, T.StructType] | list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a written bundle; ``names`` may carry the schema of each CSV table."""
    if names is None:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())
    schemas = names if isinstance(names, dict) else dict.fromkeys(names)
    if fmt == "csv":
        return {n: read_csv(spark, f"{path}/{n}", s, escaped=True) for n, s in schemas.items()}
    return {n: read_parquet(spark, f"{path}/{n}") for n in schemas}


def file_sizes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, path, size_bytes) of files; only the listing is read."""
    files = spark.read.format("binaryFile").load(paths)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(name.alias("name"), "path", F.col("length").alias("size_bytes"))
