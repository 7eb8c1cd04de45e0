"""The pipeline over ``documents``: each stage is one of the operators; its result is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from likeness.llm.queries import STAGES
from likeness.session import cut_lineage

#: Stages 1 and 3 to 5 (a trained model, sketches, tokenizers) cannot be said in SQL; tests compare the whole with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
