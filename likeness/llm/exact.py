"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a table of (digest, keep_id), bucketed and sorted by digest. A load is reduced to
one row per digest, a sort-merge anti-join finds the digests that the index lacks, and only
those are appended. The index side of that join needs no shuffle, a load shuffles 40 bytes a
document, and hot digests shrink before any shuffle (partial aggregation).

Null and empty texts are equal. A digest already in the index keeps its first ``keep_id``. Rows
without a doc_id are reported; they stay only where no row of their group has one. Rows that
repeat a doc_id are judged by their own texts. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import shuffle_width
from ..session import cut_lineage, work_folder
from .common import SPACES, id_and_text


def _digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, SPACES, " "), 256)


def text_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of the text with each run of white space as one space."""
    docs = id_and_text(df, id_col, text_col)
    return docs.select("doc_id", _digest(F.col("text")).alias("digest"))


class DigestIndex:
    """Digests seen so far, in a bucketed table that outlives the load.

    ``location`` is the folder of the table (default: a new one below ``spark.checkpoint.dir``);
    ``buckets`` is fixed at creation. Adding a load twice changes nothing.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, location: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.location = location or work_folder(spark, "digests")
        self.buckets = buckets or shuffle_width(spark.range(0))
        if not spark.catalog.tableExists(self.name):
            self._append(spark.createDataFrame([], "digest string, keep_id long"))

    def _append(self, rows: DataFrame) -> None:
        (
            rows.write.format("parquet").mode("append").option("path", self.location)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append what is new and return one row per document: doc_id, digest, keep_id, group_size (in this load), kept."""
        digests = cut_lineage(text_digests(df, id_col, text_col))
        groups = cut_lineage(digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")))
        self._append(groups.join(self.table().hint("merge"), "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id")))
        found = groups.select("digest", "group_size").join(self.table().hint("merge"), "digest")
        return (
            digests.join(found.hint("merge"), "digest")  # a hot digest is split by the adaptive skew join
            .select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
        )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, judged against a new index."""
    seen = DigestIndex(df.sparkSession).add(df, id_col, text_col)
    stay = seen.where("kept").select(F.col("doc_id").alias("_stay_id"), F.col("digest").alias("_stay_digest")).distinct()
    same_id = F.col(id_col).cast("long").eqNullSafe(F.col("_stay_id"))  # rows without an id meet too
    return df.join(stay, same_id & (_digest(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_stay_digest")), "left_semi")
