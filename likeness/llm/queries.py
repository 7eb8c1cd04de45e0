"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, crf, disclosure, exact, gru, hyperminhash, lookup, packing, pieces, quality, recompress, simple8b, suffix
from .common import documents


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_gru_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.query(spark, documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.groups(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.DigestIndex(spark).add(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h)
"""


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.strip(documents(spark, sf_dir))


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.strip(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), with_ids=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_centroid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.cluster(documents(spark, sf_dir, "embeddings")).drop("centroid")


def op12_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.sanitise(documents(spark, sf_dir), with_text=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


QUERIES = {
    "op1_gru_scoring": op1_gru_scoring, "op2_sentencepiece": op2_sentencepiece, "op3_simple8b": op3_simple8b, "op4_quality_rules": op4_quality_rules, "op5_hyperminhash": op5_hyperminhash,
    "op6_exact_dedup": op6_exact_dedup, "op7_suffix_array": op7_suffix_array, "op8_recompression": op8_recompression, "op9_packing": op9_packing, "op10_toxicity": op10_toxicity,
    "op11_centroid_tables": op11_centroid_tables, "op12_pii_disclosure": op12_pii_disclosure, "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op6_exact_dedup": OP6_SQL, "op11_centroid_tables": lookup.oracle(), "op13_filter_audit": audit.oracle()}

# --- stages of the corpus pipeline ------------------------------------------------------


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger rejects go."""
    return crf.clean(docs, documents(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return hyperminhash.deduplicate(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are taken out of the texts; a document of which nothing is left goes. ``n_chars`` follows the text."""
    return recompress.stripped(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length in sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), with_ids=False)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("substring_dedup", substring_stage), ("packing", packing_stage)]
