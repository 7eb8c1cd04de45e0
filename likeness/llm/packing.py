"""Packing by power-of-two decomposition: no sequence holds two documents, and none needs padding.

A document of n ids becomes pieces of ``size`` ids while they last and then one piece per binary
digit of the rest, longest first. Pieces of one length form a bucket; sequences are numbered
bucket by bucket (longest first) and by document inside, so a batch is a range of sequence ids of
one length. A document is cut where it stands; nothing is grouped by document.

Null and empty texts are a document of the end id alone. Rows that repeat a doc_id are documents
of their own side by side. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rows import ordered_index
from ..session import cut_lineage
from .common import id_and_text, kept, rows_of
from .tokens import BARE_WORDS, ChunkEncoder

SIZE, DOC_END = 2048, 1


def piece_lengths(n: int, size: int = SIZE) -> list[int]:
    """Lengths whose sum is n: ``size`` as often as possible, then falling powers of two."""
    rest = n % size
    return [size] * (n // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(df: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = DOC_END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if wanted, ids (little-endian unsigned 32-bit), one row per piece, without a shuffle."""
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        enc = kept(("bare", tokenizer), lambda: ChunkEncoder(tokenizer, BARE_WORDS, folds=True))
        end = np.array([end_id], "<u4").tobytes()
        for docs, texts in rows_of(batches, 1 << 20, as_bytes=False):  # a text's chunks take ten times its bytes
            out = []
            for doc, coded in zip(docs, enc.encode(texts)):
                coded += end
                n, at = len(coded) // 4, 0
                for k in piece_lengths(n, size):
                    part = coded[4 * at : 4 * (at + k)]
                    out.append((doc, at, k, zlib.crc32(part), n, part if with_ids else None))
                    at += k
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 5, pa.binary()))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    out = id_and_text(df, id_col, text_col).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return out if with_ids else out.drop("ids")


def pack(df: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = DOC_END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with ``sequence_id`` (dense, from 0) and ``offset`` (0: every piece fills a sequence of its length)."""
    cutted = cut_lineage(pieces(df, tokenizer, size, end_id, with_ids, id_col, text_col))
    numbered = ordered_index(cutted.withColumn("_bucket", -F.col("length")), [], ["_bucket", "doc_id", "start", "ids_crc32"], "sequence_id")
    return numbered.drop("_bucket").withColumn("sequence_id", F.col("sequence_id").cast("long")).withColumn("offset", F.lit(0).cast("long"))
