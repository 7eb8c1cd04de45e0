"""What the training-data operators share: reading documents, words, slices of Arrow batches, shared files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LONG_WORD = 64  # bytes; longer words are hashed one by one


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty), so that other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_part(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``_part``: empty, or the text's SHA-256 where a doc_id is on several rows, so that (doc_id, _part) names one text."""
    key = F.col(id_col).cast("long")
    again = cut_lineage(df.select(key.alias("_again")).where("_again is not null").groupBy("_again").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again"))
    if not again.limit(1).count():
        return df.withColumn("_part", F.lit(""))
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return df.join(again, key == F.col("_again"), "left").withColumn("_part", F.when(F.col("_again").isNotNull(), sha).otherwise("")).drop("_again")


def id_text_part(marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_and_text`` of a table ``with_part``, and ``part``."""
    return marked.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("_part").alias("part"))


def one_text_each(docs: DataFrame) -> DataFrame:
    """The rows of ``id_text_part`` without those that repeat both doc_id and text."""
    again = docs.where("part <> ''")
    if not again.limit(1).count():
        return docs
    return docs.where("part = ''").unionByName(again.dropDuplicates(["doc_id", "part"]))


def plain_words(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, unchanged; ``bytes.split`` cuts at the characters that ``WORDS`` leaves out and at no others."""
    return text.split()


def folded_words(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case; ``bytes.lower`` changes nothing else."""
    return text.lower().split()


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_places(texts: list[bytes]):
    """(row, first, end, cuts): the texts in one row, where each word begins and ends in it, and each text's range of words."""
    import numpy as np

    row = b" %b%b" % (b" ".join(texts), b" " * 9)  # a hash reads 8 bytes at a time
    raw = np.frombuffer(row, np.uint8)
    inside = (raw != 32) & ((raw - np.uint8(9)) > 4)
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first = turns[::2]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return row, first, turns[1::2], np.concatenate([[0], np.searchsorted(first, ends)])


def place_hashes(row: bytes, first, end, foreign=None):
    """64-bit hash of each word of ``word_places``, 8 bytes of all words at a time; in ``foreign``, one per word, the highest
    bit of any byte that is set where a word is more than ASCII."""
    import numpy as np
    import xxhash

    eight = np.ndarray((len(row) - 7,), "<u8", row, strides=(1,))
    masks = np.array([*((1 << 8 * n) - 1 for n in range(8)), (1 << 64) - 1], np.uint64)
    at, left, which = first, end - first, None
    out = _mix(left.astype(np.uint64))
    for _ in range(0, LONG_WORD, 8):
        chunk = eight[at] & masks[np.minimum(left, 8)]
        if foreign is not None:
            if which is None:
                foreign |= chunk
            else:
                foreign[which] |= chunk
        mine = out if which is None else out[which]
        mine = _mix(mine * np.uint64(0x9E3779B97F4A7C15) + chunk)
        if which is None:
            out = mine
        else:
            out[which] = mine
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        at, left = at[more] + 8, left[more] - 8
        which = more if which is None else which[more]
    for i in which.tolist():
        word = row[first[i] : end[i]]
        out[i] = xxhash.xxh3_64_intdigest(word)
        if foreign is not None and not word.isascii():
            foreign[i] |= np.uint64(128)
    return out


def word_hashes(texts: list[bytes]) -> list:
    """The 64-bit hashes of each text's words, in order."""
    row, first, end, cuts = word_places(texts)
    every = place_hashes(row, first, end)
    return [every[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` in sum, or of one row: what a task holds as Python objects stays small."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def rows_of(batches, limit: int = 4 << 20, as_bytes: bool = True, more: tuple = ()) -> Iterator[tuple[list, ...]]:
    """(ids, texts) and the columns ``more`` of Arrow batches with the columns of ``id_and_text``, a few MB of text at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_pylist()
        for a, b in slices(sizes, limit):
            part = batch.slice(a, b - a)
            text = part.column("text")
            yield part.column("doc_id").to_pylist(), (text.cast(pa.binary()) if as_bytes else text).to_pylist(), *[part.column(c).to_pylist() for c in more]


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``packed`` in place of ``text``: whole texts as deflated UTF-8, half the bytes of what a shuffle makes of plain text."""
    others = [c for c in docs.columns if c != "text"]

    def work(batches):
        import zlib

        import pyarrow as pa
        import pyarrow.compute as pc

        release()
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column("text")).to_pylist(), 4 << 20):
                part = batch.slice(a, b - a)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([zlib.compress(t, 3) for t in texts], pa.binary())], [*others, "packed"])

    return docs.mapInArrow(work, StructType([*docs.select(others).schema.fields, StructField("packed", BinaryType())]))


def with_lists(texts: DataFrame, lists: DataFrame, by_part: bool) -> DataFrame:
    """All rows of ``texts`` and the list of each (null: none), dealt by doc_id alone, with nothing filtered or left out
    on the way: all joins of the same ``texts`` then read one shuffle of them. ``by_part``: lists are per (doc_id, part)."""
    there = lists.withColumnRenamed("doc_id", "_doc")
    match = F.col("doc_id") == F.col("_doc")
    if by_part:  # bounds instead of an equation, which would deal by part too
        there = there.withColumnRenamed("part", "_its")
        match = match & (F.col("part") >= F.col("_its")) & (F.col("part") <= F.col("_its"))
    return texts.join(there, match, "left").drop("_doc", "_its")


#: Anchors are told by their low 40 bits: they only choose what is compared, so two that meet by chance cost time and no result.
ANCHOR = (1 << 40) - 1


def unpacked(batch, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a batch with a column of ``packed``, about ``limit`` packed bytes at a time."""
    import zlib

    import pyarrow.compute as pc

    column = batch.column("packed")
    for a, b in slices(pc.binary_length(column).to_pylist(), limit):
        yield a, [zlib.decompress(x) for x in column.slice(a, b - a).to_pylist()]


def local_path(uri: str) -> str:
    """``file:`` URIs as the plain path that Arrow's file systems take; other stores unchanged."""
    return re.sub(r"^file:/+", "/", uri)


def file_system(uri: str):
    """(file system, path) of a folder in any store that Arrow opens."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _store() -> dict:
    import sys
    import types

    return sys.modules.setdefault("_likeness_kept", types.ModuleType("_likeness_kept")).__dict__.setdefault("objects", {})


def release(but: tuple | None = None) -> None:
    """At the start of a task: drops what earlier operators keep in this Python worker, and gives what they have freed
    back to the system. Workers live on from stage to stage, so an executor would hold the sum of all stages."""
    import ctypes

    store = _store()
    for key in [k for k in store if k != but]:
        del store[key]
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def kept(key: tuple, make):
    """An object that a Python worker keeps between tasks (a vocabulary and what it remembers) until another operator's task begins."""
    release(key)
    store = _store()
    if key not in store:
        store[key] = make()
    return store[key]
