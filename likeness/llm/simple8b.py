"""Token ids in files of 64-bit words: Simple-8b with escapes and per-block offsets.

A word is a 4-bit selector and 60 bits with as many equally wide ids as fit. A selector of its
own stands for an id that needs more than 60 bits; its payload is the place in the block's list of
literal ids, so words of a block can be decoded together, without reading them in order.

File layout, all little-endian: ``MAGIC``; the words of all blocks; the literals of all blocks;
the block index (first word, first literal, ids in the block); the document index (doc_id, ids
in the document); then 5 numbers: words, literals, blocks, documents, ids per full block.
A block is ``block`` ids of the file's id stream (the last one may be shorter).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import shuffle_width
from ..session import cut_lineage, work_folder
from .common import file_system, id_and_text, kept, rows_of
from .tokens import BYTE_LEVEL, ChunkEncoder

MAGIC = b"S8BTOK01"
#: (ids in a word, bits of each), by selector; selector 0 is the escape.
PACKS = [(1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
DOC_END = 2
#: Bits of the ids that two bytes hold.
SHORT = bytes(max(1, i.bit_length()) for i in range(1 << 16))


def _bits(ids):
    """Bits that each id needs, at least 1."""
    import numpy as np

    if ids.max(initial=0) < len(SHORT):
        return np.frombuffer(SHORT, np.uint8)[ids.astype(np.intp)]
    high = (ids >> np.uint64(32)).astype(np.float64)  # halves convert to floats without rounding
    out = np.frexp(np.where(high > 0, high, ids & np.uint64(0xFFFFFFFF)))[1]
    return np.maximum(out + 32 * (high > 0), 1).astype(np.uint8)


def _choices(bits, block: int):
    """For each position the selector of the widest word that can start there and stay in its block."""
    import numpy as np

    n = len(bits)
    left = np.resize(np.minimum(np.arange(block, 0, -1), 255).astype(np.uint8), n)  # 60 ids at most are asked for
    tail = min(n, block)
    left[n - tail :] = np.minimum(left[n - tail :], np.minimum(np.arange(tail, 0, -1), 255).astype(np.uint8))
    tops, width = {1: bits}, 1
    while width < 32:
        last = tops[width]
        wider = last.copy()
        if n > width:
            wider[: n - width] = np.maximum(last[: n - width], last[width:])
        tops[width * 2] = wider
        width *= 2
    sel = np.zeros(n, np.uint8)  # the escape where even one id does not fit
    for s in range(len(PACKS) - 1, 0, -1):  # few ids first, so more ids overwrite
        count, wide = PACKS[s]
        if count > n:
            continue
        p = 1 << (count.bit_length() - 1)
        top = tops[p].copy()
        if count > p:
            top[: n - count + p] = np.maximum(top[: n - count + p], tops[p][count - p :])
        sel[(top <= wide) & (left >= count)] = s
    return sel


def encode(ids, block: int = 4096):
    """(words, literals, block index as rows of first word, first literal, ids) of an id array."""
    import numpy as np

    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 3), np.uint64)
    sel = _choices(_bits(ids), block)
    counts = np.array([c for c, _ in PACKS])
    starts = np.arange(0, n, block)
    at, ends, hops = starts.copy(), np.minimum(starts + block, n), []
    lanes = np.arange(len(starts))
    while len(lanes):  # one word of every unfinished block at a time
        hops.append(at[lanes])
        at[lanes] += counts[sel[at[lanes]]]
        lanes = lanes[at[lanes] < ends[lanes]]
    heads = np.sort(np.concatenate(hops))
    kinds = sel[heads]
    words = kinds.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(PACKS)):
        mine = np.flatnonzero(kinds == s)
        count, wide = PACKS[s]
        for k in range(count):
            words[mine] |= ids[heads[mine] + k] << np.uint64(k * wide)
    escaped = np.flatnonzero(kinds == 0)
    first_word = np.searchsorted(heads, starts)
    first_literal = np.searchsorted(heads[escaped], starts)
    words[escaped] |= (np.arange(len(escaped)) - first_literal[heads[escaped] // block]).astype(np.uint64)
    return words, ids[heads[escaped]], np.stack([first_word, first_literal, ends - starts], 1).astype(np.uint64)


def decode(words, literals):
    """The ids of the words of whole blocks; ``literals`` are those of the first block on."""
    import numpy as np

    kinds = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in PACKS])[kinds]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in range(1, len(PACKS)):
        mine = np.flatnonzero(kinds == s)
        count, wide = PACKS[s]
        mask = np.uint64((1 << wide) - 1)
        for k in range(count):
            out[ends[mine] - count + k] = (words[mine] >> np.uint64(k * wide)) & mask
    escaped = np.flatnonzero(kinds == 0)
    if len(escaped):
        out[ends[escaped] - 1] = literals[: len(escaped)]  # literals stand in the order of their escapes
    return out


class _Writer:
    """One file: words go out as blocks fill; literals and indexes follow at the end."""

    def __init__(self, out, block: int):
        import numpy as np

        self.np, self.out, self.block = np, out, block
        self.rest, self.literals, self.blocks, self.docs, self.words = [np.zeros(0, np.uint64)], [], [], [], 0
        self.held = self.n_literals = 0
        out.write(MAGIC)

    def add(self, doc_id: int, ids) -> None:
        self.docs.append((doc_id, len(ids)))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 256 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        np = self.np
        ids = np.concatenate(self.rest).astype(np.uint64)
        cut = len(ids) if last else len(ids) // self.block * self.block
        words, literals, index = encode(ids[:cut], self.block)
        index[:, 0] += np.uint64(self.words)
        index[:, 1] += np.uint64(self.n_literals)
        self.out.write(words.astype("<u8").tobytes())
        self.words += len(words)
        self.n_literals += len(literals)
        self.literals.append(literals)
        self.blocks.append(index)
        self.rest, self.held = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        np = self.np
        self._flush(True)
        docs = np.array(self.docs, "<i8").reshape(-1, 2)
        blocks = np.concatenate(self.blocks)
        for part in (np.concatenate(self.literals), blocks):
            self.out.write(part.astype("<u8").tobytes())
        self.out.write(docs.tobytes())
        self.out.write(np.array([self.words, self.n_literals, len(blocks), len(docs), self.block], "<u8").tobytes())


def write_files(
    df: DataFrame, tokenizer: str, folder: str | None = None, files: int | None = None, end_id: int = DOC_END, block: int = 4096,
    id_col: str = "doc_id", text_col: str = "text", encoder=None,
) -> DataFrame:
    """Encode and write all documents in ascending doc_id order; returns the manifest (file, path, docs, tokens), a written table.

    One range of doc_ids per task and file. A file is written under a name of its own attempt and
    then renamed, so a repeated task leaves one whole file. Null texts are empty documents, rows
    that repeat a doc_id are documents side by side, rows without doc_id are not written.
    """
    spark = df.sparkSession
    folder = folder or work_folder(spark, "token-files")
    docs = id_and_text(df, id_col, text_col).where("doc_id is not null")
    placed = docs.repartitionByRange(files or shuffle_width(df), "doc_id").sortWithinPartitions("doc_id", "text")
    make = encoder or (lambda: kept(("byte", tokenizer), lambda: ChunkEncoder(tokenizer, BYTE_LEVEL)))

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, tokens, count, enc, end = None, 0, 0, None, end_id.to_bytes(4, "little")
        fs, top = file_system(folder)
        for ids, texts in rows_of(batches, as_bytes=False):
            if writer is None:
                enc = make()
                fs.create_dir(top, recursive=True)
                trial, path = f"{top}/.{part}-{uuid.uuid4().hex}", f"{top}/tokens-{part:06d}.s8b"
                out = fs.open_output_stream(trial)
                writer = _Writer(out, block)
            for doc, coded in zip(ids, enc.encode(texts)):
                row = np.frombuffer(coded + end, "<u4")
                writer.add(doc, row)
                tokens, count = tokens + len(row), count + 1
        if writer is not None:
            writer.close()
            out.close()
            fs.move(trial, path)
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "path": [path.rsplit("/", 1)[1]], "docs": [count], "tokens": [tokens]})

    manifest = cut_lineage(placed.mapInArrow(write, "file int, path string, docs long, tokens long"))
    return manifest.withColumn("path", F.concat(F.lit(folder + "/"), F.col("path")))


def read_files(manifest: DataFrame, step: int = 64) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it in all files), n_tokens, ids (little-endian unsigned 32-bit).

    A task reads ``step`` blocks at a time by the block index.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    size = f.size()
                    n_words, n_literals, n_blocks, n_docs, _ = np.frombuffer(f.read_at(40, size - 40), "<u8").astype(np.int64)
                    words_at = len(MAGIC)
                    literals_at = words_at + 8 * n_words
                    blocks_at = literals_at + 8 * n_literals
                    docs_at = blocks_at + 24 * n_blocks
                    blocks = np.frombuffer(f.read_at(24 * n_blocks, blocks_at), "<u8").astype(np.int64).reshape(-1, 3)
                    docs = np.frombuffer(f.read_at(16 * n_docs, docs_at), "<i8").reshape(-1, 2)
                    ends = np.vstack([blocks[:, :2], [[n_words, n_literals]]])
                    held, k, at = np.zeros(0, np.uint64), 0, base
                    for b in range(0, max(n_blocks, 1), step):
                        if n_blocks:
                            (w0, l0), (w1, l1) = ends[b], ends[min(b + step, n_blocks)]
                            words = np.frombuffer(f.read_at(8 * (w1 - w0), words_at + 8 * w0), "<u8")
                            literals = np.frombuffer(f.read_at(8 * (l1 - l0), literals_at + 8 * l0), "<u8")
                            held = np.concatenate([held, decode(words, literals)])
                        out, used = [], 0
                        while k < n_docs and used + docs[k, 1] <= len(held):
                            n = int(docs[k, 1])
                            out.append((int(docs[k, 0]), at, n, held[used : used + n].astype("<u4").tobytes()))
                            used, at, k = used + n, at + n, k + 1
                        held = held[used:]
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])

    wide = max(1, shuffle_width(manifest))
    return files.repartition(wide, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_files(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files and read them back."""
    return read_files(write_files(df, tokenizer, **options))


def query(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return token_files(docs, tokenizer).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
