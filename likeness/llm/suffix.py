"""Repeated byte strings by suffix sorting of shards.

A string of 50 bytes that occurs in two documents has, of its 16-byte grams, the same one of
smallest hash: its anchor. Anchors that only one document has rule their strings out. Of all other
strings the texts (a run of windows with one anchor is one piece) go to the shard of their anchor,
so equal strings meet whatever documents they come from. Windows of a *hot* anchor, which so many
documents have that their pieces would fill a shard, go by the hash of their 50 bytes instead: equal
windows still meet, different ones spread. A piece that a smaller document has as a whole is settled by looking it up. Of the others a shard keeps the windows whose
second anchor, the gram of greatest hash, two documents share as well; it sorts the suffixes of
these by induction (``induced``), and windows whose common prefix reaches 50 bytes are one string:
its smallest doc_id keeps it, all others lose those bytes.

Null texts are empty. Rows without a doc_id keep their text and are no source; rows that repeat a
doc_id are no source for each other, and each is cut by its own text. Strings never cross documents. Equal pieces of one batch
send one row to the shard and the others leave it as merged ranges, so a passage that a third of the documents share stays small there.
A shard's arrays (types, names, seeds, its output) are held in memory; only the queues go to files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import shuffle_width
from ..session import cut_lineage
from .common import ANCHOR, _mix, id_text_part, one_text_each, packed, release, slices, unpacked, with_lists, with_part
from .induced import sorted_suffixes
from .recompress import _columns, shared_anchors

WINDOW, GRAM = 50, 16
LONGEST = 64  # windows in one piece
BLOCK = 1 << 15  # grams that are hashed at once
HOT = 1_000  # documents an anchor must exceed, besides a quarter of an even shard, to be hot
SHARDS = 4  # per shuffle partition, so that a shard's queues rarely need their files
SHIFT = bytes((i + 1) % 256 for i in range(256))  # UTF-8 has no byte 255, so zero is free to end a piece


def anchors_of(texts: list[bytes]) -> list:
    """The anchors of each text; they are found in one row of all texts, and windows over a text's end are left out."""
    every = window_anchors(b"".join(texts) + b"\0" * WINDOW)
    out, at = [], 0
    for t in texts:
        out.append(every[at : at + max(0, len(t) - WINDOW + 1)])
        at += len(t)
    return out


def window_anchors(text: bytes, window: int = WINDOW, gram: int = GRAM, greatest: bool = False):
    """The least (or greatest) hash, its low 40 bits, of the 16-byte grams of each window."""
    import numpy as np

    pick = np.maximum if greatest else np.minimum
    n = len(text)
    if n < window:
        return np.zeros(0, np.uint64)
    words = np.ndarray((n - 7,), "<u8", text, strides=(1,))
    out = np.empty(n - window + 1, np.uint64)
    wide = window - gram + 1
    for a in range(0, len(out), BLOCK):  # a block at a time stays in the processor's cache
        b = min(a + BLOCK, len(out))
        m = b - a + wide - 1
        low = words[a : a + m] * np.uint64(0x9E3779B97F4A7C15)
        low += _mixed(words[a + 8 : a + 8 + m].copy())
        low = _mixed(low)
        reach = 1
        while reach * 2 <= wide:
            low = pick(low[:-reach], low[reach:])
            reach *= 2
        rest = wide - reach
        np.bitwise_and(pick(low[:-rest], low[rest:]) if rest else low, np.uint64(ANCHOR), out=out[a:b])
    return out


def _mixed(x):
    """``_mix`` in place."""
    import numpy as np

    some = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, np.uint64(shift), out=some)
        x ^= some
        if factor:
            x *= np.uint64(factor)
    return x


def _runs(texts: list[bytes], shared):
    """(row, begin, owner, key, first, last) of the runs of windows with one anchor that ``shared`` names for their text: the texts in one row,
    where each begins, and each run's text, anchor and windows (``last`` is the one after it). ``shared`` has sorted numbers of text and anchor."""
    import numpy as np

    row = b"".join(texts) + b"\0" * WINDOW
    every = window_anchors(row)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    stop = begin + np.maximum(sizes - (WINDOW - 1), 0)
    turn = np.ones(len(every), bool)
    np.not_equal(every[1:], every[:-1], out=turn[1:])
    turn[begin] = True
    turn[stop] = True  # windows over a text's end
    first = np.flatnonzero(turn)
    owner = np.searchsorted(begin, first, "right") - 1
    last, key = np.append(first[1:], len(every)), every[first]
    named = (owner << ANCHOR.bit_length()) | key.view(np.int64)
    at = np.minimum(np.searchsorted(shared, named), len(shared) - 1)
    mine = np.flatnonzero((shared[at] == named) & (first < stop[owner]))
    return row, begin, owner[mine], key[mine], first[mine], last[mine]


def window_keys(text: bytes, starts):
    """64-bit hash of the windows that start at ``starts``."""
    import numpy as np

    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    out = np.full(len(starts), np.uint64(11))
    for i in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[starts + i])
    return out


def _pieces(batches, hot):
    """Rows of pieces from documents with their shared anchors; windows of ``hot`` anchors are pieces of their own."""
    import numpy as np
    import pyarrow as pa

    names = ["key", "salt", "doc_id", "part", "at", "size", "piece"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def flush():
        key, row, at, size, number = (np.concatenate(x) for x in zip(*found))
        doc, part = np.array(docs, np.int64), pa.array(parts, pa.string())
        stays = _alone(number, doc[row])
        own, gone = np.flatnonzero(stays), np.flatnonzero(~stays)
        pieces = pa.array(places, pa.binary()).take(pa.array(number[own]))
        yield _columns(names, kinds, [key[own], np.zeros(len(own), np.int32), doc[row[own]], part.take(pa.array(row[own])), at[own], size[own], pieces])
        if len(gone):
            # what a smaller document of the batch has is told as ranges, dealt by document; pieces stand in order of their places
            row, at, end = row[gone], at[gone], at[gone] + size[gone]
            heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > end[:-1])]))
            row, at, size = row[heads], at[heads], end[np.append(heads[1:], len(end)) - 1] - at[heads]
            yield _columns(names, kinds, [(doc[row] * 31 + at) % 65_521, np.ones(len(row), np.int32), doc[row], part.take(pa.array(row)), at, size, pa.nulls(len(row), pa.binary())])

    release()
    found, docs, parts, places, held = [], [], [], {}, 0
    for batch in batches:
        batch = batch.filter(batch.column("keys").is_valid())
        ids, its, keys = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("keys")
        for x, raw in unpacked(batch, 1 << 18):
            mine = keys.slice(x, len(raw))
            count = np.diff(mine.offsets.to_numpy())
            shared = np.sort((np.repeat(np.arange(len(raw)), count) << ANCHOR.bit_length()) | mine.flatten().to_numpy(zero_copy_only=False))
            if not len(shared):
                continue
            text, begin, owner, key, first, last = _runs(raw, shared)
            often = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
            wide = np.where(often, 1, LONGEST)  # windows of hot anchors are pieces of their own
            count = -(-(last - first) // wide)
            which = np.repeat(np.arange(len(key)), count)
            step = np.arange(len(which)) - (np.cumsum(count) - count)[which]
            a = first[which] + step * wide[which]
            size = np.minimum(a + wide[which], last[which]) - a + WINDOW - 1
            key, owner, alone = key[which].view(np.int64), owner[which], np.flatnonzero(often[which])
            key[alone] = window_keys(text, a[alone]).view(np.int64)
            number = _numbered(places, [text[i:j] for i, j in zip(a.tolist(), (a + size).tolist())])
            found.append((key, owner + len(docs), a - begin[owner], size, number))
            docs += ids[x : x + len(raw)]
            parts += its[x : x + len(raw)]
            held += int(size.sum())
            if held > 16 << 20:
                yield from flush()
                found, docs, parts, places, held = [], [], [], {}, 0
    if found:
        yield from flush()


def contested(texts: list[bytes], key, doc):
    """(piece, first window, bytes) of the ranges of windows whose two anchors, the piece's ``key`` and the gram of
    greatest hash, two documents share. Equal windows share both, so a window outside of these has no equal."""
    import numpy as np

    sizes = np.array([len(t) for t in texts], np.int64)
    owner, first, stop, pair = [], [], [], []
    for x, y in slices(sizes.tolist(), 1 << 20):
        count = sizes[x:y] - (WINDOW - 1)
        begin, before = np.cumsum(sizes[x:y]) - sizes[x:y], np.cumsum(count) - count
        every = window_anchors(b"".join(texts[x:y]), greatest=True)
        mine = np.repeat(np.arange(y - x), count)
        at = np.arange(len(mine)) - before[mine]
        second = every[begin[mine] + at]
        head = np.flatnonzero(np.concatenate([[True], (second[1:] != second[:-1]) | (mine[1:] != mine[:-1])]))
        own = mine[head]
        owner.append(own + x)
        first.append(at[head])
        stop.append(at[np.append(head[1:], len(mine)) - 1] + 1)
        pair.append(_mix(key[x:y][own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second[head]))
    owner, first, stop, pair = map(np.concatenate, (owner, first, stop, pair))
    order = np.argsort(pair)
    d, heads = doc[owner[order]], np.flatnonzero(np.concatenate([[True], np.diff(pair[order]) != 0]))
    shared = np.empty(len(pair), bool)
    shared[order] = np.repeat(np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads), np.diff(np.append(heads, len(d))))
    owner, first, stop = owner[shared], first[shared], stop[shared]
    if not len(owner):
        return owner, first, stop
    heads = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (first[1:] != stop[:-1])]))  # neighbours are one range
    last = np.append(heads[1:], len(owner)) - 1
    return owner[heads], first[heads], stop[last] - first[heads] + WINDOW - 1


def _numbered(places: dict[bytes, int], texts: list[bytes]):
    """The number of each text: equal texts have one; ``places`` has those given so far."""
    import numpy as np

    return np.fromiter((places.setdefault(t, len(places)) for t in texts), np.int64, len(texts))


def _alone(number, doc):
    """Whether no smaller document has a piece of the same number."""
    import numpy as np

    least = np.full(int(number.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    return least[number] == doc


def _shard(batches):
    """Sorts the pieces of one partition; gives the bytes to remove as (doc_id, part, first, end)."""
    import os
    import tempfile

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names, kinds = ["doc_id", "part", "first", "end"], [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    release()
    which, keys, docs, parts, ats = [], [], [], [], []

    def told(own, first, end):
        """Rows of ranges of the pieces ``own``."""
        for a in range(0, len(own), 100_000):
            s = slice(a, a + 100_000)
            yield _columns(names, kinds, [doc[own[s]], part.take(pa.array(own[s])).combine_chunks(), first[s], end[s]])

    # a piece that a smaller document has as a whole is settled without being sorted
    places: dict[bytes, int] = {}  # each different piece is held once
    for batch in batches:
        own = batch.column("piece").is_valid()
        known = batch.filter(pc.invert(own))
        if known.num_rows:
            first = known.column("at").to_numpy()
            yield _columns(names, kinds, [known.column("doc_id"), known.column("part"), first, first + known.column("size").to_numpy()])
        mine = batch.filter(own)
        which.append(_numbered(places, mine.column("piece").to_pylist()))
        keys.append(mine.column("key").to_numpy())
        docs.append(mine.column("doc_id").to_numpy())
        parts.append(mine.column("part"))
        ats.append(mine.column("at").to_numpy())
    if not places:
        return
    key, doc, at, number = np.concatenate(keys), np.concatenate(docs), np.concatenate(ats), np.concatenate(which)
    part = pa.chunked_array(parts, pa.string())
    texts = list(places)
    del places
    alone = _alone(number, doc)
    left, settled = np.flatnonzero(alone), np.flatnonzero(~alone)
    yield from told(settled, at[settled], at[settled] + np.fromiter(map(len, texts), np.int64, len(texts))[number[settled]])
    texts = [texts[i] for i in number[left].tolist()]
    # only what may be in two documents is sorted
    piece, offset, size = contested(texts, key[left], doc[left])
    texts = [texts[i][a : a + n] for i, a, n in zip(piece.tolist(), offset.tolist(), size.tolist())]
    own, first = left[piece], at[left[piece]] + offset
    stays = _alone(_numbered({}, texts), doc[own])
    yield from told(own[~stays], first[~stays], (first + size)[~stays])
    texts = [t for t, s in zip(texts, stays.tolist()) if s]
    own, first, size = own[stays], first[stays], size[stays]
    if not texts:
        return
    begin = np.cumsum(size + 1) - (size + 1)
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:  # this task's spill, gone with the task
        path = os.path.join(folder, "text")
        with open(path, "wb") as f:
            for a in range(0, len(texts), 10_000):
                f.write(b"".join(t.translate(SHIFT) + b"\0" for t in texts[a : a + 10_000]))
            f.write(b"\0" * 8)
        del texts
        text = np.memmap(path, np.uint8, "r")
        whole = np.ones(len(text), bool)  # where a window begins
        for k in range(WINDOW):
            whole[begin + size - k] = False
        places, fresh = [], []
        for pos, lcp in sorted_suffixes(text, folder, WINDOW):
            mine = whole[pos]
            places.append(pos[mine])
            fresh.append(lcp[mine] < WINDOW)
    place, new = np.concatenate(places), np.concatenate(fresh)
    new[0] = True
    owner_doc = doc[own][np.repeat(np.arange(len(own), dtype=np.int32), size + 1)[place]]
    groups = np.flatnonzero(new)
    least_doc = np.minimum.reduceat(owner_doc, groups)
    gone = np.sort(place[np.repeat(least_doc, np.diff(np.append(groups, len(place)))) < owner_doc])
    if len(gone):
        heads = np.flatnonzero(np.concatenate([[True], np.diff(gone) > 1]))
        tails = np.append(heads[1:], len(gone)) - 1
        piece = np.searchsorted(begin, gone[heads], "right") - 1
        start = first[piece] + gone[heads] - begin[piece]
        yield from told(own[piece], start, start + gone[tails] - gone[heads] + WINDOW)


def _repeats(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, part, first, end: byte ranges (they may overlap) that a smaller document has too; whole copies of a smaller document are left out."""
    reps = docs.where(f"doc_id is not null and octet_length(text) >= {WINDOW}").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    keys = cut_lineage(shared_anchors(docs, lambda: anchors_of).join(reps, "doc_id", "left_semi"))
    return _piece_rows(texts, keys).repartition(SHARDS * shuffle_width(docs), "key", "salt").mapInArrow(_shard, "doc_id long, part string, first long, end long")


def hot_anchors(keys: DataFrame) -> list[int]:
    """Anchors that more documents have than ``HOT`` and than a quarter of an even shard: at most four per shard."""
    total = keys.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    limit = max(HOT, total // (4 * SHARDS * shuffle_width(keys)))
    counts = keys.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return [r["key"] for r in counts.where(F.col("n") > limit).select("key").collect()]


def _piece_rows(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """key, salt, doc_id, part, at, size, piece (null: a smaller document of the batch has it)."""
    hot = hot_anchors(keys)

    def work(batches):
        import numpy as np

        return _pieces(batches, np.array(hot, np.int64).view(np.uint64))

    return with_lists(texts, keys, False).mapInArrow(work, "key long, salt int, doc_id long, part string, at long, size long, piece binary")


def strip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed byte ranges): one row per document."""
    docs = id_text_part(with_part(df, id_col, text_col), id_col, text_col)

    def work(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(batch.column("ranges").is_valid())
            rows = zip(batch.column("doc_id"), batch.column("part"), (t for _, some in unpacked(batch) for t in some), batch.column("ranges"))
            out = []
            for doc, part, text, ranges in rows:
                raw = np.frombuffer(text, np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, ranges.values.field("first").to_numpy(), 1)
                np.add.at(edge, ranges.values.field("end").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"first": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]
                out.append((doc.as_py(), part.as_py(), int(gone.sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest(), spans))
            if out:
                yield _columns(["doc_id", "part", "n_removed", "kept", "spans"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))], list(zip(*out)))

    single = one_text_each(docs)
    texts = packed(single)
    ranges = _repeats(single, texts).repartition("doc_id").groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))
    cut = with_lists(texts, ranges, True).mapInArrow(work, "doc_id long, part string, n_removed long, kept string, spans array<struct<first:long,end:long>>")
    counts = docs.select("doc_id", "part", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    least = counts.groupBy("sha").agg(F.min("doc_id").alias("least"))
    copy = (F.col("least") < F.col("doc_id")) & (F.col("n_bytes") >= WINDOW)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end")))
    out = counts.join(least, "sha").join(cut, ["doc_id", "part"], "left").withColumn("spans", F.when(copy, whole).otherwise(F.coalesce("spans", F.slice(whole, 1, 0))))
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"), "spans",
    )
