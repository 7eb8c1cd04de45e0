"""Repeated passages by recompression of word sequences.

A round first names maximal runs of one symbol, then splits the symbols into left and right ones by
a bit of their name and names every pair (left, right). A name is a hash of what it stands for,
so all tasks give equal substrings equal names without a shared dictionary and without a shuffle.
Names near the rim of a substring depend on what stands next to it; for every symbol the range of
words that its making looked at is kept, and inside that range the naming is the same wherever
those words occur. A window of 13 words is therefore found by its *anchor*: of the symbols of the
highest round whose range lies inside the window, the one with the smallest name. (A window
without such a symbol, for instance inside a long run, is its own anchor.) Equal windows have
equal anchors, so only windows whose anchor occurs in two documents can repeat; those are
compared by a hash of their 13 words.

A word goes if a window over it also starts in a document with a smaller doc_id, judged on the
input. Null texts have no words. Rows without a doc_id are left alone and no source. Rows that
repeat a doc_id are no source for each other; each is cut by its own text, so places are kept by
(doc_id, part). Hot anchors and windows are settled inside each
batch first, so a batch sends at most one row of each to the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import cut_lineage
from .common import ANCHOR, _mix, id_text_part, one_text_each, packed, plain_words, release, rows_of, unpacked, with_lists, with_part, word_hashes
from .hyperminhash import _constants

WINDOW = 13
ROUNDS = 2
NONE = (1 << 64) - 1


def _round(sym, begin, end, low, high, salt):
    """One round of run and pair naming over symbols with spans [begin, end) and ranges [low, high)."""
    import numpy as np

    u = np.uint64
    # runs
    heads = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
    tails = np.concatenate([heads[1:], [len(sym)]]) - 1
    count = (tails - heads + 1).astype(u)
    name = np.where(count > 1, _mix(sym[heads] ^ _mix(count + salt)), sym[heads])
    # a run is known to end where its neighbours are known
    lo = np.concatenate([[low[0] - 1], low[heads[1:] - 1]])
    hi = np.concatenate([high[tails[:-1] + 1], [high[-1] + 1]])
    lo, hi = np.minimum(lo, low[heads]), np.maximum(hi, high[tails])
    begin, end, sym = begin[heads], end[tails], name
    # pairs
    left = (_mix(sym + salt) >> u(63)) == 0
    first = left[:-1] & ~left[1:]
    paired_next = np.concatenate([first, [False]])
    paired_before = np.concatenate([[False], first])
    after_hi = np.concatenate([hi[1:], [hi[-1] + 1]])
    after_lo = np.concatenate([lo[1:], [lo[-1]]])
    before_lo = np.concatenate([[lo[0] - 1], lo[:-1]])
    before_hi = np.concatenate([[hi[0]], hi[:-1]])
    # a left symbol looked at the one after it, a right symbol at the one before
    lo = np.minimum(lo, np.where(left, after_lo, before_lo))
    hi = np.maximum(hi, np.where(left, after_hi, before_hi))
    after = np.concatenate([sym[1:], [u(0)]])
    end = np.where(paired_next, np.concatenate([end[1:], end[-1:]]), end)
    hi = np.where(paired_next, np.maximum(hi, np.concatenate([hi[1:], hi[-1:]])), hi)
    lo = np.where(paired_next, np.minimum(lo, np.concatenate([lo[1:], lo[-1:]])), lo)
    sym = np.where(paired_next, _mix(sym * u(0x9E3779B97F4A7C15) + _mix(after ^ salt)), sym)
    keep = ~paired_before
    return sym[keep], begin[keep], end[keep], lo[keep], hi[keep]


def window_hashes(h, size: int, seed: int):
    """64-bit hash of each run of ``size`` words."""
    import numpy as np

    n = len(h) - size + 1
    out = np.full(max(n, 0), np.uint64(seed))
    for i in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def _least_inside(key, low, high, n: int, size: int, best) -> None:
    """Lowers ``best`` (one value per window) to the least key whose range [low, high) lies in the window."""
    import numpy as np

    width = high - low
    for w in range(1, size + 1):
        mine = np.flatnonzero(width == w)
        if not len(mine):
            continue
        at = np.full(n + size, NONE)  # keys by the first word of their range
        np.minimum.at(at, low[mine], key[mine])
        reach, wide = 1, size - w + 1  # ranges may start at that many places of a window
        while reach * 2 <= wide:
            at = np.minimum(at[:-reach], at[reach:])
            reach *= 2
        if wide > reach:
            at = np.minimum(at[: reach - wide], at[wide - reach :])
        np.minimum(best, at[:n], out=best)


def anchors(h, size: int = WINDOW, rounds: int = ROUNDS):
    """The anchor (40 bits) of each window of ``size`` words; ``h`` are the words' hashes."""
    import numpy as np

    u = np.uint64
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, u)
    at = np.arange(len(h), dtype=np.int64)
    best = np.full(n, NONE)
    sym, begin, end, low, high = h, at, at + 1, at, at + 1
    salts = _constants(rounds, 5)
    for r in range(rounds):
        sym, begin, end, low, high = _round(sym, begin, end, low, high, salts[r])
        ok = (high - low <= size) & (low >= 0) & (high <= len(h))
        s, lo, hi = sym[ok], low[ok], high[ok]
        # the range's words are part of the key: they are the same wherever the symbol is found
        rim = _mix(h[lo] ^ _mix(h[hi - 1] + (hi - lo).astype(u)))
        key = (_mix(s ^ rim) >> u(3)) | u((rounds - 1 - r) << 61)  # higher rounds sort first
        _least_inside(key, lo, hi, n, size, best)
    alone = best == NONE
    if alone.any():
        best[alone] = window_hashes(h, size, 7)[alone] >> u(1) | u(1 << 63)
    return best & u(ANCHOR)


def joined(hashes: list, size: int):
    """Word hashes of several documents in a row with a mark of its own after each, and the place of each document.

    A window or range over a mark belongs to no document, so what lies inside one is as if it stood alone.
    """
    import numpy as np

    lengths = np.array([len(h) for h in hashes], np.int64)
    ends = np.cumsum(lengths + 1)
    out = np.empty(int(ends[-1]) + size, np.uint64)
    marks = np.concatenate([ends - 1, np.arange(int(ends[-1]), len(out))])
    inside = np.ones(len(out), bool)
    inside[marks] = False
    out[inside] = np.concatenate(hashes)
    out[marks] = _mix(np.arange(len(marks), dtype=np.uint64) + np.uint64(1 << 40))
    return out, ends - 1 - lengths


def _anchors_of(size: int):
    """Function from texts to the anchors of each."""

    def of(texts: list[bytes]) -> list:
        h = word_hashes(texts)
        row, places = joined(h, size)
        every = anchors(row, size)
        return [every[p : p + max(0, len(x) - size + 1)] for p, x in zip(places, h)]

    return of


def _settled_first(key, doc):
    """(first, settled): whether a row is the only one that its batch sends for the key; the key's smallest doc in the batch, per row; whether it has two docs."""
    import numpy as np

    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.cumsum(head) - 1
    starts = np.flatnonzero(head)
    ends = np.concatenate([starts[1:], [len(k)]]) - 1
    least, several = np.empty(len(k), doc.dtype), np.empty(len(k), bool)
    first = np.empty(len(k), bool)
    least[order], several[order], first[order] = d[starts][group], (d[starts] != d[ends])[group], head
    return first, least, several


def _columns(names, kinds, arrays):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names)


def shared_anchors(docs: DataFrame, find, limit: int = 8 << 20) -> DataFrame:
    """(doc_id, keys): the anchors of each document that another document has too.

    ``find()`` returns a function from texts to the anchors of each. A batch sends one row per anchor to
    the shuffle; further documents of the batch with that anchor are settled at once and travel apart.
    """

    def settled(keys, owner):
        import numpy as np
        import pyarrow as pa

        key, doc = np.concatenate(keys), np.concatenate(owner)
        first, _, several = _settled_first(key, doc)
        salt = np.where(first, 0, 1 + (_mix(doc.view(np.uint64) ^ key) >> np.uint64(48)).astype(np.int64)).astype(np.int32)
        return _columns(["key", "salt", "doc_id", "known"], [pa.int64(), pa.int32(), pa.int64(), pa.bool_()], [key.view(np.int64), salt, doc, several])

    def work(batches):
        import numpy as np

        release()
        of = find()
        keys, owner, held = [], [], 0
        for ids, texts in rows_of(batches, 2 << 20):
            for doc, all_keys in zip(ids, of(texts)):
                if doc is not None and len(all_keys):
                    k = np.unique(all_keys)
                    keys.append(k)
                    owner.append(np.full(len(k), doc, np.int64))
            held += sum(map(len, texts))
            if held >= limit and keys:
                yield settled(keys, owner)
                keys, owner, held = [], [], 0
        if keys:
            yield settled(keys, owner)

    rows = docs.mapInArrow(work, "key long, salt int, doc_id long, known boolean")
    w = Window.partitionBy("key", "salt").orderBy("doc_id")
    shared = rows.withColumn("near", F.lag("key").over(w).isNotNull() | F.lead("key").over(w).isNotNull()).where("known or near")
    return shared.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # as many as the document has windows at most


def word_counts(df: DataFrame) -> DataFrame:
    """doc_id, part, n_words, sha: SHA-256 of the words joined by one space."""

    def work(batches):
        import hashlib

        import pyarrow as pa

        release()
        for ids, texts, parts in rows_of(batches, 1 << 20, more=("part",)):
            words = [plain_words(t) for t in texts]
            yield _columns(["doc_id", "part", "n_words", "sha"], [pa.int64(), pa.string(), pa.int64(), pa.string()], [ids, parts, [len(w) for w in words], [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]])

    return df.mapInArrow(work, "doc_id long, part string, n_words long, sha string")


def _window_rows(size: int):
    """Python part of the second pass: candidate windows of a document with its shared anchors."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        release()
        w1, w2, docs, at, texts_of, parts = [], [], [], [], [], []

        def flush():
            a, b, d, p, t = (np.concatenate(x) for x in (w1, w2, docs, at, texts_of))
            _, least, _ = _settled_first(a, d)
            own = least == d
            n = np.ones(len(a), np.int32)
            # windows that a smaller document of the batch has are settled: neighbours become one row
            gone = np.flatnonzero(~own)
            new = np.concatenate([[True], (t[gone[1:]] != t[gone[:-1]]) | (p[gone[1:]] != p[gone[:-1]] + 1)]) if len(gone) else np.zeros(0, bool)
            heads = gone[new]
            n[heads] = np.diff(np.append(np.flatnonzero(new), len(gone)))
            stay = own.copy()
            stay[heads] = True
            a, b, d, p, t, n, own = (x[stay] for x in (a, b, d, p, t, n, own))
            salt = np.where(own, 0, 1 + (_mix(d.view(np.uint64) ^ a) >> np.uint64(48)).astype(np.int64)).astype(np.int32)
            part = pa.array(parts, pa.string()).take(pa.array(t))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            out = _columns(["w1", "w2", "salt", "doc_id", "part", "at", "n"], kinds, [a.view(np.int64), b, salt, d, part, p, n])
            for x in (w1, w2, docs, at, texts_of, parts):
                x.clear()
            return out

        held = 0
        for batch in batches:
            batch = batch.filter(batch.column("keys").is_valid())
            for x, texts in unpacked(batch):
                part = batch.slice(x, len(texts))
                ids, keys, marks = part.column("doc_id").to_numpy(), part.column("keys"), part.column("part")
                hashes = word_hashes(texts)
                row, places = joined(hashes, size)
                every, first, second = anchors(row, size), window_hashes(row, size, 8), window_hashes(row, size, 9)
                for i, (place, h) in enumerate(zip(places, hashes)):
                    wanted = keys[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    found = np.flatnonzero(np.isin(every[place : place + max(0, len(h) - size + 1)], wanted))
                    if len(found):
                        w1.append(first[place + found])
                        w2.append((second[place + found] >> np.uint64(33)).astype(np.int32))
                        docs.append(np.full(len(found), ids[i], np.int64))
                        at.append(found.astype(np.int32))
                        texts_of.append(np.full(len(found), len(parts), np.int32))
                        parts.append(marks[i].as_py())
                        held += len(found)
                if held > 300_000:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return work


def cover(positions, n: int, size: int, times=1):
    """Which of ``n`` places lie in a window of ``size`` that starts at one of ``positions``, or at one of the next ``times`` - 1 places."""
    import numpy as np

    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, positions, 1)
    np.add.at(edge, np.minimum(positions + times - 1 + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def _copies(counts: DataFrame, size: int) -> DataFrame:
    """``counts`` and ``copy``: whether a smaller document has the same words, at least a window of them."""
    least = counts.groupBy("sha").agg(F.min("doc_id").alias("least"))
    copy = (F.col("least") < F.col("doc_id")) & (F.col("n_words") >= size)
    return counts.join(least, "sha").withColumn("copy", F.coalesce(copy, F.lit(False)))


def _gone(docs: DataFrame, texts: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """doc_id, part, at, n: start words (and how many in a row) of the windows that a smaller document has; copies of a smaller document are left out.

    ``texts`` is ``packed(docs)``, with more columns if wanted."""

    def find():
        return _anchors_of(size)

    counts = counts.where("doc_id is not null")
    reps = counts.where(f"n_words >= {size}").groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    keys = shared_anchors(docs, find).join(reps, "doc_id", "left_semi")
    kinds = "w1 long, w2 int, salt int, doc_id long, part string, at int, n int"
    rows = with_lists(texts, keys, False).mapInArrow(_window_rows(size), kinds)
    w = Window.partitionBy("w1", "w2", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("source", F.first("doc_id").over(w)).where("salt > 0 or source < doc_id").select("doc_id", "part", "at", "n")


def _with_places(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """``texts`` and ``at``: the list of each text's rows of ``gone`` (null: none)."""
    return with_lists(texts, gone.repartition("doc_id").groupBy("doc_id", "part").agg(F.collect_list(F.struct("at", "n")).alias("at")), True)


def _left(text: bytes, at, size: int) -> tuple[int, bytes]:
    """Number of words that go by the list ``at``, and the others joined by one space."""
    import numpy as np

    words = plain_words(text)
    starts, times = (at.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
    gone = cover(starts, len(words), size, times)
    return int(gone.sum()), b" ".join([words[i] for i in np.flatnonzero(~gone)])


def strip(df: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per document."""

    def work(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(batch.column("at").is_valid())
            for x, texts in unpacked(batch):
                out = []
                for doc, part, text, at in zip(batch.column("doc_id").slice(x), batch.column("part").slice(x), texts, batch.column("at").slice(x)):
                    n, kept = _left(text, at, size)
                    out.append((doc.as_py(), part.as_py(), n, hashlib.sha256(kept).hexdigest()))
                yield _columns(["doc_id", "part", "n_removed", "kept_sha256"], [pa.int64(), pa.string(), pa.int64(), pa.string()], list(zip(*out)))

    docs = id_text_part(with_part(df, id_col, text_col), id_col, text_col)
    counts = cut_lineage(word_counts(docs))
    single = one_text_each(docs)
    texts = packed(single)
    cut = _with_places(texts, _gone(single, texts, counts, size)).mapInArrow(work, "doc_id long, part string, n_removed long, kept_sha256 string")
    return _copies(counts, size).join(cut, ["doc_id", "part"], "left").select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def stripped(df: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the repeated words taken out of the text; an untouched text keeps its bytes, a text without words left goes if it lost any.

    The rows travel once, deflated: what goes is told to each row by (doc_id, part), and copies of a smaller document lose all their windows."""
    others = [c for c in df.columns if c != text_col]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for x, texts in unpacked(batch):
                some = batch.slice(x, len(texts))
                ats, nulls, out, stay = some.column("at"), some.column("missing").to_pylist(), [], []
                for text, at, null in zip(texts, ats, nulls):
                    removed, kept = _left(text, at, size) if at.is_valid else (0, text)
                    stay.append(not removed or bool(kept))
                    out.append(None if null and not removed else kept)
                rest = some.column("rest")
                done = pa.RecordBatch.from_arrays([rest, pa.array(out, pa.binary()).cast(pa.string())], ["rest", "text"])
                yield done.filter(pa.array(stay, pa.bool_()))

    marked = with_part(df, id_col, text_col)
    docs = id_text_part(marked, id_col, text_col)
    # names of its own, so that columns cannot clash
    rest = F.struct(F.lit(0).cast("byte").alias("c"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("rest")
    texts = packed(marked.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("_part").alias("part"), F.col(text_col).isNull().alias("missing"), rest))
    counts = cut_lineage(word_counts(docs))
    copies = _copies(counts, size).where("copy").select("doc_id", "part", F.lit(0).alias("at"), (F.col("n_words") - (size - 1)).cast("int").alias("n")).distinct()
    found = _with_places(texts, _gone(one_text_each(docs), texts, counts, size).unionByName(copies))
    kept = found.mapInArrow(work, StructType([found.schema["rest"], StructField("text", StringType())]))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.c{others.index(c)}").alias(c) for c in df.columns])
