r"""Personal data, and the terms around it that give it away.

Protected entities are the values of four kinds of spans (email, ip, card, phone). A context is the
``REACH`` words before and after such a span. The corpus tells how strongly a term t reveals an
entity e: with documents counted by n,

    PMI(t; e) = log2(n(t, e) * n / (n(t) * n(e))),    IC(e) = log2(n / n(e)),

n(t, e) the documents with t in a context of e, n(t) all documents that hold t, n the documents.
A term discloses e when it gives nearly all of e's information, PMI >= ``ALPHA`` * IC(e), and more
than the entity's kind would, PMI > IC(kind), seen in at least ``SUPPORT`` documents. Such a term of a
context is a span of kind ``term`` wherever its document holds it. It is generalised to its first
four letters where those, counted in the same way, do not disclose e, and removed otherwise.

Words are runs without white space, in lower case, less the ASCII punctuation around them; words that
touch a base span, and words without a letter, are no terms. Documents without protected entities
have no terms to hide. Counts cover all rows: one number per term and group of texts is
shuffled, contexts only of documents with entities. Null texts are empty; rows that repeat a doc_id
or have none are documents of their own; an empty table gives no rows. Finding spans takes time in
proportion to the text, however long a run of digits or letters is.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..session import cut_lineage
from .common import id_and_text, rows_of

KINDS = ["email", "ip", "card", "phone", "term"]
REACH, ALPHA, SUPPORT, STEM = 8, 0.9, 2, 4
GROUP = 8 << 20  # bytes of text whose terms are counted before they are sent

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match that fails at the first digit of a run fails at all
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AROUND = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def emails(text: str):
    """(start, end) of addresses: each @ with a domain, back to the first character of its local part."""
    last = 0
    for m in DOMAIN.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            yield a, m.end()
            last = m.end()


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) in order; the value is the same for equal entities however they are written."""
    out = []
    if "@" in text:
        out += [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    for m in ADDRESS.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or "0") < 256 for p in parts):
            out.append((m.start(), 1, m.end(), ".".join(p or "0" for p in parts)))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = "".join(c for c in m.group() if "0" <= c <= "9")
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def span_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


class Terms(dict):
    """Word -> (hash of the term, hash of its first letters or 0), (0, 0) for a word that is no term; remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        t = word.lower().strip(AROUND)
        if not t or not any(map(str.isalpha, t)):
            got = 0, 0
        else:
            got = tuple(xxhash.xxh3_64_intdigest(x.encode()) >> 1 | 1 for x in ([t, t[:STEM] + "*"] if len(t) > STEM else [t])) + (0,)
        if len(self) < 500_000:
            self[word] = got[:2]
        return got[:2]


def words_apart(text: str, spans):
    """(start, end) of the words that touch none of ``spans`` (start, kind, end, ...), in order."""
    cuts: list[list[int]] = []  # spans as disjoint ranges
    for a, _, b, *_ in spans:
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], b)
        else:
            cuts.append([a, b])
    starts = [a for a, _ in cuts]
    out = []
    for m in WORD.finditer(text):
        i = bisect_right(starts, m.end() - 1) - 1
        if i < 0 or cuts[i][1] <= m.start():
            out.append(m.span())
    return out


def contexts(text: str, spans, known: Terms, reach: int = REACH) -> dict[tuple[int, str], set[int]]:
    """Hashes of the terms (whole, and their first letters) around each entity of a text."""
    places = words_apart(text, spans)
    starts = [a for a, _ in places]
    out: dict[tuple[int, str], set[int]] = {}
    for a, kind, b, value in spans:
        i = bisect_right(starts, a)
        near = places[max(0, i - reach) : i]
        j = bisect_right(starts, b - 1)
        near = near + places[j : j + reach]
        out.setdefault((kind, value), set()).update(h for x, y in near for h in known[text[x:y]] if h)
    return out


def entity_key(kind: int, value: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode()) >> 1


def _found(batches, reach: int):
    """One row per document (its spans; its text where it has entities) and, from the same pass, rows of contexts and of term counts."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["row", "doc_id", "text", "spans", "entity", "kind", "near", "terms", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    serial, known, seen, held = TaskContext.get().partitionId() << 33, Terms(), [], 0

    def counted():
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        rows = [(*[None] * 7, h[a : a + 100_000], n[a : a + 100_000]) for a in range(0, len(h), 100_000)]
        return batch_of(rows)

    def batch_of(rows):
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for ids, texts in rows_of(batches, 2 << 20, as_bytes=False):
        out = []
        for doc, text in zip(ids, texts):
            spans = base_spans(text)
            out.append((serial, doc, text if spans else None, [x for a, k, b, _ in spans for x in (a, k, b)], *[None] * 5))
            if spans:
                for (kind, value), near in contexts(text, spans, known, reach).items():
                    out.append((serial, *[None] * 3, entity_key(kind, value), kind, sorted(near), None, None))
            both = np.array([known[w] for w in set(WORD.findall(text))], np.int64).reshape(-1)
            seen.append(np.unique(both[both > 0]))
            held += len(text) + 64
            serial += 1
        yield batch_of(out)
        if held >= GROUP:
            yield counted()
            seen, held = [], 0
    if seen:
        yield counted()


def disclosing(near: DataFrame, entities: DataFrame, terms: DataFrame, n: int, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(entity, h, pmi, ic): the terms that reveal an entity.

    ``near``: (row, entity, h) of contexts; ``entities``: (row, entity, kind); ``terms``: (h, n_term) of all documents.
    """
    of_kind = {r["kind"]: r["n"] for r in entities.groupBy("kind").agg(F.count_distinct("row").alias("n")).collect()}  # four kinds
    allowed = F.coalesce(*[F.when(F.col("kind") == k, F.log2(F.lit(n / m))) for k, m in of_kind.items()], F.lit(0.0)) if of_kind else F.lit(0.0)
    often = entities.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = near.groupBy("entity", "h").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= support)
    scored = pairs.join(often, "entity").join(terms, "h").withColumn("pmi", F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_term") * F.col("n_entity")))).withColumn("ic", F.log2(F.lit(float(n)) / F.col("n_entity")))
    return scored.where((F.col("pmi") >= alpha * F.col("ic")) & (F.col("pmi") > allowed)).select("entity", "h", "pmi", "ic")


def hidden_terms(text: str, spans, marked: set[int], known: Terms) -> list[tuple[int, int, str]]:
    """(start, end, what stands there now) of the disclosed terms of a text."""
    out = []
    for a, b in words_apart(text, spans):
        whole, stem = known[text[a:b]]
        if whole in marked:
            raw = text[a:b]
            a += len(raw) - len(raw.lstrip(AROUND))
            end = b - (len(raw) - len(raw.rstrip(AROUND)))
            out.append((a, end, text[a : a + STEM] + "*" if stem and stem not in marked else ""))
    return out


def sanitised(text: str, spans, hidden) -> str:
    """The text with entities as [KIND] and disclosed terms generalised or removed; overlapping spans become one, named after the first."""
    cuts = sorted([(a, b, f"[{KINDS[k].upper()}]") for a, k, b, *_ in spans] + list(hidden))
    out, at = [], 0
    for a, b, new in cuts:
        if a >= at:
            out += [text[at:a], new]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, alpha: float = ALPHA, support: int = SUPPORT, with_text: bool = True
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans and, if wanted, sanitised (null: the text needs no change): one row per document."""
    docs = id_and_text(df, id_col, text_col)
    kinds = "row long, doc_id long, text string, spans array<long>, entity long, kind int, near array<long>, terms array<long>, counts array<long>"
    found = cut_lineage(docs.mapInArrow(lambda batches: _found(batches, reach), kinds))
    rows = found.where("spans is not null").select("row", "doc_id", "text", "spans")
    entities = found.where("entity is not null").select("row", "entity", "kind")
    near = found.where("entity is not null").select("row", "entity", F.explode("near").alias("h"))
    terms = found.where("terms is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("h")).agg(F.sum("t.counts").alias("n_term"))
    n = rows.count()
    close = disclosing(near, entities, terms, n, alpha, support).select("entity", "h")
    # at most 4 * reach terms per entity of the document
    marked = cut_lineage(skew_join(near, close, ["entity", "h"]).groupBy("row").agg(F.collect_set("h").alias("marked")))

    def work(batches):
        import hashlib

        import pyarrow as pa

        known = Terms()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                flat = r["spans"]
                spans = list(zip(flat[::3], flat[1::3], flat[2::3]))
                hidden = hidden_terms(r["text"], spans, set(r["marked"]), known) if r["marked"] else []
                every = spans + [(a, KINDS.index("term"), b) for a, b, _ in hidden]
                counts = [sum(k == i for _, k, _ in every) for i in range(len(KINDS))]
                out.append((r["doc_id"], *counts, hashlib.sha256(span_text(spans).encode()).hexdigest(), span_text(every), sanitised(r["text"], spans, hidden) if with_text and spans else None))
            columns = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if x in ("base_sha256", "spans", "sanitised") else pa.int64()) for x, c in zip(names, columns)], names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "sanitised"]
    schema = ", ".join(f"{x} {'string' if x in ('base_sha256', 'spans', 'sanitised') else 'long'}" for x in names)
    plain = rows.where("text is null").withColumn("marked", F.lit(None).cast("array<long>"))  # no entities: nothing to look up
    out = rows.where("text is not null").join(marked, "row", "left").unionByName(plain).select("doc_id", "text", "spans", "marked").mapInArrow(work, schema)
    return out if with_text else out.drop("sanitised")
