"""How five filters interact: who removes what in every order, and each filter's Shapley share.

A document is reduced to the set of filters that it fails. Per part those 32 sets are counted, so
v(S), what a coalition S of filters removes, is a sum of counts, and every step of every order is a
difference of two coalitions. The Shapley values are the solution of the kernel-weighted least
squares over all coalitions between none and all,

    minimise  sum_S k(S) * (v(S) - sum_{i in S} x_i)**2   with  sum_i x_i = v(all),
    k(S) = (m - 1) / (C(m, |S|) * |S| * (m - |S|)),

whose normal equations (with one multiplier) are solved in rationals; 120 times them are whole numbers.

Null texts and null parts are empty strings. A text repeats when a smaller doc_id has it; rows
without a doc_id repeat nothing and are repeated by nothing, rows of one doc_id do not repeat
each other. Of several labels of a doc_id any 1 counts. Empty tables give no rows. Only the SHA-256
of a text is shuffled; equal texts shrink to their smallest doc_id before the shuffle.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import plain_words, slices

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
UPPER = bytes(range(65, 91))
MARKS = b"#$%&*|"


def own_failures(text: bytes, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    words = plain_words(text)
    points = len(text) if text.isascii() else len(text.decode())
    return (
        (len(words) < min_words)
        | (100 * len(set(words)) < distinct_percent * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, UPPER))) > upper_percent * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def shapley(removed: list[int], filters: int = len(FILTERS)) -> list[Fraction]:
    """Shapley values of the game ``removed`` (one entry per coalition, as bits) by constrained least squares."""
    if filters == 1:
        return [Fraction(removed[1])]
    full = (1 << filters) - 1
    left = [[Fraction(0)] * (filters + 1) for _ in range(filters + 1)]
    right = [Fraction(0)] * (filters + 1)
    for s in range(1, full):
        size = s.bit_count()
        k = Fraction(filters - 1, comb(filters, size) * size * (filters - size))
        inside = [i for i in range(filters) if s >> i & 1]
        for i in inside:
            right[i] += k * removed[s]
            for j in inside:
                left[i][j] += k
    for i in range(filters):  # the multiplier's column, and the row that shares out all that is removed
        left[i][filters] = left[filters][i] = Fraction(1)
    right[filters] = Fraction(removed[full])
    return _solved(left, right)[:filters]


def _solved(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """Gauss-Jordan elimination in rationals."""
    rows = [[*r, v] for r, v in zip(a, b)]
    for c in range(len(rows)):
        pivot = next(i for i in range(c, len(rows)) if rows[i][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for i, r in enumerate(rows):
            if i != c and r[c]:
                rows[i] = [x - r[c] * y for x, y in zip(r, rows[c])]
    return [r[-1] for r in rows]


def coalitions(counts: list[int]) -> list[int]:
    """Documents that fail a filter of each coalition, from the documents per set of failed filters."""
    full = len(counts) - 1
    return [sum(n for fails, n in enumerate(counts) if fails & s) for s in range(full + 1)]


def steps(every: list[int], good: list[int], toxic: list[int]):
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of one part."""
    n, m = sum(every), len(every).bit_length() - 1
    gone, gone_good, gone_toxic = coalitions(every), coalitions(good), coalitions(toxic)
    share = [x * factorial(m) for x in shapley(gone, m)]
    for order in permutations(range(m)):
        before = 0
        name = "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield (
                name, step, n - gone[after], removed, gone[1 << i] - removed, every[1 << i],
                gone_good[after] - gone_good[before], gone_toxic[after] - gone_toxic[before], int(share[i]),
            )
            before = after


def failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest, fails (bits of A to D): one row per document."""

    def work(batches):
        import hashlib

        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column("text")).to_pylist(), 4 << 20):
                some = batch.slice(a, b - a)
                texts = some.column("text").cast(pa.binary()).to_pylist()
                columns = [some.column("doc_id"), some.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([own_failures(t) for t in texts], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "digest", "fails"])

    plain = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(work, "doc_id long, part string, digest binary, fails int")


def failure_counts(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, fails (bits of A to E), n, good, toxic: documents per part and set of failed filters."""
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    own = cut_lineage(failures(df, id_col, text_col, part_col))
    zero = F.lit(0)
    rows = own.join(marks, "doc_id", "left").select("doc_id", "part", "digest", "fails", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    firsts = own.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # rows of a hot text differ in doc_id, so this join deals them over all tasks
    marked = rows.join(firsts.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    repeats = F.when(F.col("first") | F.col("doc_id").isNull(), 0).otherwise(REPEAT)
    return marked.withColumn("fails", F.col("fails").bitwiseOR(repeats)).groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows per part."""
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                counts = [[0] * (1 << len(FILTERS)) for _ in range(3)]
                for s in r["sets"]:
                    for c, k in zip(counts, ("n", "good", "toxic")):
                        c[s["fails"]] = s[k]
                columns = list(zip(*[(r["part"], *x) for x in steps(*counts)]))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    counted = failure_counts(df, labels, id_col, text_col, part_col)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))  # at most 32 per part
    return parts.mapInArrow(work, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def oracle() -> str:
    """The same rows in DuckDB SQL, by going through all orders."""
    orders = ", ".join("('" + "".join(p) + "')" for p in permutations(FILTERS))
    word = r"[^\x20\x09-\x0D]+"
    bits = " | ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(
        ["len(w) < 200", "100 * len(list_distinct(w)) < 50 * len(w)", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)", "regexp_matches(t, '[#$%&*|]')", "least_id < doc_id"]
    ))
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id FROM documents),
x AS (SELECT doc_id, part, t, least_id, regexp_extract_all(t, '{word}') AS w FROM d),
f AS (SELECT doc_id, part, {bits} AS fails FROM x),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM (VALUES {orders}) v(filter_order)),
s AS (SELECT *, substr(filter_order, step, 1) AS letter, CASE WHEN step = 1 THEN 0 ELSE list_sum(list_transform(range(1, step), lambda i: 1 << (instr('{FILTERS}', substr(filter_order, CAST(i AS INT), 1)) - 1))) END AS before,
  1 << (instr('{FILTERS}', substr(filter_order, step, 1)) - 1) AS own FROM o),
r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & own > 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & own > 0 AND fails & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & own > 0 AND fails & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & own > 0 AND fails & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM s, c GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""
