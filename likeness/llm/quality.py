"""Quality rules as a learned decision list (DataFrame functions only).

Sequential covering: rules that find low quality are grown one after another as conjunctions of
thresholds (FOIL gain on the growing rows), pruned on held-back rows, and kept while they stay
precise there. The list becomes one ordered conditional expression. Every count comes from an
aggregation over all labelled rows; the driver sees one row per feature and threshold.

Null texts have no words. Null labels teach nothing; of repeated labels the lowest counts.
Without labels of both kinds the list is empty and the base rule decides alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACES, id_and_text

SYMBOLS = "[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
#: Features are ratios of two counts, so they mean the same for short and long texts.
RATIOS = {
    "symbols": ("n_symbols", "word_chars"), "word_length": ("word_chars", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "distinct": ("n_distinct", "n_words"), "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "word_chars"), "line_words": ("n_words", "n_lines"),
}


def _next(a: str) -> Column:
    """The array moved by one: element i is element i+1 of ``a``, the last is null."""
    return F.concat(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.array(F.lit(None)))


def _matches(pattern: str) -> Column:
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of ``COUNTS``, one row per document, without a shuffle.

    Windows of three words are compared by a 64-bit hash inside one document. Each array is a
    column of its own that the next step uses twice, so that it is computed once.
    """
    docs = id_and_text(df, id_col, text_col).withColumns(
        {"words": F.array_remove(F.split("text", SPACES), ""), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))}
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2])))
    docs = docs.select(
        "doc_id", n.cast("long").alias("n_words"), F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"), _matches(SYMBOLS + "+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), _matches(r"\p{Lu}+").cast("long").alias("n_upper"), _matches("[0-9]+").cast("long").alias("n_digits"),
        _matches("[!?]+").cast("long").alias("n_marks"), windows.alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    docs = docs.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    pairs = F.zip_with("sorted", _next("sorted"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    docs = docs.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))).drop("sorted")
    covered = F.aggregate(F.zip_with("at", _next("at"), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).select("doc_id", *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    """A feature; 0 where its divisor is 0."""
    above, below = RATIOS[name]
    return F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below).cast("double")), F.lit(0.0))


@dataclass
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        x = ratio(self.feature)
        return x > F.lit(self.bound) if self.above else x <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.4g}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


@dataclass
class DecisionList:
    """Ordered rules; a text that meets one is of low quality, all others are kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        """One ordered conditional expression over the counts: true where the text is kept."""
        out = None
        for r in self.rules:
            out = F.when(_all(r), F.lit(False)) if out is None else out.when(_all(r), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"{i}: reject if " + " and ".join(map(str, r)) for i, r in enumerate(self.rules, 1)) + "\nelse keep"


def _thresholds(rows: DataFrame, steps: int) -> dict[str, list[float]]:
    marks = [i / steps for i in range(steps)] + [0.995]
    row = rows.agg(*[F.percentile_approx(ratio(f), marks, 10_000).alias(f) for f in RATIOS]).first()
    return {f: sorted(set(row[f] or [])) for f in RATIOS}


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else float("-inf")


def learn(labelled: DataFrame, steps: int = 40, max_rules: int = 16, max_conditions: int = 4, precision: float = 0.95, support: int = 5) -> DecisionList:
    """Learn from rows with the counts of ``statistics``, ``doc_id`` and ``low`` (1: low quality).

    ``steps`` thresholds per feature are tried, ``max_rules`` and ``max_conditions`` bound the
    list's length, a rule must reach ``precision`` on rows that did not grow it and cover
    ``support`` low texts there. No row is left out.
    """
    binned = labelled.withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2)
    bounds = _thresholds(labelled, steps)
    valued = binned.select("low", "grow", *COUNTS, *[ratio(f).alias(f"x_{f}") for f in RATIOS])
    bins = [sum((F.col(f"x_{f}") > F.lit(b)).cast("int") for b in bounds[f]) + F.lit(0) for f in RATIOS]
    rows = cut_lineage(valued.select("low", "grow", *COUNTS, *[b.alias(f"bin_{f}") for f, b in zip(RATIOS, bins)]))
    out = DecisionList()
    free = F.lit(True)
    for _ in range(max_rules):
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            found = _best(rows.where(free & F.col("grow") & _all(rule)), bounds)
            if found is None:
                break
            rule.append(found[0])
            if found[1]:  # no good text is left inside
                break
        if not rule:
            break
        rule = _pruned(rows.where(free & ~F.col("grow")), rule, precision, support)
        if not rule:
            break
        out.rules.append(rule)
        free = free & ~_all(rule)
    return out


def _best(rows: DataFrame, bounds: dict[str, list[float]]) -> tuple[Condition, bool] | None:
    """The condition of the highest gain, and whether it leaves no good text."""
    long = rows.select("low", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in RATIOS])).alias("x"))
    counted = long.groupBy("x.f", "x.b").agg(F.sum("low").alias("p"), F.sum(1 - F.col("low")).alias("n")).collect()  # features x thresholds at most
    table: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counted:
        table.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    best, score, pure = None, 1e-9, False
    for f, by in sorted(table.items()):
        p0, n0 = (sum(v[i] for v in by.values()) for i in (0, 1))
        if not p0 or not n0:
            return None
        p = n = 0
        for b, bound in enumerate(bounds[f]):
            p, n = p + by.get(b, (0, 0))[0], n + by.get(b, (0, 0))[1]  # rows with value <= bound
            for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if (g := _gain(p0, n0, x, y)) > score:
                    best, score, pure = Condition(f, above, bound), g, y == 0
    return None if best is None else (best, pure)


def _pruned(rows: DataFrame, rule: list[Condition], precision: float, support: int) -> list[Condition]:
    """The beginning of the rule with the best (p - n) / (p + n) on held-back rows; none if that is not precise."""
    cuts = range(1, len(rule) + 1)
    got = rows.agg(*[F.count_if(_all(rule[:k]) & (F.col("low") == v)).alias(f"{'np'[v]}{k}") for k in cuts for v in (0, 1)]).first()
    worth = {k: (got[f"p{k}"] - got[f"n{k}"]) / (got[f"p{k}"] + got[f"n{k}"]) for k in cuts if got[f"p{k}"] + got[f"n{k}"]}
    if not worth:
        return []
    k = max(worth, key=lambda i: (worth[i], -i))
    return rule[:k] if got[f"p{k}"] >= support and got[f"p{k}"] >= precision * (got[f"p{k}"] + got[f"n{k}"]) else []


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, DecisionList]:
    """One row per document with its counts, ``base_failed`` and ``kept``; and the list. ``labels`` has doc_id and quality (1: good)."""
    stats = cut_lineage(statistics(docs, id_col, text_col))
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.join(marks, "doc_id").withColumn("low", (F.col("quality") == 0).cast("long"))
    rules = learn(cut_lineage(labelled.where(~base_failed())), **options)
    out = stats.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.verdict()), rules
