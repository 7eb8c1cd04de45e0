"""Foreign keys found in the data.

One scan per table gives a sketch of the distinct values of every column that could be a key. For
a child column c and a parent key p, the hashes of c's sketch that lie in the range p's sketch covers
are a random sample of c's values; the share of them that p's sketch holds estimates how much of c lies in
p. Pairs that are five standard errors below the bar are dropped; pairs with too small a sample
stay. Sketch entries meet by an equi-join, so no two tables are joined for that. For the pairs
that stay, the distinct values of the columns concerned are read once per table as 128-bit
keys, and one equi-join counts the shared ones exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, together
from . import summaries
from .joins import match

Pair = tuple[str, str, str, str]  # child table, child column, parent table, parent column
LINK = ["from_table", "from_column", "to_table", "to_column"]
ERRORS = 5.0  # standard errors below the bar at which a pair is dropped


@dataclass(frozen=True)
class Candidate:
    """A column that may be a key, or point to one."""

    number: int
    table: str
    column: str
    kind: str
    rows: int
    filled: int
    sketched: int  # entries of its sketch
    reach: int  # hashes up to here are in the sketch if the column has them
    distinct: int  # as the sketch has it

    @property
    def like_key(self) -> bool:
        """No nulls, and as many values as rows as far as the sketch can tell."""
        return self.rows > 0 and self.filled == self.rows and self.distinct >= self.rows * (1 - 6 / math.sqrt(summaries.SKETCH))


def key_kind(dtype: T.DataType) -> str | None:
    """Columns of one kind can hold the same keys; fractions, booleans and nested types are no keys."""
    if isinstance(dtype, T.IntegralType):
        return "whole"
    if isinstance(dtype, T.StringType):
        return "text"
    return "date" if isinstance(dtype, T.DateType) else "time" if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) else None


def candidates(tables: dict[str, DataFrame]) -> tuple[list[Candidate], DataFrame]:
    """The columns that may be keys, and (number, sketch) as a written table; one scan per table."""
    names = {t: [f.name for f in df.schema.fields if key_kind(f.dataType)] for t, df in tables.items()}
    names = {t: c for t, c in names.items() if c}
    if not names:
        return [], None
    first, at = {}, 0
    for t, cols in names.items():
        first[t], at = at, at + len(cols)
    parts = [
        summaries.summarize(tables[t], cols).select((F.col("position") + first[t]).alias("number"), "n", "filled", "sketch", summaries.estimate(F.col("sketch")).alias("distinct"))
        for t, cols in names.items()
    ]
    every = reduce(DataFrame.unionByName, together(*[lambda p=p: cut_lineage(p) for p in parts]))
    place = [(t, c) for t, cols in names.items() for c in cols]
    seen = every.select("number", "n", "filled", "distinct", F.size("sketch").alias("sketched"), F.element_at("sketch", -1).alias("last")).where("sketched > 0").collect()
    full = (1 << 63) - 1
    found = [
        Candidate(r["number"], *place[r["number"]], key_kind(tables[place[r["number"]][0]].schema[place[r["number"]][1]].dataType), r["n"], r["filled"], r["sketched"], full if r["sketched"] < summaries.SKETCH else r["last"], r["distinct"])
        for r in seen
    ]
    return found, every.select("number", "sketch")


def plausible(found: list[Candidate], sketches: DataFrame, min_overlap: float, self_links: bool = False) -> list[tuple[Candidate, Candidate]]:
    """Pairs (child, parent key) whose sketches allow an overlap of ``min_overlap``."""
    parents = [c for c in found if c.like_key]
    if not parents:
        return []
    spark = sketches.sparkSession
    kinds = spark.createDataFrame([(c.number, c.kind, c.like_key) for c in found], "number int, kind string, like_key boolean")
    entries = sketches.join(F.broadcast(kinds), "number").select("number", "kind", "like_key", F.explode("sketch").alias("h"))  # one row per column
    left = entries.select("kind", "h", F.col("number").alias("child"))
    right = entries.where("like_key").select("kind", "h", F.col("number").alias("parent"))
    shared = {(r["child"], r["parent"]): r["n"] for r in left.join(right, ["kind", "h"]).where("child <> parent").groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n")).collect()}
    reaches = sorted({p.reach for p in parents})

    def sample_sizes(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = [np.searchsorted(s.values.to_numpy(zero_copy_only=False), reaches, "right") for s in batch.column("sketch")]
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array([x.tolist() for x in sizes], pa.list_(pa.int64()))], ["number", "sizes"])

    sizes = {r["number"]: dict(zip(reaches, r["sizes"])) for r in sketches.mapInArrow(sample_sizes, "number int, sizes array<long>").collect()}
    out = []
    for c in found:
        for p in parents:
            if c.kind != p.kind or c.number == p.number or c.table == p.table and not self_links:
                continue
            m = sizes[c.number][p.reach]
            least = min_overlap * m
            if p.sketched == summaries.SKETCH or c.sketched == summaries.SKETCH:  # a sample, not all values
                least -= ERRORS * np.sqrt(m * min_overlap * (1 - min_overlap)) + (1 if min_overlap < 1 else 0)
            if shared.get((c.number, p.number), 0) >= least - 1e-9:
                out.append((c, p))
    return out


_COUNTS = "from_table string, from_column string, to_table string, to_column string, child_keys bigint, parent_keys bigint, shared_keys bigint"


def shared_keys(tables: dict[str, DataFrame], pairs: list[Pair]) -> DataFrame:
    """(link, child_keys, parent_keys, shared_keys): exact distinct counts of many column pairs; one scan per table, one equi-join for all pairs.

    Both columns of a pair must be of one kind (``key_kind``).
    """
    spark = next(iter(tables.values())).sparkSession
    pairs = list(dict.fromkeys(pairs))
    ends = sorted({(p[0], p[1]) for p in pairs} | {(p[2], p[3]) for p in pairs})
    if not ends:
        return spark.createDataFrame([], _COUNTS)
    number = {e: i for i, e in enumerate(ends)}
    parts = []
    for t in sorted({t for t, _ in ends}):
        cols = [c for x, c in ends if x == t]
        numbers = F.array(*[F.lit(number[t, c]) for c in cols])
        parts.append(summaries.key_counts(tables[t], cols).select(F.element_at(numbers, F.col("position") + 1).alias("number"), "a", "b"))
    values = reduce(DataFrame.unionByName, together(*[lambda p=p: cut_lineage(p) for p in parts]))
    links = spark.createDataFrame([(*p, number[p[0], p[1]], number[p[2], p[3]]) for p in pairs], ", ".join(f"{c} string" for c in LINK) + ", child int, parent int")
    sizes = values.groupBy("number").agg(F.count(F.lit(1)).alias("keys"))
    wanted = F.broadcast(links.select("child", "parent").distinct())  # one row per pair of columns
    sent = values.join(wanted, F.col("number") == F.col("child")).select("child", "parent", "a", "b")
    held = values.join(F.broadcast(links.select("parent").distinct()), F.col("number") == F.col("parent")).select("parent", "a", "b")
    both = sent.join(held, ["parent", "a", "b"]).groupBy("child", "parent").agg(F.count(F.lit(1)).alias("shared"))
    counted = links.join(both, ["child", "parent"], "left")
    for end in ("child", "parent"):
        counted = counted.join(F.broadcast(sizes.select(F.col("number").alias(end), F.col("keys").alias(f"{end}_keys"))), end, "left")
    zero = F.lit(0).cast("bigint")
    return counted.select(*LINK, F.coalesce("child_keys", zero).alias("child_keys"), F.coalesce("parent_keys", zero).alias("parent_keys"), F.coalesce("shared", zero).alias("shared_keys"))


def with_overlap(counts: DataFrame) -> DataFrame:
    """Adds overlap (share of child keys in the parent), coverage (share of parent keys in use) and disjoint (both have keys, none in common)."""
    def share(of: str):
        return F.coalesce(F.col("shared_keys") / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))

    return counts.select("*", share("child_keys").alias("overlap"), share("parent_keys").alias("coverage"), F.expr("child_keys > 0 AND parent_keys > 0 AND shared_keys = 0").alias("disjoint"))


def discover_links(tables: dict[str, DataFrame], min_overlap: float = 0.95, self_links: bool = False) -> DataFrame:
    """Pairs (child column, parent key) of which at least ``min_overlap`` of the child's distinct values lie in the key, with exact counts.

    A parent key is a column without nulls and repeats. ``best`` marks the parent of a child column
    with the largest coverage, by name among equals: small whole numbers lie in every larger key, but rarely use much of it.
    """
    found, sketches = candidates(tables)
    pairs = plausible(found, sketches, min_overlap, self_links) if found else []
    counts = cut_lineage(shared_keys(tables, [(c.table, c.column, p.table, p.column) for c, p in pairs]))
    rows = {(p.table, p.column): p.rows for _, p in pairs}
    known = counts.sparkSession.createDataFrame([(t, c, n) for (t, c), n in rows.items()], "to_table string, to_column string, parent_rows bigint")
    exact = counts.join(F.broadcast(known), ["to_table", "to_column"]).where("parent_keys = parent_rows").drop("parent_rows")  # one row per key
    good = with_overlap(exact).where((F.col("shared_keys") > 0) & (F.col("overlap") >= min_overlap)).drop("disjoint")
    best = good.groupBy("from_table", "from_column").agg(F.min_by(F.struct("to_table", "to_column"), F.struct(-F.col("coverage"), "to_table", "to_column")).alias("_b"))
    return good.join(best, ["from_table", "from_column"]).withColumn("best", (F.col("to_table") == F.col("_b.to_table")) & (F.col("to_column") == F.col("_b.to_column"))).drop("_b").select(
        *LINK, "child_keys", "parent_keys", "shared_keys", "overlap", "coverage", "best"
    )


def links_with_evidence(guesses: DataFrame, tables: dict[str, DataFrame], min_overlap: float = 0.95) -> DataFrame:
    """Guessed links (``catalog.infer_links``) with what the data says, and links that only the data shows.

    A guess whose ends have keys but none in common is dropped, as is one between columns of
    different kinds. ``source`` is ``name``, ``data`` or ``both``. A name alone counts 0.62, shared keys add up
    to 0.33; a link seen only in the data counts half its overlap, and more the more of the parent it uses.
    """
    asked = [tuple(r) for r in guesses.select(*LINK).distinct().collect()]  # at most one row per pair of catalog columns
    known = [p for p in asked if p[0] in tables and p[2] in tables and p[1] in tables[p[0]].columns and p[3] in tables[p[2]].columns]
    same = [p for p in known if key_kind(tables[p[0]].schema[p[1]].dataType) is not None and key_kind(tables[p[0]].schema[p[1]].dataType) == key_kind(tables[p[2]].schema[p[3]].dataType)]
    named = with_overlap(shared_keys(tables, same)).where("not disjoint").drop("disjoint").withColumn("_name", F.lit(True))
    shown = discover_links(tables, min_overlap).where("best").drop("best").withColumn("_data", F.lit(True))
    every = named.join(shown, [c for c in shown.columns if c != "_data"], "full")
    by_name, by_data = F.coalesce("_name", F.lit(False)), F.coalesce("_data", F.lit(False)) | (F.col("overlap") >= min_overlap) & (F.col("shared_keys") > 0)
    confidence = F.when(by_name, F.lit(0.62) + 0.33 * F.col("overlap")).otherwise(0.5 * F.col("overlap") * (1 + F.col("coverage") * 0.6))
    facts = guesses.select(*LINK, "is_optional", "cardinality").distinct()
    out = every.select(*LINK, "child_keys", "parent_keys", "shared_keys", "overlap", "coverage", F.when(by_name & by_data, "both").when(by_name, "name").otherwise("data").alias("source"), F.round(confidence, 6).alias("confidence"))
    return match(out, facts, LINK).unionByName(out.join(facts, LINK, "left_anti"), allowMissingColumns=True).withColumn("is_optional", F.coalesce("is_optional", F.lit(True))).withColumn("cardinality", F.coalesce("cardinality", F.lit("1:N")))
