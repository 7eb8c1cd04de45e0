"""Look-alike datasets of several related tables."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import random as R
from ..functions.text import clamp, quote
from ..session import cut_lineage, together
from . import copula as K
from .generate import Link
from .joins import heavy_keys, shuffle_width, skew_join
from .profile import _c, key_candidates
from .relate import _PARTIAL, _co_moments, drop_orphans, key_overlap, merge_co_moments
from .rows import ordered_index
from .series import running_sum


def parents_first(tables: list[str], links: list[Link]) -> list[str]:
    """Tables in an order with parents before children, by name where free; a cycle starts at its first table by name."""
    waiting = {t: {k.to_table for k in links if k.from_table == t and k.to_table != t} for t in sorted(tables)}
    order: list[str] = []
    while waiting:
        ready = [t for t, parents in waiting.items() if not parents & waiting.keys()]
        order += ready or [_in_cycle(waiting)]
        for t in ready or order[-1:]:
            del waiting[t]
    return order


def _in_cycle(waiting: dict[str, set[str]]) -> str:
    """The first table by name that is its own ancestor."""
    for t in waiting:
        seen, front = set(), {t}
        while front:
            front = {p for f in front for p in waiting[f] if p in waiting} - seen
            seen |= front
        if t in seen:
            return t
    raise AssertionError("no table is free and none lies in a cycle")


def usable_links(tables: dict[str, DataFrame], links: list[Link], self_links: bool = False) -> list[Link]:
    """Links whose ends exist, each once."""
    good = []
    for k in links:
        ok = k.from_table in tables and k.to_table in tables and k.from_column in tables[k.from_table].columns and k.to_column in tables[k.to_table].columns
        if ok and k not in good and (self_links or k.from_table != k.to_table):
            good.append(k)
    return good


def primary_key(df: DataFrame) -> str | None:
    """The best column without nulls and repeats."""
    best = key_candidates(df).where("rank = 1").first()
    return best["column"] if best else None


class _Keys:
    """Key columns as expressions of the row number, the same wherever the row is needed.

    A column that others point to gets fresh keys, or, if it points elsewhere itself (1:1 and longer
    chains), the parent's key at a permuted row: each parent at most once while there are enough.
    Columns that point to each other in a circle hold the same keys, as many as the smallest of
    their tables has rows. Any other foreign key is the parent's key at a drawn row.
    """

    def __init__(self, tables: dict[str, DataFrame], links: list[Link], rows: dict[str, int], seeds: dict[str, int]):
        self.tables, self.rows, self.seeds = tables, rows, seeds
        self.goal: dict[tuple[str, str], tuple[str, str]] = {}
        for k in links:
            if (k.from_table, k.from_column) != (k.to_table, k.to_column):
                self.goal.setdefault((k.from_table, k.from_column), (k.to_table, k.to_column))
        self.referenced = set(self.goal.values())
        self.first = {}
        for t, c in sorted(self.referenced - self.goal.keys()):
            self.first.setdefault(t, c)
        self.circle: dict[tuple[str, str], int] = {}
        for start in self.goal:
            path = [start]
            while path[-1] in self.goal and self.goal[path[-1]] not in path:
                path.append(self.goal[path[-1]])
            end = self.goal.get(path[-1])
            if end in path:
                ring = path[path.index(end) :]
                least = min(rows[t] for t, _ in ring)
                self.circle.update(dict.fromkeys(ring, least))

    def columns(self, table: str) -> list[str]:
        return sorted({c for t, c in self.referenced | self.goal.keys() if t == table})

    def value(self, table: str, column: str, row: Column) -> Column:
        at, kind = (table, column), self.tables[table].schema[column].dataType
        if at in self.circle:
            return K.key_value(F.pmod(row, F.lit(self.circle[at])), kind, 0, "circle").cast(kind)
        if at not in self.goal:
            name = table if self.first.get(table) == column else f"{table}.{column}"
            return K.key_value(row, kind, self.seeds[table], name)
        parent, key = self.goal[at]
        n = self.rows[parent]
        if at in self.referenced:  # a step without a common divisor visits every parent once
            step = next(s for s in range(max(1, int(n * 0.618)), 2 * n + 2) if math.gcd(s, n) == 1)
            picked = F.pmod(row * F.lit(step) + F.lit(self.seeds[table] % n), F.lit(n))
        else:  # nothing points here, so the row is the table's own
            picked = R.below(self.seeds[table], f"{table}.{column}.parent", "_row", n)
        return self.value(parent, key, picked).cast(kind)


def synthesize_tables(
    tables: dict[str, DataFrame], links: list[Link], num_rows: int = 100, seed: int = 42, row_counts: dict[str, int] | None = None, table_seeds: dict[str, int] | None = None
) -> dict[str, DataFrame]:
    """Every table by its own copula; keys are fresh and foreign keys point to them, for any shape of links.

    Keys are expressions of row numbers, so a foreign key is the parent's expression at a drawn row: no join.
    """
    links = usable_links(tables, links, self_links=True)
    rows = {t: max(1, int((row_counts or {}).get(t, num_rows))) for t in tables}
    order = parents_first(list(tables), links)
    seeds = {t: int((table_seeds or {}).get(t, seed + i)) for i, t in enumerate(order)}
    keys = _Keys(tables, links, rows, seeds)

    def fitted(t: str) -> K.Copula:
        return K.fit(tables[t], [c for c in K.scalar_names(tables[t]) if c not in keys.columns(t)])

    models = dict(zip(order, together(*[lambda t=t: fitted(t) for t in order])))
    out: dict[str, DataFrame] = {}
    for t in order:
        df = K.synthesize(tables[t], rows[t], seeds[t], None, keys.columns(t), t, model=models[t])
        df = df.withColumns({c: keys.value(t, c, F.col("_row")) for c in keys.columns(t)})
        out[t] = df.select(*[quote(c) for c in tables[t].columns if c in df.columns])
    return out


# --- hierarchical --------------------------------------------------------------------


@dataclass
class _Child:
    link: Link
    numbers: list[str]  # number columns whose mean and spread follow the parent


def _stat(child: str, column: str, what: str) -> str:
    return f"__{child}__{column}__{what}"


def child_aggregates(child: DataFrame, link: Link, numbers: list[str]) -> DataFrame:
    """Per parent key: number of children, mean and spread of their numbers."""
    aggs = [F.count(F.lit(1)).cast("double").alias(_stat(link.from_table, link.from_column, "count"))]
    for c in numbers:
        x = _c(c).cast("double")
        aggs += [F.avg(x).alias(_stat(link.from_table, c, "mean")), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias(_stat(link.from_table, c, "sd"))]
    return child.where(_c(link.from_column).isNotNull()).groupBy(_c(link.from_column).alias("_pk")).agg(*aggs)


def synthesize_hierarchy(
    tables: dict[str, DataFrame], links: list[Link], num_rows: int = 100, seed: int = 42, keys: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Child counts and child distributions follow the parent.

    A parent row is modelled together with the number of its children and the mean and
    spread of their numbers. Sampled parents bring their sampled counts, each child row
    starts from its parent's mean and spread. Tables are scaled by num_rows / largest table.
    A table with several parents hangs on the first one. For each further parent a child row is modelled with
    that parent's score, a sum of the parent's numbers that goes with the child's numbers most closely;
    sampled children take the places of sampled parents in the order of both scores, as
    many places per parent as its sampled number of children.
    """
    keys = keys or {t: primary_key(df) for t, df in tables.items()}
    given = usable_links(tables, links, self_links=True)
    links = [k if k.to_column == keys.get(k.to_table) else Link(k.from_table, k.from_column, k.to_table, keys.get(k.to_table) or "") for k in given if k.from_table != k.to_table]
    links = [k for k in dict.fromkeys(links) if k.to_column]
    links = [k for k in links if not key_overlap(tables[k.from_table], k.from_column, tables[k.to_table], k.to_column).first()["disjoint"]]
    order = parents_first(list(tables), links)
    place = {t: i for i, t in enumerate(order)}
    links = [k for k in links if place[k.to_table] < place[k.from_table]]
    # links to the own table and back along a circle carry no fan-out: their keys are drawn at the end
    done = {(k.from_table, k.from_column) for k in links}
    late = [k for k in given if (k.from_table, k.from_column) not in done and keys.get(k.to_table) == k.to_column and k.from_column != keys.get(k.from_table)]
    clean = dict(tables)
    for t in order:
        up = [k for k in links if k.from_table == t]
        for k in up:
            clean[t] = drop_orphans(clean[t], k.from_column, clean[k.to_table], k.to_column)
        if up:  # read by many plans, each of which would hold all joins with the parents and theirs
            clean[t] = cut_lineage(clean[t])

    first = {}
    for k in links:
        first.setdefault(k.from_table, k)
    foreign = {t: {k.from_column for k in [*links, *late] if k.from_table == t} for t in tables}
    largest = max(df.count() for df in tables.values())
    scale = num_rows / largest if num_rows > 0 and largest else 1.0

    def numbers(t: str) -> list[str]:
        return [f.name for f in tables[t].schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in foreign[t] and f.name != keys.get(t)]

    kids = {t: [_Child(k, numbers(k.from_table)) for k in first.values() if k.to_table == t] for t in tables}
    further = [k for k in links if k is not first[k.from_table]]
    for k in further:
        kids[k.to_table].append(_Child(k, []))
    scores = {k: fit_score(clean[k.from_table], clean[k.to_table], k, numbers(k.from_table), numbers(k.to_table)) for k in further}
    models, sizes = {}, {}
    for t in order:
        df = clean[t]
        skip = foreign[t] | {keys.get(t)}
        plain = [f.name for f in df.schema.fields if f.name not in skip and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
        extra = []
        for kid in kids[t]:
            # every link has its own count; the first one also the children's numbers
            agg = child_aggregates(clean[kid.link.from_table], kid.link, kid.numbers)
            count = _stat(kid.link.from_table, kid.link.from_column, "count")
            df = df.join(agg, _c(kid.link.to_column) == F.col("_pk"), "left").drop("_pk").withColumn(count, F.coalesce(count, F.lit(0.0)))
            extra += [c for c in agg.columns if c != "_pk"]
        for k in further:
            if k.from_table == t:
                df = _with_parent_score(df, k, clean[k.to_table], child_aggregates(clean[t], k, []), scores[k])
                extra.append(_score_name(k))
        if t in first:  # numbers are modelled as deviations from the parent's mean, in units of its spread
            df = _deviations(df, first[t], numbers(t), clean[t])
        df = cut_lineage(df.select(*plain, *extra)) if extra or t in first else df.select(*plain)
        models[t] = K.fit(df, [*plain, *extra])
        sizes[t] = df.count()

    made: dict[str, DataFrame] = {}
    for i, t in enumerate(order):
        if t in first:
            base = _child_rows(made[first[t].to_table], first[t], numbers(t))
            base = _with_free_rows(base, clean[t], first[t], scale)
        else:
            n = max(1, round(sizes[t] * scale))
            base = tables[t].sparkSession.range(0, n).withColumnRenamed("id", "_row")
        df = K.sample_on(base, ["_row"], models[t], seed + i, t)
        if t in first:
            df = _from_deviations(df, clean[t], numbers(t), t)
        if keys.get(t):
            df = df.withColumn(keys[t], K.key_value(F.col("_row"), tables[t].schema[keys[t]].dataType, seed, t))
        made[t] = cut_lineage(df)
        for k in further:
            if k.from_table == t:
                made[t] = cut_lineage(_matched_keys(made[t], k, made[k.to_table], scores[k], clean[t].schema[k.from_column].dataType))
    for k in late:
        row = R.below(seed, f"{k.from_table}.{k.from_column}.parent", "_row", made[k.to_table].count())
        made[k.from_table] = _drawn_key(made[k.from_table], k, row, tables, clean, seed)
    return {t: made[t].select(*[_c(c) for c in tables[t].columns if c in made[t].columns]) for t in tables}


@dataclass
class Score:
    """A weighted sum of a parent's standardized numbers and of its number of children."""

    columns: list[str]
    means: list[float]
    scales: list[float]
    weights: list[float]

    def of(self) -> Column:
        parts = [F.coalesce((_c(c).cast("double") - m) / s, F.lit(0.0)) * w for c, m, s, w in zip(self.columns, self.means, self.scales, self.weights)]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _score_name(link: Link) -> str:
    return f"__score__{link.from_column}"


def _counted_parents(parent: DataFrame, link: Link, counts: DataFrame) -> DataFrame:
    """Parents with the number of their children by the link."""
    count = _stat(link.from_table, link.from_column, "count")
    return parent.join(counts, _c(link.to_column) == F.col("_pk"), "left").drop("_pk").withColumn(count, F.coalesce(count, F.lit(0.0)))


def fit_score(child: DataFrame, parent: DataFrame, link: Link, child_numbers: list[str], parent_numbers: list[str]) -> Score:
    """The score of a parent that is correlated most with a sum of the child's numbers (first canonical direction)."""
    count = _stat(link.from_table, link.from_column, "count")
    names = [*parent_numbers, count]
    parents = _counted_parents(parent.select(_c(link.to_column), *[_c(c) for c in parent_numbers]), link, child_aggregates(child, link, []))
    parents = parents.select(_c(link.to_column).alias("_pk"), *[_c(c).cast("double").alias(f"y{i}") for i, c in enumerate(names)])
    rows = child.where(_c(link.from_column).isNotNull()).select(_c(link.from_column).alias("_pk"), *[_c(c).cast("double").alias(f"x{i}") for i, c in enumerate(child_numbers)])
    both = skew_join(rows, parents, ["_pk"], "inner").drop("_pk")
    k, left = len(child_numbers) + len(names), len(child_numbers)
    own = both.agg(*[f(c).alias(f"{w}{i}") for i, c in enumerate(both.columns) for w, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means = [own[f"m{i}"] or 0.0 for i in range(k)]
    spread = [own[f"s{i}"] or 0.0 for i in range(k)]
    corr = np.eye(k)
    if k > 1:
        for r in merge_co_moments(both.mapInPandas(_co_moments, _PARTIAL)).collect():  # one row per pair of numbers
            if r["cxx"] > 0 and r["cyy"] > 0:
                corr[r["i"], r["j"]] = corr[r["j"], r["i"]] = r["cxy"] / math.sqrt(r["cxx"] * r["cyy"])
    live_x = [i for i in range(left) if spread[i] > 0]
    live_y = [i for i in range(left, k) if spread[i] > 0]
    weights = np.zeros(len(names))
    if live_x and live_y:
        ridge = lambda idx: corr[np.ix_(idx, idx)] + 1e-6 * np.eye(len(idx))
        cross = corr[np.ix_(live_y, live_x)]
        found, directions = np.linalg.eig(np.linalg.solve(ridge(live_y), cross @ np.linalg.solve(ridge(live_x), cross.T)))
        best = np.real(directions[:, int(np.argmax(np.real(found)))])
        weights[[i - left for i in live_y]] = best * (1 if best[int(np.argmax(np.abs(best)))] > 0 else -1)
    elif live_y:
        weights[live_y[0] - left] = 1.0
    return Score(names, means[left:], [s or 1.0 for s in spread[left:]], weights.tolist())


def _with_parent_score(df: DataFrame, link: Link, parent: DataFrame, counts: DataFrame, score: Score) -> DataFrame:
    """Child rows with the score of their parent by the link, null without one."""
    scored = _counted_parents(parent, link, counts).select(_c(link.to_column).alias("_sk"), score.of().alias(_score_name(link)))
    return skew_join(df.withColumn("_sk", _c(link.from_column)), scored, ["_sk"], "left").drop("_sk")


def _matched_keys(children: DataFrame, link: Link, parents: DataFrame, score: Score, dtype: T.DataType) -> DataFrame:
    """Children take their parents' places in the order of the scores; a child without a score has no parent."""
    name, count = _score_name(link), _stat(link.from_table, link.from_column, "count")
    ranked = ordered_index(children.where(_c(name).isNotNull()).withColumn("_s", _c(name)), [], ["_s", "_row"], "_rank")
    p = parents.select(_c(link.to_column).alias("_key"), F.col("_row").alias("_parent_row"), score.of().alias("_s"), F.greatest(F.round(_c(count)), F.lit(0)).cast("bigint").alias("_cnt")).where("_cnt > 0")
    total, largest = p.agg(F.coalesce(F.sum("_cnt"), F.lit(0)), F.coalesce(F.max("_cnt"), F.lit(0))).first()
    if not total:  # no sampled parent has children: each has one place
        p = parents.select(_c(link.to_column).alias("_key"), F.col("_row").alias("_parent_row"), score.of().alias("_s"), F.lit(1).cast("bigint").alias("_cnt"))
        total, largest = p.count(), 1
    n = ranked.count()
    slots = running_sum(ordered_index(p, [], ["_s", "_parent_row"], "_place_rank"), [], "_cnt", "_end", "_place_rank")
    places = K.explode_counts(slots.select("_key", "_place_rank", "_cnt", (F.col("_end") - F.col("_cnt")).cast("bigint").alias("_start")), ["_place_rank"], "_cnt", "_i", largest)
    places = places.select((F.col("_start") + F.col("_i")).alias("_place"), F.col("_key").cast(dtype).alias(link.from_column))
    placed = ranked.withColumn("_place", F.floor((F.col("_rank") + F.lit(0.5)) * total / max(n, 1)).cast("bigint")).drop("_rank", "_s", link.from_column)
    heavy = [(i,) for i in range(total)] if total <= 4 * shuffle_width(children) else []  # few places can be large
    met = skew_join(placed, places, ["_place"], heavy=heavy, grown=True).drop("_place", name)
    free = children.where(_c(name).isNull()).drop(name).withColumn(link.from_column, F.lit(None).cast(dtype))
    return met.unionByName(free)


def _drawn_key(df: DataFrame, link: Link, row: Column, tables: dict[str, DataFrame], clean: dict[str, DataFrame], seed: int) -> DataFrame:
    """A foreign key drawn over the made parents, null as often as in the source."""
    source = clean[link.from_table]
    nulls = source.agg(F.avg(_c(link.from_column).isNull().cast("double"))).first()[0] or 0.0
    hidden = R.u(seed, f"{link.from_table}.{link.from_column}.null", "_row") < nulls
    value = K.key_value(row, tables[link.to_table].schema[link.to_column].dataType, seed, link.to_table).cast(source.schema[link.from_column].dataType)
    return df.withColumn(link.from_column, F.when(~hidden, value) if nulls else value)


def _with_free_rows(base: DataFrame, source: DataFrame, link: Link, scale: float) -> DataFrame:
    """Adds children without a parent, as many as the source has in proportion; their row numbers follow the others'."""
    n = round(source.where(_c(link.from_column).isNull()).count() * scale)
    if not n:
        return base
    last = base.agg(F.coalesce(F.max("_row") + 1, F.lit(0))).first()[0]
    return base.unionByName(base.sparkSession.range(last, last + n).withColumnRenamed("id", "_row"), allowMissingColumns=True)


def _deviations(df: DataFrame, link: Link, numbers: list[str], child: DataFrame) -> DataFrame:
    agg = child_aggregates(child, link, numbers)
    key = link.from_column
    joined = skew_join(df.withColumn("_pk", _c(key)), agg, ["_pk"], "left", heavy=heavy_keys(df.withColumn("_pk", _c(key)), ["_pk"]))
    out = {}
    for c in numbers:
        sd, mean = F.col(_stat(link.from_table, c, "sd")), F.col(_stat(link.from_table, c, "mean"))
        out[c] = F.when(sd > 0, (_c(c).cast("double") - mean) / sd).otherwise(F.when(_c(c).isNotNull(), F.lit(0.0)))
    return joined.withColumns(out)


def _child_rows(parents: DataFrame, link: Link, numbers: list[str]) -> DataFrame:
    """One row per child to make, numbered 0.. over all parents, with the parent's sampled statistics."""
    count = _stat(link.from_table, link.from_column, "count")
    stats = [_stat(link.from_table, c, w) for c in numbers for w in ("mean", "sd")]
    p = parents.select(F.col("_row").alias("_parent_row"), _c(link.to_column).alias(link.from_column), F.greatest(F.round(count), F.lit(0)).cast("bigint").alias("_cnt"), *[F.col(s).alias("_up" + s) for s in stats])
    largest = p.agg(F.max("_cnt")).first()[0] or 0
    p = running_sum(p, [], "_cnt", "_end", "_parent_row")
    rows = K.explode_counts(p, ["_parent_row"], "_cnt", "_i", largest)
    return rows.withColumn("_row", (F.col("_end") - F.col("_cnt")).cast("bigint") + F.col("_i")).drop("_end", "_cnt", "_i", "_parent_row")


def _from_deviations(df: DataFrame, source: DataFrame, numbers: list[str], table: str) -> DataFrame:
    """Numbers from the parent's mean and spread, within the source's bounds and in its type."""
    if not numbers:
        return df
    row = source.agg(*[f(_c(c).cast("double")).alias(f"{w}{i}") for i, c in enumerate(numbers) for w, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for i, c in enumerate(numbers):
        mean, sd = F.col("_up" + _stat(table, c, "mean")), F.coalesce(F.col("_up" + _stat(table, c, "sd")), F.lit(0.0))
        if row[f"lo{i}"] is None:
            out[c] = F.lit(None).cast(source.schema[c].dataType)
            continue
        value = F.when(_c(c).isNotNull(), F.coalesce(mean, F.lit((row[f"lo{i}"] + row[f"hi{i}"]) / 2)) + F.greatest(sd, F.lit(0.0)) * _c(c))
        out[c] = K.typed(clamp(value, row[f"lo{i}"], row[f"hi{i}"]), source.schema[c].dataType)
    return df.withColumns(out).drop(*[c for c in df.columns if c.startswith("_up__")])
