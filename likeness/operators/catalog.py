"""Operators on a column catalog: types, semantics, keys, links, settings and documents.

A catalog is ordinary data here: one row per column, any number of tables and projects.
Usual columns: project_id, table_name, column_name, position, data_type, is_pk, is_nullable.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import json_object
from ..functions.text import (
    clamp, clip, lenient_double, list_like, singular, strip, tight, value_array, value_list, weighted_values,
)
from ..functions import random as R
from .joins import skew_join
from .keys import links_with_evidence

# Accepted type names and their synonyms.
TYPE_OPTIONS = ["varchar", "text", "integer", "bigint", "smallint", "decimal", "double", "float", "boolean", "date", "timestamp"]
TYPE_SYNONYMS = {
    "string": "varchar", "str": "varchar", "character varying": "varchar", "char": "varchar",
    "int": "integer", "numeric": "decimal", "double precision": "double", "real": "float",
    "bool": "boolean", "datetime": "timestamp",
}
TYPE_PREFIXES = ["character varying", "varchar", "char", "decimal", "numeric", "double precision", "timestamp"]
GENERATORS = ["auto", "categorical", "integer", "numerical", "datetime"]
CARDINALITIES = ["1:N", "1:1", "N:1", "N:N"]
NUMBER_TYPES = "INT|NUM|DEC|DOUBLE|FLOAT|REAL"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _case(rules: list[tuple[Column, Column]], default: Column) -> Column:
    chain = F.when(*rules[0])
    for cond, value in rules[1:]:
        chain = chain.when(cond, value)
    return chain.otherwise(default)


# --- types and semantics -------------------------------------------------------------


def normal_type(c: Column | str) -> Column:
    """A declared type as one of ``TYPE_OPTIONS``; lengths and time-zone words are dropped."""
    text = F.regexp_replace(F.lower(strip(F.coalesce(_col(c), F.lit("")))), r"\s+", " ")
    base = strip(F.regexp_replace(text, r"\s*\([^)]*\)", ""))
    base = F.regexp_replace(base, r"\s+(with|without)\s+time\s+zone$", "")
    base = _case([(base.startswith(p), F.lit(p)) for p in TYPE_PREFIXES], base)
    pairs = {**{o: o for o in TYPE_OPTIONS}, **TYPE_SYNONYMS}
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(known, base), F.lit("varchar"))


# Patterns of declared types and the generator kind that fits, in this order; others are categorical.
TYPE_KINDS = [("DATE|TIME", "datetime"), ("INT", "integer"), ("NUM|DEC|DOUBLE|FLOAT|REAL", "numerical")]


def type_generator(c: Column | str) -> Column:
    """Generator kind that fits a declared type."""
    t = F.upper(F.coalesce(_col(c), F.lit("")))
    return _case([(t.rlike(pattern), F.lit(kind)) for pattern, kind in TYPE_KINDS], F.lit("categorical"))


def kind_of_type(declared: str | None) -> str:
    """The same rule for one type held by the driver."""
    return next((kind for pattern, kind in TYPE_KINDS if re.search(pattern, (declared or "").upper())), "categorical")


def safe_generator(generator: Column | str, dtype: Column | str) -> Column:
    """The given kind when it is a known one, else by type (whole numbers count as numerical)."""
    g = F.lower(strip(F.coalesce(_col(generator), F.lit(""))))
    t = F.upper(F.coalesce(_col(dtype), F.lit("")))
    by_type = _case([(t.rlike("DATE|TIME"), F.lit("datetime")), (t.rlike(NUMBER_TYPES), F.lit("numerical"))], F.lit("categorical"))
    return F.when(g.isin(*GENERATORS), g).otherwise(by_type)


def semantics(name: Column | str, dtype: Column | str) -> Column:
    """STRUCT<semantic_type, generator_type, is_pii, confidence> from name and type; first rule wins."""
    n, t = F.lower(F.coalesce(_col(name), F.lit(""))), F.upper(F.coalesce(_col(dtype), F.lit("")))

    def kind(semantic: str, generator: str, pii: bool = False) -> Column:
        return F.struct(
            F.lit(semantic).alias("semantic_type"), F.lit(generator).alias("generator_type"), F.lit(pii).alias("is_pii"), F.lit(0.55).alias("confidence")
        )

    # Ordered name and type rules.
    return _case(
        [
            (n.rlike("email"), kind("email", "categorical", True)),
            (n.rlike("phone|mobile|contact"), kind("phone", "categorical", True)),
            (n.rlike("name"), kind("person_name", "categorical", True)),
            (n.rlike("address|street|zipcode|postal|postcode"), kind("address", "categorical", True)),
            (n.rlike("amount|amt|price|cost|revenue|income|salary|invoice"), kind("currency", "numerical")),
            (n.rlike("dob|birth"), kind("birth_date", "datetime", True)),
            (n.rlike("date|time|timestamp|created|updated"), kind("datetime", "datetime")),
            (n.rlike("^is_|^has_|flag"), kind("boolean", "categorical")),
            (n.rlike("_id$|^id$|uuid"), kind("identifier", "categorical")),
            (t.rlike("DATE|TIME"), kind("datetime", "datetime")),
            (t.rlike(NUMBER_TYPES), kind("numeric", "numerical")),
        ],
        kind("categorical", "categorical"),
    )


def infer_semantics(columns: DataFrame) -> DataFrame:
    """Semantic type, generator, PII flag and confidence for every catalog row."""
    return columns.withColumn("_s", semantics("column_name", "data_type")).select("*", "_s.*").drop("_s")


# --- keys and links ------------------------------------------------------------------


def pick_keys(columns: DataFrame) -> DataFrame:
    """(table_name, pk_column): flagged key, ``id``, ``{table}id``, else the first column."""
    n, t = tight("column_name"), tight("table_name")
    rank = (
        F.when(F.coalesce(F.col("is_pk"), F.lit(False)), 0)
        .when(F.col("column_name") == "id", 1)
        .when((n == F.concat(t, F.lit("id"))) | (n == F.concat(singular(t), F.lit("id"))), 2)
        .otherwise(3)
    )
    return columns.groupBy("table_name").agg(F.min_by("column_name", F.struct(rank, F.col("position"))).alias("pk_column"))


def infer_links(columns: DataFrame, slices: int = 16, min_rows: int = 1_000_000, tables: dict[str, DataFrame] | None = None, min_overlap: float = 0.95) -> DataFrame:
    """Foreign-key guesses: a ``*id`` column whose stem is the name of another table.

    Names meet by an equi-join on the stem; a stem used by very many columns is dealt over
    several tasks. With the ``tables`` themselves the guesses are held against the data and carry
    their overlap; links that only the data shows are added (``keys.links_with_evidence``).
    """
    if tables is not None:
        return links_with_evidence(infer_links(columns, slices, min_rows), tables, min_overlap)
    n = tight("column_name")
    child = columns.select(
        F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"),
        F.coalesce("is_nullable", F.lit(True)).alias("is_optional"), F.substring(n, F.lit(1), F.length(n) - 2).alias("stem"),
    ).where(n.endswith("id") & (F.length(n) > 2))
    t = tight("table_name")
    names = F.array_distinct(F.array(t, singular(t), F.concat(t, F.lit("s"))))
    parent = pick_keys(columns).select(F.col("table_name").alias("to_table"), F.col("pk_column").alias("to_column"), F.explode(names).alias("stem"))
    found = skew_join(child, parent, ["stem"], "inner", slices, min_rows).where("from_table <> to_table")
    return (
        found.groupBy("from_table", "from_column", "to_table", "to_column")
        .agg(F.max("is_optional").alias("is_optional"))
        .withColumn("cardinality", F.lit("1:N"))
        .withColumn("confidence", F.lit(0.62))
    )


def link_rows(keys: DataFrame, columns: DataFrame) -> DataFrame:
    """Declared foreign keys (table_name, columns[], ref_table, ref_columns[]) as one row per column pair."""
    pairs = keys.select(
        F.col("table_name").alias("from_table"), F.col("ref_table").alias("to_table"), F.posexplode(F.arrays_zip("columns", "ref_columns")).alias("pair_no", "p")
    ).select("from_table", F.col("p.columns").alias("from_column"), "to_table", F.col("p.ref_columns").alias("to_column"))
    nullable = columns.select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), F.col("is_nullable").alias("is_optional"))
    return pairs.join(nullable, ["from_table", "from_column"], "left").withColumn("is_optional", F.coalesce("is_optional", F.lit(True))).withColumn("cardinality", F.lit("1:N"))


def validate_links(relations: DataFrame, columns: DataFrame, self_links: bool = False) -> DataFrame:
    """Relations with both ends in the catalog, cleaned fields, first of equal links kept (by ``position``)."""
    ends = ["from_table", "from_column", "to_table", "to_column"]
    r = relations.select(
        *[strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ends],
        F.upper(strip(F.coalesce("cardinality", F.lit("1:N")))).alias("cardinality"),
        F.coalesce("is_optional", F.lit(True)).alias("is_optional"),
        clamp(F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.6)), 0.0, 1.0).alias("confidence"),
        "position",
    )
    r = r.withColumn("cardinality", F.when(F.col("cardinality").isin(*CARDINALITIES), F.col("cardinality")).otherwise("1:N"))
    r = r.where(reduce(lambda a, b: a & b, [F.col(c) != "" for c in ends]))
    if not self_links:
        r = r.where("from_table <> to_table")
    # equal links collapse before the catalog is consulted
    first = r.groupBy(*ends).agg(F.min_by(F.struct("cardinality", "is_optional", "confidence"), "position").alias("f")).select(*ends, "f.*")
    known = columns.select("table_name", "column_name").distinct()
    a = known.select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"))
    b = known.select(F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"))
    from_known = skew_join(first, a, ["from_table", "from_column"], "left_semi")
    return skew_join(from_known, b, ["to_table", "to_column"], "left_semi").select(*ends, "cardinality", "is_optional", "confidence")


def locked_columns(relations: DataFrame) -> DataFrame:
    """Distinct (table_name, column_name) at either end of a relation."""
    a = relations.select(F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name"))
    b = relations.select(F.col("to_table").alias("table_name"), F.col("to_column").alias("column_name"))
    return a.union(b).where("table_name <> '' AND column_name <> ''").distinct()


# --- associations by name ------------------------------------------------------------

# Fixed values: (first token choices, second token choices, kind, confidence), in order.
ASSOCIATION_RULES = [
    (["city"], ["state"], "geography", 0.80),
    (["state"], ["country"], "geography", 0.80),
    (["city"], ["country"], "geography", 0.75),
    (["price"], ["cost", "cogs"], "derived", 0.82),
    (["category"], ["subcategory", "sub_category"], "hierarchy", 0.85),
    (["category"], ["type"], "hierarchy", 0.70),
]
ID_PAIR_CONFIDENCE = 0.68


def associations(columns: DataFrame, limit: int | None = 12) -> DataFrame:
    """Likely related column pairs per table by name, in rule order: pairs of ``*_id`` columns, then pairs of known words.

    ``limit`` keeps the first pairs of each table: only its first ``limit`` + 1 ``*_id`` columns can take part in those,
    so a table of any width is reduced to a handful of names before rows of a table come together. With None all pairs are given.
    """
    named = columns.where(strip("column_name") != "").select("table_name", "position", strip("column_name").alias("name"))
    low = F.lower("name")
    tokens = sorted({t for a, b, _, _ in ASSOCIATION_RULES for t in a + b})
    # positions first: minima of numbers combine cheaply, the few names are fetched afterwards
    places = named.where(low.rlike("|".join(tokens))).groupBy("table_name").agg(
        *[F.min(F.when(F.contains(low, F.lit(t)), F.col("position"))).alias(t) for t in tokens]
    )
    wanted = places.select("table_name", F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.col(t).alias("position")) for t in tokens])).alias("x"))
    wanted = wanted.select("table_name", "x.*").where("position IS NOT NULL")
    found = wanted.join(named, ["table_name", "position"]).groupBy("table_name").agg(*[F.max(F.when(F.col("token") == t, F.col("name"))).alias(f"t_{t}") for t in tokens])
    w = Window.partitionBy("table_name").orderBy("position")
    ids = named.where(low.endswith("_id")).withColumn("_r", F.row_number().over(w))
    if limit is None:
        return _all_associations(ids, found)
    ids = ids.where(F.col("_r") <= limit + 1)
    ids = ids.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda s: s["name"]).alias("ids"))

    id_list = F.coalesce("ids", F.array().cast("array<string>"))
    id_pairs = F.flatten(
        F.transform(id_list, lambda a, i: F.transform(F.slice(id_list, i + 2, limit), lambda b: _pair(a, b, "identifier", ID_PAIR_CONFIDENCE)))
    )
    by_rule = _pairs_by_rule()

    def key(p: Column) -> Column:
        return F.struct(F.least(p["col_a"], p["col_b"]), F.greatest(p["col_a"], p["col_b"]))

    rows = found.join(ids, "table_name", "full").select("table_name", F.concat(F.slice(id_pairs, 1, limit), by_rule).alias("p"))
    seen = F.aggregate(
        "p", F.array().cast("array<struct<col_a:string,col_b:string,association:string,confidence:double>>"),
        lambda acc, x: F.when(F.exists(acc, lambda o: key(o) == key(x)), acc).otherwise(F.array_append(acc, x)),
    )
    return rows.select("table_name", F.posexplode(F.slice(seen, 1, limit)).alias("rank", "a")).select(
        "table_name", (F.col("rank") + 1).alias("rank"), "a.*"
    )


def _pair(a: Column, b: Column, kind: str, confidence: float) -> Column:
    return F.struct(a.alias("col_a"), b.alias("col_b"), F.lit(kind).alias("association"), F.lit(confidence).alias("confidence"))


def _pairs_by_rule() -> Column:
    """Pairs of the first columns with known words, in rule order."""
    rules = []
    for left, right, kind, confidence in ASSOCIATION_RULES:
        a = F.coalesce(*[F.col(f"t_{t}") for t in left])
        b = F.coalesce(*[F.col(f"t_{t}") for t in right])
        rules.append(F.when(a.isNotNull() & b.isNotNull(), _pair(a, b, kind, confidence)))
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def _all_associations(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Every pair of ``*_id`` columns (``_r``: their place in the table) and every rule's pair, ranked without building a table's pairs in one row."""
    a, b = (ids.select("table_name", F.col("_r").alias(r), F.col("name").alias(c)) for r, c in (("_i", "col_a"), ("_j", "col_b")))
    # the table's own columns only, as many rows as it has pairs
    id_pairs = a.join(b, "table_name").where("_i < _j").select("table_name", F.lit(0).alias("_part"), "_i", "_j", "col_a", "col_b", F.lit("identifier").alias("association"), F.lit(ID_PAIR_CONFIDENCE).alias("confidence"))
    ruled = found.select("table_name", F.posexplode(_pairs_by_rule()).alias("_i", "p")).select("table_name", F.lit(1).alias("_part"), "_i", F.lit(0).alias("_j"), "p.*")
    pair = [F.least("col_a", "col_b").alias("_low"), F.greatest("col_a", "col_b").alias("_high")]
    first = id_pairs.unionByName(ruled).groupBy("table_name", *pair).agg(F.min(F.struct("_part", "_i", "_j", "col_a", "col_b", "association", "confidence")).alias("s"))
    w = Window.partitionBy("table_name").orderBy("_part", "_i", "_j")
    return first.select("table_name", "s.*").withColumn("rank", F.row_number().over(w)).select("table_name", "rank", "col_a", "col_b", "association", "confidence")


# --- category expansion --------------------------------------------------------------

# Name, column hints, values, aliases.
FAMILIES = [
    ("gender", ["gender", "sex"], ["Male", "Female", "Non-binary", "Prefer not to say"],
     {"m": "Male", "f": "Female", "nonbinary": "Non-binary", "other": "Non-binary", "others": "Non-binary"}),
    ("education_level", ["education", "education_level", "qualification", "degree"],
     ["High School", "Associate", "Bachelor", "Master", "Doctorate"],
     {"secondary": "High School", "bachelors": "Bachelor", "masters": "Master", "phd": "Doctorate"}),
    ("marital_status", ["marital_status", "marital"], ["Single", "Married", "Divorced", "Widowed"], {}),
    ("employment_status", ["employment_status", "employment", "job_status"],
     ["Full-time", "Part-time", "Contract", "Unemployed"], {"full time": "Full-time", "part time": "Part-time"}),
    ("status", ["status", "state"], ["Active", "Inactive", "Pending", "Suspended"], {}),
    ("priority", ["priority", "severity"], ["Low", "Medium", "High", "Critical"], {}),
    ("product_category", ["product_category", "category", "product_type"],
     ["Electronics", "Fashion", "Grocery", "Furniture", "Home", "Sports"], {}),
]


def _plain(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch.isascii() and ch.isalnum())


def expanded_values(name: Column | str, seeds: Column, max_values: int = 12) -> Column:
    """Seeds in canonical spelling followed by the rest of the best-matching family."""
    norms = F.array_distinct(F.filter(F.transform(seeds, tight), lambda x: x != ""))
    column = tight(name)
    scores = []
    for pos, (_, hints, values, aliases) in enumerate(FAMILIES):
        tokens = sorted({_plain(v) for v in values} | {_plain(a) for a in aliases})
        overlap = F.size(F.array_intersect(norms, F.array(*[F.lit(t) for t in tokens])))
        hint = F.when(column.rlike("|".join(_plain(h) for h in hints)), 2).otherwise(0)
        scores.append(F.struct((overlap + hint).alias("score"), F.lit(-pos).alias("place")))
    best = F.array_max(F.array(*scores))
    family = F.element_at(F.array(*[F.array(*[F.lit(v) for v in f[2]]) for f in FAMILIES]), 1 - best["place"])

    def spellings(f) -> Column:
        table = {**{_plain(v): v for v in f[2]}, **{_plain(a): v for a, v in f[3].items()}}
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    lookup = F.element_at(F.array(*[spellings(f) for f in FAMILIES]), 1 - best["place"])
    canonical = F.transform(seeds, lambda s: F.coalesce(F.try_element_at(lookup, tight(s)), s))
    grown = F.slice(F.array_distinct(F.concat(canonical, family)), 1, max_values)
    plain = F.slice(seeds, 1, max_values)
    return F.when((F.size(seeds) >= max_values) | (best["score"] <= 0), plain).otherwise(grown)


def expand_categories(columns: DataFrame, max_values: int = 12) -> DataFrame:
    """``expanded_values`` for flagged categorical columns with at least two seeds; other rows are left out."""
    seeds = value_array("allowed_values")
    generator = F.lower(strip(F.coalesce("generator_type", F.lit("auto"))))
    effective = F.when(generator != "auto", generator).otherwise(type_generator("data_type"))
    kept = columns.where(F.coalesce("expand_categories", F.lit(False)) & (effective == "categorical") & (F.size(seeds) >= 2))
    return kept.withColumn("expanded_values", F.array_join(expanded_values("column_name", seeds, max_values), ", "))


# --- model replies -------------------------------------------------------------------

_SUGGESTION = "column_id string, semantic_type string, generator_type string, allowed_values string, is_pii string, confidence string, reason string"


def _reply_values(c: Column) -> Column:
    """A value list given as JSON array or as text."""
    as_list = F.when(c.startswith("["), F.array_join(F.array_distinct(F.filter(F.transform(F.from_json(c, "array<string>"), strip), lambda x: x != "")), ", "))
    return F.coalesce(as_list, value_list(c, pipes=False))


def clean_expansions(replies: DataFrame, max_values: int | None = None) -> DataFrame:
    """Adds ``expanded_values`` to rows with ``allowed_values`` (seeds) and ``reply`` (an object with ``values``).

    The seeds come first, then the reply's trimmed values; of spellings that differ in case only the
    first stays. A reply that cannot be read leaves the seeds.
    """
    given = F.filter(F.transform(F.from_json(json_object("reply"), "values array<string>")["values"], strip), lambda x: x != "")
    both = F.concat(value_array("allowed_values"), F.coalesce(given, F.array().cast("array<string>")))
    rows = replies.withColumn("_v", both).withColumn("_l", F.transform("_v", F.lower))
    first = F.filter("_v", lambda x, i: F.array_position(F.col("_l"), F.lower(x)) == i + 1)
    kept = F.slice(first, 1, max_values) if max_values else first
    return rows.withColumn("expanded_values", F.array_join(kept, ", ")).drop("_v", "_l")


def clean_suggestions(replies: DataFrame, columns: DataFrame) -> DataFrame:
    """Replies (batch_id, reply) checked against the catalog (batch_id, column_id, table_name, column_name, ...).

    Unknown column ids are dropped, confidence is clamped, and columns without a suggestion
    get the name/type rules.
    """
    schema = f"suggestions array<struct<{', '.join(p.strip().replace(' ', ':') for p in _SUGGESTION.split(','))}>>"
    given = replies.select("batch_id", F.explode(F.from_json(json_object("reply"), schema)["suggestions"]).alias("s")).select("batch_id", "s.*")
    given = given.withColumnRenamed("generator_type", "given_generator").withColumnRenamed("allowed_values", "given_values")
    # a reply may name one column many times; a column stands once in the catalog
    matched = skew_join(given, columns, ["batch_id", "column_id"], "inner").select(
        "batch_id", "column_id", "table_name", "column_name",
        F.coalesce("semantic_type", F.lit("unknown")).alias("semantic_type"),
        safe_generator(F.coalesce("given_generator", F.lit("auto")), "data_type").alias("generator_type"),
        F.coalesce(F.nullif(_reply_values(F.coalesce("given_values", F.lit(""))), F.lit("")), value_list("allowed_values")).alias("allowed_values"),
        (F.lower(F.coalesce("is_pii", F.lit("false"))) == "true").alias("is_pii"),
        clamp(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5)), 0.0, 1.0).alias("confidence"),
        F.lit("model").alias("source"),
    )
    missing = columns.join(given.select("batch_id", "column_id").distinct(), ["batch_id", "column_id"], "left_anti")
    filled = missing.withColumn("_s", semantics("column_name", "data_type")).select(
        "batch_id", "column_id", "table_name", "column_name", "_s.semantic_type", "_s.generator_type",
        value_list("allowed_values").alias("allowed_values"), "_s.is_pii", "_s.confidence", F.lit("rules").alias("source"),
    )
    return matched.unionByName(filled)


def clean_associations(replies: DataFrame) -> DataFrame:
    """Association replies (table_name, reply): blank ends dropped, confidence clamped, defaults filled."""
    schema = "associations array<struct<col_a:string, col_b:string, association:string, confidence:string, reason:string>>"
    rows = replies.select("table_name", F.explode(F.from_json(json_object("reply"), schema)["associations"]).alias("a")).select("table_name", "a.*")
    return rows.where("col_a <> '' AND col_b <> ''").select(
        "table_name", "col_a", "col_b",
        F.coalesce(F.nullif("association", F.lit("")), F.lit("other")).alias("association"),
        clamp(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5)), 0.0, 1.0).alias("confidence"),
        F.coalesce(F.nullif("reason", F.lit("")), F.lit("inferred by model")).alias("reason"),
    )


# --- specs and settings --------------------------------------------------------------


def spec_rows(specs: DataFrame) -> DataFrame:
    """Schema payloads (project_id, tables ARRAY<STRUCT<table_name, columns ARRAY<...>>>) as catalog rows.

    Column fields: name, data_type, generator_type, mandatory (text), allowed_values, expand_categories.
    """
    t = specs.select("project_id", F.explode("tables").alias("t"))
    c = t.select("project_id", strip("t.table_name").alias("table_name"), F.posexplode("t.columns").alias("position", "c"))
    dtype = F.coalesce(F.nullif(strip("c.data_type"), F.lit("")), F.lit("varchar"))
    given = F.lower(strip(F.coalesce("c.generator_type", F.lit(""))))
    mandatory = F.lower(strip(F.coalesce("c.mandatory", F.lit("")))).isin("yes", "true", "1", "y")
    out = c.select(
        "project_id", "table_name", (F.col("position") + 1).alias("position"), strip("c.name").alias("column_name"), dtype.alias("data_type"),
        (~mandatory).alias("is_nullable"), F.when(given.isin(*GENERATORS), given).otherwise(type_generator(dtype)).alias("generator_type"),
        value_list("c.allowed_values").alias("allowed_values"), F.coalesce("c.expand_categories", F.lit(False)).alias("expand_categories"),
    )
    return out.where("table_name <> '' AND column_name <> ''")


def generation_settings(tables: DataFrame, settings: DataFrame, default_rows: int = 100, default_seed: int = 42) -> DataFrame:
    """Rows and seed per table; unreadable or missing settings fall back, at least one row."""

    def whole(c: str, default: int) -> Column:
        d = lenient_double(c)
        return F.coalesce(F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("bigint"), F.lit(default).cast("bigint"))

    s = settings.select("table_name", F.col("num_rows").cast("string").alias("_rows"), F.col("seed").cast("string").alias("_seed"))
    return tables.select("table_name").where(strip("table_name") != "").distinct().join(s, "table_name", "left").select(
        "table_name", F.greatest(whole("_rows", default_rows), F.lit(1)).alias("num_rows"), whole("_seed", default_seed).alias("seed")
    )


def upsert_config(columns: DataFrame, updates: DataFrame) -> DataFrame:
    """Columns with user settings applied. A changed value list clears the expanded one.

    ``updates``: column_id, data_type, generator_type, randomization_pct, allowed_values,
    allowed_values_expanded, is_pii, expand_categories, null_value_percent, min_val, max_val
    and ``stats`` (names of the statistics that were given at all).
    """
    u = updates.select("column_id", *[F.col(c).alias("u_" + c) for c in updates.columns if c != "column_id"])
    hit = F.col("u_stats").isNotNull()
    new_values, old_values = value_list("u_allowed_values"), value_list("allowed_values")

    def stat(name: str, dtype: str) -> Column:
        given = hit & F.array_contains("u_stats", name)
        value = F.nullif(strip(F.col("u_" + name).cast("string")), F.lit(""))
        return F.when(given, value.try_cast(dtype) if dtype != "string" else value).otherwise(F.col(name)).alias(name)

    changes = {
        "data_type": F.coalesce(F.nullif("u_data_type", F.lit("")), F.lit("varchar")),
        "generator_type": F.coalesce(F.nullif("u_generator_type", F.lit("")), F.lit("auto")),
        "randomization_pct": F.coalesce("u_randomization_pct", F.lit(0.0)),
        "is_pii": F.coalesce("u_is_pii", F.lit(False)),
        "expand_categories": F.coalesce("u_expand_categories", F.lit(False)),
        "allowed_values": new_values,
        "allowed_values_expanded": F.when(new_values != old_values, F.lit("")).otherwise(value_list("u_allowed_values_expanded")),
    }
    j = columns.join(u, "column_id", "left")
    kept = [c for c in columns.columns if c not in changes and c not in ("null_value_percent", "min_val", "max_val")]
    return j.select(
        *kept, *[F.when(hit, e).otherwise(F.col(n)).alias(n) for n, e in changes.items()],
        stat("null_value_percent", "double"), stat("min_val", "string"), stat("max_val", "string"),
    )


def replace_links(relations: DataFrame, fresh: DataFrame) -> DataFrame:
    """All relations of the projects named in ``fresh`` are replaced by ``fresh``."""
    return skew_join(relations, fresh.select("project_id").distinct(), ["project_id"], "left_anti").unionByName(fresh)


# --- catalog views -------------------------------------------------------------------


def table_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Every column with the project and name of its table."""
    return skew_join(columns, tables.select("table_id", "project_id", "table_name"), ["table_id"])


def columns_with_stats(columns: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every column with its profile, if there is one. Profiles that name their table are looked up inside it."""
    return columns.join(profiles, ["table_id", "column_id"] if "table_id" in profiles.columns else "column_id", "left")


def project_documents(tables: DataFrame, columns: DataFrame, page: int = 1000) -> DataFrame:
    """Nested column lists per table, in pages of ``page`` columns so that no array grows without bound."""
    named = columns.withColumn("page", F.floor((F.col("position") - 1) / page).cast("int"))
    lists = named.groupBy("table_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("position", "column_name", "data_type"))).alias("columns")
    )
    return tables.join(lists, "table_id", "left").withColumn("page", F.coalesce("page", F.lit(0)))


def delete_tables(catalog: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """The catalog without the tables in ``doomed`` (table_id), their columns, profiles and links.

    Projects that lose their last table go as well.
    """
    tables, columns, profiles, relations, projects = (catalog[k] for k in ("tables", "columns", "column_profiles", "relations", "projects"))
    gone = tables.join(doomed.select("table_id").distinct(), "table_id", "left_semi").select("project_id", "table_id", "table_name")
    tables_left = tables.join(gone.select("table_id"), "table_id", "left_anti")
    columns_left = skew_join(columns, gone.select("table_id"), ["table_id"], "left_anti")
    names = gone.select("project_id", "table_name").distinct()
    projects_left = projects.join(tables_left.select("project_id").distinct(), "project_id", "left_semi").unionByName(
        projects.join(tables.select("project_id").distinct(), "project_id", "left_anti")
    )
    links = skew_join(relations, names.withColumnRenamed("table_name", "from_table"), ["project_id", "from_table"], "left_anti")
    links = skew_join(links, names.withColumnRenamed("table_name", "to_table"), ["project_id", "to_table"], "left_anti")
    return {
        "projects": projects_left,
        "tables": tables_left,
        "columns": columns_left,
        "column_profiles": profiles.join(columns_left.select("column_id"), "column_id", "left_semi"),
        "relations": skew_join(links, projects_left.select("project_id"), ["project_id"], "left_semi"),
    }


def delete_projects(catalog: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """The catalog without the projects in ``doomed`` (project_id) and everything under them."""
    ids = doomed.select("project_id").distinct()
    tables = skew_join(catalog["tables"], ids, ["project_id"], "left_anti")
    columns = skew_join(catalog["columns"], tables.select("table_id"), ["table_id"], "left_semi")
    return {
        "projects": catalog["projects"].join(ids, "project_id", "left_anti"),
        "tables": tables,
        "columns": columns,
        "column_profiles": catalog["column_profiles"].join(columns.select("column_id"), "column_id", "left_semi"),
        "relations": skew_join(catalog["relations"], ids, ["project_id"], "left_anti"),
    }


def dedupe_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """First of the tables with the same name, row count and ordered (column, type) list.

    The ordered list is compared by a 104-bit sum of hashes tagged with the position, which
    combines before the shuffle and needs no list per table.
    """
    tag = F.md5(F.concat_ws("|", F.col("position").cast("string"), "column_name", "data_type"))

    def part(start: int) -> Column:
        return F.sum(F.conv(F.substring(tag, start, 13), 16, 10).cast("decimal(20,0)"))

    sig = columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_columns"), part(1).alias("sig_a"), part(14).alias("sig_b"))
    full = tables.join(sig, "table_id", "left").na.fill(0, ["n_columns"])
    same = ["project_id", "table_name", "row_count", "n_columns", "sig_a", "sig_b"]
    return full.groupBy(*same).agg(F.min("table_id").alias("table_id"), F.count(F.lit(1)).alias("copies")).select(
        "table_id", "project_id", "table_name", "row_count", "n_columns", "copies"
    )


# Fixed value: how a summary ends.
SUMMARY_END = ". Typical relational synthetic-data project."


def project_summaries(projects: DataFrame, tables: DataFrame, columns: DataFrame, relations: DataFrame) -> DataFrame:
    """One sentence per project: table, column and relation counts, first four table names, source."""
    w = Window.partitionBy("project_id").orderBy("position")
    shown = tables.withColumn("_r", F.row_number().over(w)).where("_r <= 4")
    names = shown.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "table_name"))), lambda s: s["table_name"]), ", ").alias("names"))
    nt = tables.groupBy("project_id").agg(F.count(F.lit(1)).alias("nt"))
    nc = columns.groupBy("project_id").agg(F.count(F.lit(1)).alias("nc"))
    nr = relations.groupBy("project_id").agg(F.count(F.lit(1)).alias("nr"))
    j = reduce(lambda a, b: a.join(b, "project_id", "left"), [projects, nt, nc, nr, names]).na.fill(0, ["nt", "nc", "nr"])
    listed = F.when(F.col("nt") == 0, F.lit("none")).when(F.col("nt") > 4, F.concat("names", F.lit(", ..."))).otherwise(F.col("names"))
    text = F.concat(
        F.col("nt").cast("string"), F.lit(" tables ("), listed, F.lit("), "), F.col("nc").cast("string"), F.lit(" columns, "),
        F.col("nr").cast("string"), F.lit(" relations; source="), F.coalesce(F.nullif("source_type", F.lit("")), F.lit("unknown")),
        F.lit(SUMMARY_END),
    )
    return j.select("project_id", F.col("nt").alias("table_count"), F.col("nc").alias("column_count"), F.col("nr").alias("relation_count"), text.alias("summary"))


def table_digests(columns: DataFrame, max_columns: int = 20, width: int = 64) -> DataFrame:
    """Per table: column count, PII count among the shown columns, and up to ``max_columns`` short column entries."""
    counts = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"))
    w = Window.partitionBy("table_name").orderBy("position")
    shown = columns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_columns)
    entry = F.concat_ws(":", "column_name", "data_type", F.coalesce(clip("min_val", width), F.lit("")), F.coalesce(clip("max_val", width), F.lit("")))
    lists = shown.groupBy("table_name").agg(
        F.count_if("is_pii").alias("pii_column_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_r"), entry.alias("entry")))), lambda s: s["entry"]), "; ").alias("columns_text"),
    )
    return counts.join(lists, "table_name")


def missing_evidence(requests: DataFrame, columns: DataFrame, relations: DataFrame) -> DataFrame:
    """For messages that ask about ``table.column``: the requested field when the catalog does not know it.

    ``columns`` carries null_percent, min, max, is_pii; names are compared without case.
    """
    low = F.lower(strip(F.coalesce("message", F.lit(""))))
    field = _case(
        [
            (F.contains(low, F.lit("null")), F.lit("null_percent")), (F.contains(low, F.lit("min")), F.lit("min")),
            (F.contains(low, F.lit("max")), F.lit("max")), (F.contains(low, F.lit("pii")), F.lit("is_pii")),
            (low.rlike("relationship|relation|foreign key|fk"), F.lit("relationship")),
        ],
        F.lit(None).cast("string"),
    )
    dotted = r"\b([a-zA-Z_]\w*)\.([a-zA-Z_]\w*)\b"
    asked = requests.select("request_id", "message", field.alias("field"), F.lower(F.regexp_extract(strip("message"), dotted, 1)).alias("t"), F.lower(F.regexp_extract(strip("message"), dotted, 2)).alias("c"))
    asked = asked.withColumn("field", F.when(F.col("t") != "", F.col("field")))
    known = columns.groupBy(F.lower(strip("table_name")).alias("t"), F.lower(strip("column_name")).alias("c")).agg(
        F.min_by(F.struct(F.col("null_percent").cast("string").alias("null_percent"), F.col("min").alias("min"), F.col("max").alias("max"), F.col("is_pii").cast("string").alias("is_pii")), "position").alias("k")
    )
    linked = locked_columns(relations).select(F.lower(strip("table_name")).alias("t"), F.lower(strip("column_name")).alias("c"), F.lit(True).alias("linked")).distinct()
    # one column may be asked about very often
    j = skew_join(asked, known.join(linked, ["t", "c"], "full"), ["t", "c"], "left")
    value = _case([(F.col("field") == f, F.col(f"k.{f}")) for f in ("null_percent", "min", "max", "is_pii")], F.lit(None).cast("string"))
    lacks = F.when(F.col("field") == "relationship", F.col("linked").isNull()).otherwise(value.isNull() | (value == ""))
    return j.select("request_id", F.col("field").alias("requested"), F.when(F.col("field").isNotNull() & lacks, F.col("field")).alias("missing"))


def graph_parts(tables: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of the schema graph; ends that are in no table become nodes too."""
    nodes = tables.select(F.col("table_name").alias("node"), F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))
    ends = relations.select(F.explode(F.array("from_table", "to_table")).alias("node")).distinct()
    extra = ends.join(nodes, "node", "left_anti").withColumn("row_count", F.lit(0).cast("bigint"))
    edges = relations.select(
        F.col("from_table").alias("source"), F.col("to_table").alias("target"), "from_column", "to_column",
        F.coalesce("cardinality", F.lit("1:N")).alias("cardinality"), F.coalesce("is_optional", F.lit(True)).alias("is_optional"),
    )
    return nodes.unionByName(extra), edges
