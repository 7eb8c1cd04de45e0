"""Personal data: detection from names and values, and masking."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import random as R
from ..functions.text import digit_count, has_any, has_token, quote, snake, strip
from .profile import _batches, long_values, value_sample

# Name hints and scores, tested in this order.
NAME_HINTS = [
    ("email", 0.92, ["email", "mail", "e_mail"]),
    ("phone", 0.90, ["phone", "mobile", "contact", "telephone", "tel"]),
    ("ssn", 0.96, ["ssn", "social_security", "social_security_number", "tax_id", "pan"]),
    ("card", 0.93, ["card", "credit_card", "debit_card", "cc_num", "card_number", "cvv"]),
    ("address", 0.86, ["address", "street", "city", "state", "zip", "zipcode", "postal", "postcode"]),
    ("person_name", 0.86, ["name", "first_name", "last_name", "full_name", "customer_name", "employee_name"]),
]
# Whole-value patterns; a phone also needs ten digits.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE = r"^\+?[0-9][0-9\-\s()]{7,}[0-9]$"
SSN = r"^\d{3}-\d{2}-\d{4}$"
CARD = r"^\d{13,19}$"
VALUE_KINDS = ["email", "phone", "ssn", "card"]  # ties go to the earlier kind
WEAK_VALUES, WEAK_ENTITIES, PII_FROM = 0.25, 0.35, 0.60


def name_signal(name: Column | str, match: str = "contains") -> Column:
    """STRUCT<pii_type, score> from a column name; ``match='token'`` wants whole words."""
    n = snake(name)
    hit = has_any if match == "contains" else has_token
    unknown = F.struct(F.lit("unknown").alias("pii_type"), F.lit(0.0).alias("score"))
    rules = [(hit(n, hints), F.struct(F.lit(kind).alias("pii_type"), F.lit(score).alias("score"))) for kind, score, hints in NAME_HINTS]
    chain = F.when(*rules[0])
    for cond, value in rules[1:]:
        chain = chain.when(cond, value)
    return chain.otherwise(unknown)


def value_tests(v: Column) -> dict[str, Column]:
    """One boolean per kind for a trimmed value."""
    return {
        "email": v.rlike(EMAIL),
        "phone": v.rlike(PHONE) & (digit_count(v) >= 10),
        "ssn": v.rlike(SSN),
        "card": v.rlike(CARD),
    }


def value_hits(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_values, email, phone, ssn, card) counts over all rows, blanks left out."""

    def batch(names: list[str]) -> DataFrame:
        aggs = []
        for i, name in enumerate(names):
            v = strip(F.col(quote(name)).cast("string"))
            aggs.append(F.count_if(v != "").alias(f"n{i}"))
            aggs += [F.count_if(t).alias(f"{k}{i}") for k, t in value_tests(v).items()]
        row = df.agg(*aggs)
        cells = [
            F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("n_values"), *[F.col(f"{k}{i}").alias(k) for k in VALUE_KINDS])
            for i, n in enumerate(names)
        ]
        return row.select(F.inline(F.array(*cells)))

    return reduce(DataFrame.unionByName, [batch(b) for b in _batches(columns)])


def _best(ratios: dict[str, Column], weak: float, top: float, base: float, slope: float) -> Column:
    order = list(ratios)
    best = F.greatest(*ratios.values())
    kind = F.lit(order[-1])
    for k in reversed(order[:-1]):
        kind = F.when(ratios[k] == best, F.lit(k)).otherwise(kind)
    strong = best >= weak
    return F.struct(
        F.when(strong, kind).otherwise(F.lit("unknown")).alias("pii_type"),
        F.when(strong, F.least(F.lit(top), F.lit(base) + best * slope)).otherwise(F.lit(0.0)).alias("score"),
    )


def value_signal(hits: DataFrame) -> DataFrame:
    """Adds STRUCT ``regex`` (pii_type, score) to ``value_hits`` rows."""
    n = F.greatest(F.col("n_values"), F.lit(1))
    return hits.withColumn("regex", _best({k: F.col(k) / n for k in VALUE_KINDS}, WEAK_VALUES, 0.98, 0.55, 0.45))


def entity_signal(samples: DataFrame, tagger: Callable[[list[str]], Iterable[set[str]]]) -> DataFrame:
    """(column, ner) from a named-entity tagger applied to (column, value) rows in Arrow batches.

    ``tagger`` gets a list of texts and gives one set of labels per text (PERSON, GPE, LOC, ORG).
    """

    def tag(batches):
        for pdf in batches:
            labels = list(tagger(pdf["value"].tolist()))
            yield pd.DataFrame(
                {
                    "column": pdf["column"],
                    "person": ["PERSON" in s for s in labels],
                    "place": ["GPE" in s or "LOC" in s for s in labels],
                    "org": ["ORG" in s for s in labels],
                }
            )

    clean = samples.select("column", strip("value").alias("value")).where("value <> ''")
    marks = clean.mapInPandas(tag, "column string, person boolean, place boolean, org boolean")
    g = marks.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("person").alias("p"), F.count_if("place").alias("l"), F.count_if("org").alias("o")
    )
    ratios = {"person_name": F.col("p") / F.col("n"), "address": F.col("l") / F.col("n"), "organization": F.col("o") / F.col("n")}
    return g.select("column", _best(ratios, WEAK_ENTITIES, 0.90, 0.50, 0.40).alias("ner"))


def decide(signals: DataFrame, match: str = "contains") -> DataFrame:
    """Final verdict per row with ``column`` and optional STRUCTs ``regex`` and ``ner``; earlier signals win ties."""
    none = F.struct(F.lit("unknown").alias("pii_type"), F.lit(0.0).alias("score"))
    s = signals.withColumn("name", name_signal("column", match))
    for part in ("regex", "ner"):
        s = s.withColumn(part, F.coalesce(F.col(part), none) if part in signals.columns else none)
    best = F.greatest("name.score", "regex.score", "ner.score")
    kind = (
        F.when(best <= 0, F.lit("unknown"))
        .when(F.col("name.score") == best, F.col("name.pii_type"))
        .when(F.col("regex.score") == best, F.col("regex.pii_type"))
        .otherwise(F.col("ner.pii_type"))
    )
    keep = [c for c in signals.columns if c not in ("regex", "ner", "n_values", *VALUE_KINDS)]
    return s.select(
        *keep, (best >= PII_FROM).alias("is_pii"), kind.alias("pii_type"), F.round(best, 4).alias("confidence"),
        F.round("name.score", 4).alias("name_score"), F.round("regex.score", 4).alias("regex_score"), F.round("ner.score", 4).alias("ner_score"),
    )


def detect(
    df: DataFrame,
    columns: list[str] | None = None,
    tagger: Callable | None = None,
    ids: list[str] | None = None,
    match: str = "contains",
    entity_values: int | None = None,
) -> DataFrame:
    """PII verdict for the columns of a table; value patterns are counted over every row."""
    columns = columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    signals = value_signal(value_hits(df, columns))
    if tagger is not None:
        if not ids:
            raise ValueError("entity tagging needs the id columns of the table")
        samples = value_sample(df, columns, ids, entity_values) if entity_values else long_values(df, columns, ids)
        signals = signals.join(F.broadcast(entity_signal(samples, tagger)), "column", "left")
    return decide(signals, match)


# --- masking -------------------------------------------------------------------------


# Parts of a column name, and what stands before and after a number from ``low`` up to, without, ``high``.
MASKS = [
    (["email"], "user", 100000, 999999, "@example.com"),
    (["phone", "mobile", "contact"], "+1", 2000000000, 9999999999, ""),
    (["name"], "Person_", 10000, 99999, ""),
    (["address", "street"], "Address_", 10000, 99999, ""),
    ([""], "masked_", 100000, 999999, ""),
]


def mask(name: str, value: Column, ids, seed: int, consistent: bool = False) -> Column:
    """A stand-in for a value, shaped by the first entry of ``MASKS`` that the column name fits; null stays null.

    ``consistent`` draws from the value itself, so equal values stay equal across tables.
    """
    column = name.lower()
    before, low, high, after = next(shape for parts, *shape in MASKS if any(p in column for p in parts))
    draw = R.below(seed, "mask", [value], high - low) if consistent else R.below(seed, f"{column}.mask", ids, high - low)
    return F.when(value.isNotNull(), F.concat(F.lit(before), (draw + low).cast("string"), F.lit(after)))


def anonymize(df: DataFrame, columns: list[str], ids: list[str], seed: int = 42, consistent: bool = False) -> DataFrame:
    """Replace the given columns by masked text."""
    return df.withColumns({c: mask(c, F.col(quote(c)), ids, seed, consistent) for c in columns})
