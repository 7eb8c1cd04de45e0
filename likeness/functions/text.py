"""Text expressions: value lists, names, clipping, lenient parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
LIST_SPLIT = "[\n,;]+"
LIST_SPLIT_PIPE = "[\n,;|]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote(name: str) -> str:
    """A user column name as a Spark identifier."""
    return "`" + str(name).replace("`", "``") + "`"


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# --- names ---------------------------------------------------------------------------


def snake(c: Column | str) -> Column:
    """Lower case, other runs than letters, digits and underscores become one underscore."""
    return F.btrim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9_]+", "_"), F.lit("_"))


def tokens_name(c: Column | str) -> Column:
    """As ``snake`` but underscores collapse as well."""
    return F.btrim(F.regexp_replace(F.lower(strip(c)), NAME_RUNS, "_"), F.lit("_"))


NAME_RUNS = "[^a-z0-9]+"


def plain_name(text) -> str:
    """``tokens_name`` of one name held by the driver."""
    return "_".join(filter(None, re.split(NAME_RUNS, str(text).lower())))


def tight(c: Column | str) -> Column:
    """Only lower-case letters and digits remain."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]", "")


def singular(c: Column) -> Column:
    n = F.length(c)
    return (
        F.when(c.endswith("ies") & (n > 3), F.concat(F.substring(c, F.lit(1), n - 3), F.lit("y")))
        .when(c.endswith("ses") & (n > 3), F.substring(c, F.lit(1), n - 2))
        .when(c.endswith("s") & (n > 1), F.substring(c, F.lit(1), n - 1))
        .otherwise(c)
    )


def has_any(c: Column, hints: list[str]) -> Column:
    """True when one of the plain-text hints occurs in the column."""
    return c.rlike("|".join(hints))


def has_token(c: Column, hints: list[str]) -> Column:
    """True when a hint stands as a whole underscore-separated word group."""
    return c.rlike("(^|_)(" + "|".join(hints) + ")(_|$)")


# --- value lists ---------------------------------------------------------------------


def value_array(c: Column | str, pipes: bool = False) -> Column:
    parts = F.split(F.coalesce(_col(c).cast("string"), F.lit("")), LIST_SPLIT_PIPE if pipes else LIST_SPLIT)
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda x: x != ""))


def value_list(c: Column | str, pipes: bool = False) -> Column:
    """Comma list with trimmed, non-blank, distinct values in first-seen order."""
    return F.array_join(value_array(c, pipes), ", ")


def weighted_values(c: Column | str) -> Column:
    """``A|3, B|1`` as ARRAY<STRUCT<value, weight>>, weights adding up to 1, first spelling kept."""
    parts = F.filter(
        F.transform(F.split(F.coalesce(_col(c).cast("string"), F.lit("")), LIST_SPLIT), strip), lambda x: x != ""
    )

    def entry(x: Column) -> Column:
        raw = strip(F.regexp_extract(x, r"^([\s\S]*)\|([^|]*)$", 2))
        weight = F.coalesce(raw.try_cast("double"), F.lit(1.0))
        value = F.when(F.contains(x, F.lit("|")), strip(F.regexp_extract(x, r"^([\s\S]*)\|([^|]*)$", 1))).otherwise(x)
        weight = F.when(F.contains(x, F.lit("|")), F.greatest(weight, F.lit(0.0))).otherwise(F.lit(1.0))
        return F.struct(value.alias("value"), weight.alias("weight"))

    entries = F.filter(F.transform(parts, entry), lambda e: e["value"] != "")
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda o: o["value"]), e["value"]) == i + 1)
    total = F.aggregate(first, F.lit(0.0), lambda a, e: a + e["weight"])
    return F.transform(
        first,
        lambda e: F.struct(
            e["value"].alias("value"),
            F.when(total > 0, e["weight"] / F.nullif(total, F.lit(0.0)))
            .otherwise(F.lit(1.0) / F.greatest(F.size(first), F.lit(1)))
            .alias("weight"),
        ),
    )


def parse_weighted(text) -> list[tuple[str, float]]:
    """The same rule for one setting held by the driver."""
    entries: dict[str, float] = {}
    for part in (p.strip() for p in re.split(LIST_SPLIT, str(text or ""))):
        value, sep, weight = part.rpartition("|")
        if not sep:
            value, number = part, 1.0
        else:
            try:
                number = max(0.0, float(weight))
            except ValueError:
                number = 1.0
        value = value.strip()
        if value:
            entries.setdefault(value, number)
    total = sum(entries.values())
    if total <= 0:
        return [(v, 1.0 / len(entries)) for v in entries]
    return [(v, w / total) for v, w in entries.items()]


def resolve_values(expand: Column, manual: Column, expanded: Column) -> Column:
    """Expanded list when asked for and present, else the manual one, else the expanded one."""
    m, e = blank_to_null(value_list(manual)), blank_to_null(value_list(expanded))
    return F.coalesce(F.when(F.coalesce(expand, F.lit(False)), e), m, e, F.lit(""))


def list_like(c: Column | str, items: int = 8, width: int = 40) -> Column:
    """A JSON array or a comma list as an array of clipped values."""
    raw = strip(F.coalesce(_col(c), F.lit("")))
    as_json = F.when(raw.startswith("[") & raw.endswith("]"), F.from_json(raw, "array<string>"))
    plain = F.filter(F.transform(F.split(raw, ","), strip), lambda x: x != "")
    parsed = F.when(F.size(as_json) > 0, as_json).otherwise(plain)
    return F.filter(F.transform(F.slice(parsed, 1, items), lambda x: clip(x, width)), lambda x: x.isNotNull())


# --- display -------------------------------------------------------------------------


def clip(c: Column | str, width: int = 64) -> Column:
    """Trimmed text, cut with three dots beyond ``width``; blank becomes null."""
    t = strip(_col(c).cast("string"))
    return F.when(t == "", None).when(F.length(t) <= width, t).otherwise(F.concat(F.substring(t, 1, width), F.lit("...")))


def squash(c: Column | str, width: int = 280) -> Column:
    """Single spaces, cut to ``width`` characters including the dots."""
    t = strip(F.regexp_replace(_col(c), r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(t, 1, width - 3)), F.lit("..."))
    return F.when(F.length(t) > width, cut).otherwise(t)


def byte_text(c: Column | str) -> Column:
    n = F.coalesce(_col(c).cast("bigint"), F.lit(0)).cast("double")
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n <= 0, F.lit("0 B"))
        .when(n < kb, F.format_string("%.0f B", n))
        .when(n < mb, F.format_string("%.2f KB", n / kb))
        .when(n < gb, F.format_string("%.2f MB", n / mb))
        .otherwise(F.format_string("%.2f GB", n / gb))
    )


def plain_number(c: Column) -> Column:
    """A double as text without exponents."""
    a = F.abs(c)
    wide = F.regexp_replace(c.cast("decimal(38,9)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(((a >= 1e-3) & (a < 1e7)) | (a == 0) | F.isnan(c) | (a == float("inf")), c.cast("string")).otherwise(wide)


# --- lenient parsing -----------------------------------------------------------------


def lenient_double(c: Column | str) -> Column:
    t = F.lower(strip(_col(c).cast("string")))
    return F.when(~t.isin("", "none", "nan", "null"), t.try_cast("double"))


def date_text(c: Column | str) -> Column:
    """The date part of ISO-like text, other text unchanged."""
    t = strip(F.coalesce(_col(c).cast("string"), F.lit("")))
    return F.when(t.rlike("^.{4}-.{2}-"), F.when(F.length(t) >= 10, F.substring(t, 1, 10)).otherwise(t)).otherwise(t)


def digit_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_col(c), r"\D+", ""))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


YES_WORDS = frozenset({"1", "true", "yes", "y"})  # fixed values


def yes_no(value) -> bool:
    """A setting given as a boolean, a number or a word."""
    return value.strip().lower() in YES_WORDS if isinstance(value, str) else bool(value)
