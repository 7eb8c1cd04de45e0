"""JSON that arrives as text: model replies and log details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import display_time
from .text import _col, blank_to_null, strip


def _object_or_null(text: Column) -> Column:
    return F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), text)


def json_object(c: Column | str) -> Column:
    """The JSON object in a reply: fences dropped, else the widest ``{...}`` span; null when there is none."""
    raw = strip(F.coalesce(_col(c), F.lit("")))
    bare = F.when(raw.startswith("```"), F.regexp_replace(F.regexp_replace(raw, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")).otherwise(raw)
    whole = F.try_parse_json(bare)
    span = F.regexp_extract(bare, r"(\{[\s\S]*\})", 1)
    return F.when(whole.isNotNull(), _object_or_null(strip(bare))).otherwise(_object_or_null(span))


def token_count(details: Column | str) -> Column:
    """``total_tokens`` of a JSON object as text, empty when missing."""
    return F.coalesce(F.get_json_object(json_details(details), "$.total_tokens"), F.lit(""))


def json_details(details: Column | str) -> Column:
    return _object_or_null(strip(F.coalesce(_col(details), F.lit(""))))


def other_details(details: Column | str) -> Column:
    """The details without ``total_tokens``, keys sorted; text that is no JSON object stays as it is."""
    raw = strip(F.coalesce(_col(details), F.lit("")))
    fields = F.map_entries(F.from_json(json_details(details), "map<string,variant>"))
    kept = F.array_sort(
        F.transform(
            F.filter(fields, lambda e: e["key"] != "total_tokens"),
            lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")),
        )
    )
    body = F.concat(
        F.lit("{"),
        F.array_join(F.transform(kept, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "),
        F.lit("}"),
    )
    return F.when(fields.isNull(), raw).when(F.size(kept) == 0, F.lit("")).otherwise(body)


def action_label(c: Column | str) -> Column:
    label = strip(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("_"), F.lit(" ")))
    return F.coalesce(blank_to_null(label), F.lit("activity"))


def activity_line(username, action, project_id, table_id, details, created_at, zone: str = "UTC") -> Column:
    """``time | user | action | project 8 chars | table 8 chars | details``; missing parts are left out."""

    def part(prefix: str, c, width: int | None) -> Column:
        t = blank_to_null(strip(F.coalesce(_col(c).cast("string"), F.lit(""))))
        return F.concat(F.lit(prefix), t if width is None else F.substring(t, 1, width))

    return F.concat_ws(
        " | ",
        display_time(created_at, zone),
        F.coalesce(blank_to_null(_col(username)), F.lit("user")),
        action_label(action),
        part("project ", project_id, 8),
        part("table ", table_id, 8),
        part("", details, None),
    )
