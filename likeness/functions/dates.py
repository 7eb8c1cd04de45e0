"""Date and time expressions: text formats, display, calendar steps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _col, strip

# Strftime codes and the Spark datetime letters that print the same.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "b": "MMM", "B": "MMMM",
    "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "j": "DDD",
}
DATE_FORMAT = "%Y-%m-%d"
TIMESTAMP_FORMAT = "%Y-%m-%d %H:%M:%S"


def spark_pattern(fmt: str) -> str:
    """Translate a strftime format; unknown codes are refused."""
    out = []
    for code, text in re.findall(r"%(.)|([^%]+)", fmt):
        if code == "%":
            out.append("'%'")
        elif code:
            if code not in STRFTIME:
                raise ValueError(f"unsupported date format code %{code} in {fmt!r}")
            out.append(STRFTIME[code])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m.group(0)}'", text.replace("'", "''")))
    return "".join(out)


def lenient_timestamp(c: Column, dtype: T.DataType | None = None) -> Column:
    """Timestamp or null, never an error."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    return F.try_to_timestamp(strip(c.cast("string")))


def format_datetime(c: Column, fmt: str, dtype: T.DataType | None = None) -> Column:
    """Formatted text; what does not parse passes through, null stays null."""
    return F.coalesce(F.date_format(lenient_timestamp(c, dtype), spark_pattern(fmt)), c.cast("string"))


def display_time(c: Column | str, zone: str = "UTC") -> Column:
    """Epoch seconds or ISO text shown in a time zone; blank is ``Never``; other text is cut to 19 characters."""
    text = strip(F.coalesce(_col(c).cast("string"), F.lit("")))
    epoch = F.when(text.rlike(r"^\d{10,}$"), F.timestamp_seconds(text.try_cast("double")))
    stamp = F.coalesce(epoch, F.try_to_timestamp(text))
    shown = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), stamp.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
    raw = F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 19)
    return F.when(text == "", F.lit("Never")).otherwise(F.coalesce(shown, raw))


# --- calendar steps ------------------------------------------------------------------

FREQUENCIES = ("D", "W", "MS", "QS", "YS", "h", "min")


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def _to_anchor(ts: Column, freq: Column, strict: bool) -> Column:
    """Days from ``ts`` to the next calendar anchor; ``strict`` moves on when already there."""
    day = ts.cast("date")
    sunday = F.pmod(F.lit(8) - F.dayofweek(day), F.lit(7))
    sunday = F.when(sunday == 0, 7).otherwise(sunday) if strict else sunday

    def to_next(unit: str, months: int) -> Column:
        first = F.trunc(day, unit)
        ahead = F.datediff(F.add_months(first, months), day)
        return ahead if strict else F.when(first == day, 0).otherwise(ahead)

    return (
        F.when(freq == "W", sunday)
        .when(freq == "MS", to_next("month", 1))
        .when(freq == "QS", to_next("quarter", 3))
        .when(freq == "YS", to_next("year", 12))
        .otherwise(F.lit(0))
    )


def roll_forward(ts: Column, freq: Column) -> Column:
    """First calendar point on or after ``ts``."""
    return ts + _days(_to_anchor(ts, freq, strict=False))


def next_point(ts: Column, freq: Column) -> Column:
    """First calendar point after ``ts``."""
    small = (
        F.when(freq == "h", F.make_dt_interval(F.lit(0), F.lit(1)))
        .when(freq == "min", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1)))
        .when(freq == "D", F.make_dt_interval(F.lit(1)))
        .otherwise(_days(_to_anchor(ts, freq, strict=True)))
    )
    return ts + small


def calendar_step(anchor: Column, freq: Column, i: Column) -> Column:
    """The ``i``-th calendar point counted from an anchor."""
    n = i.cast("int")
    zero = F.lit(0)
    months = F.when(freq == "MS", n).when(freq == "QS", n * 3).when(freq == "YS", n * 12)
    days = F.when(freq == "D", n).when(freq == "W", n * 7).otherwise(zero)
    hours = F.when(freq == "h", n).otherwise(zero)
    minutes = F.when(freq == "min", n).otherwise(zero)
    return F.when(months.isNotNull(), anchor + F.make_ym_interval(zero, months)).otherwise(
        anchor + F.make_dt_interval(days, hours, minutes)
    )
