"""Random columns that depend on (seed, stream, row id) and nothing else.

The same seed gives the same rows under any partitioning, after a task retry and in
any SQL engine that has MD5. ``fast_u`` trades that portability for speed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
SPACE = 1 << 52  # 13 hex digits
UNIT = float(SPACE)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _digest(seed: int, stream: str, ids) -> Column:
    ids = ids if isinstance(ids, (list, tuple)) else [ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[_col(i).cast("string") for i in ids]))


def _hex(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, HEX_DIGITS), 16, 10).cast("bigint")


def bits(seed: int, stream: str, ids) -> Column:
    """BIGINT, uniform on 0 .. 2^52-1."""
    return _hex(_digest(seed, stream, ids), 1)


def u(seed: int, stream: str, ids) -> Column:
    """DOUBLE, uniform on [0, 1)."""
    return bits(seed, stream, ids) / F.lit(UNIT)


def below(seed: int, stream: str, ids, n) -> Column:
    """BIGINT, uniform on 0 .. n-1; ``n`` is a number or a column."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    return F.floor(u(seed, stream, ids) * n).cast("bigint")


def normal(seed: int, stream: str, ids) -> Column:
    """Standard normal by Box-Muller, both uniforms cut from one digest."""
    d = _digest(seed, stream, ids)
    a = (_hex(d, 1) + F.lit(1)) / F.lit(UNIT + 1.0)
    b = _hex(d, 1 + HEX_DIGITS) / F.lit(UNIT)
    return F.sqrt(F.lit(-2.0) * F.log(a)) * F.cos(F.lit(2.0 * math.pi) * b)


def pick(values: list, index: Column) -> Column:
    """The literal at a 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def pick_weighted(entries: list[tuple], draw: Column) -> Column:
    """Value whose cumulative weight interval holds ``draw``; exact weights, last value takes the rest."""
    total, cuts = 0.0, []
    for value, weight in entries:
        total += weight
        cuts.append((value, total))
    live = [i for i, (_, w) in enumerate(entries) if w > 0]
    last = live[-1] if live else len(entries) - 1
    chain = reduce(
        lambda acc, vc: F.when(draw < F.lit(vc[1]), F.lit(vc[0])) if acc is None else acc.when(draw < F.lit(vc[1]), F.lit(vc[0])),
        cuts[:last],
        None,
    )
    end = F.lit(cuts[last][0])
    return end if chain is None else chain.otherwise(end)


def fast_u(seed: int, stream: str, ids) -> Column:
    """DOUBLE on [0, 1) from a 64-bit hash; several times cheaper than ``u``, Spark only."""
    ids = ids if isinstance(ids, (list, tuple)) else [ids]
    h = F.xxhash64(F.lit(seed).cast("bigint"), F.lit(stream), *[_col(i) for i in ids])
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
