"""What one pass over a table learns about all its columns.

Every task keeps, per column, counts, moments, bounds, a sketch of the distinct values and, where
wanted, a summary of the frequent ones and the smallest ones; all of them merge. A task sends one row
per column, a second step adds those rows up, so a shuffle moves (tasks x columns) small rows
whatever the length of the table or of its texts.

A value is known by a 128-bit key: numbers and times by themselves, texts by a digest. The sketch
holds the ``SKETCH`` smallest hashes of the keys (exact below that many values, 1.6 % standard error
beyond, and mergeable). The frequent values are a Misra-Gries summary: a value that it does not
hold has at most ``error`` rows, and a value's count is too small by at most ``error``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quote
from .joins import shuffle_width

SKETCH = 4096
SPACE = float(1 << 63)
HELD_ROWS, HELD_BYTES = 100_000, 16 << 20  # distinct values a task holds per column before it turns them into keys
SHORT = 200  # characters of a frequent value that is kept as text


def keys_of(values) -> tuple:
    """128-bit keys of an Arrow array without nulls, as two int64 arrays."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        raw = b"".join(hashlib.blake2b(v.encode(), digest_size=16).digest() for v in values.to_pylist())
        both = np.frombuffer(raw, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]
    if pa.types.is_decimal(kind):
        both = np.frombuffer(values.buffers()[1], np.int64).reshape(-1, 2)[values.offset : values.offset + len(values)]
        return both[:, 0], both[:, 1]
    if pa.types.is_floating(kind):
        x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
        x[np.isnan(x)] = np.nan
        a = x.view(np.int64)
    elif pa.types.is_date(kind):
        a = values.cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        a = values.cast(pa.int64()).to_numpy(zero_copy_only=False)
    return a, np.zeros(len(a), np.int64)


def _mixed(x):
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashes_of(a, b):
    """Hashes 0 .. 2**63 - 1 of keys."""
    salt = np.uint64(0x9E3779B97F4A7C15)
    return (_mixed(_mixed(a.view(np.uint64) + salt) ^ _mixed(b.view(np.uint64) + salt + salt)) >> np.uint64(1)).astype(np.int64)


def added_up(a, b, n) -> tuple:
    """Keys with their counts, each key once; (a, b, n, place of a row with that key)."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[heads], b[heads], np.add.reduceat(n, heads) if len(a) else n, order[heads]


class Distinct:
    """Distinct values of a column with their counts, a bounded number at a time."""

    def __init__(self):
        self.parts, self.rows, self.bytes = [], 0, 0

    def add(self, column) -> bool:
        """Takes a column without nulls; true when it is time to ``take`` them."""
        if len(column):
            self._keep(pc.value_counts(column))
        if self.rows < HELD_ROWS and self.bytes < HELD_BYTES:
            return False
        if len(self.parts) > 1:
            values, counts = self._together()
            self.parts, self.rows, self.bytes = [(values, counts)], len(values), values.nbytes
        return self.rows > HELD_ROWS // 2 or self.bytes > HELD_BYTES // 2

    def _keep(self, found):
        values, counts = found.field(0), found.field(1)
        self.parts.append((values, counts))
        self.rows += len(values)
        self.bytes += values.nbytes

    def _together(self):
        values = pa.concat_arrays([v for v, _ in self.parts])
        t = pa.table({"v": values, "n": pa.concat_arrays([n for _, n in self.parts])}).group_by("v").aggregate([("n", "sum")]).combine_chunks()
        one = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
        return one(t.column("v")), one(t.column("n_sum"))

    def take(self):
        """(values, counts) held, which are then forgotten; None if there are none."""
        if not self.parts:
            return None
        out = self.parts[0] if len(self.parts) == 1 else self._together()
        self.__init__()
        return out


class Frequent:
    """Misra-Gries summary of keys with counts, and the text of short values."""

    def __init__(self, size: int):
        self.size, self.error = size, 0
        self.a = self.b = self.n = np.zeros(0, np.int64)
        self.text = np.zeros(0, object)

    def add(self, a, b, n, text, error: int = 0):
        texts = np.concatenate([self.text, text])
        self.a, self.b, self.n, at = added_up(np.concatenate([self.a, a]), np.concatenate([self.b, b]), np.concatenate([self.n, n]))
        self.text = texts[at]
        self.error += error
        if len(self.n) > self.size:
            less = int(np.partition(self.n, len(self.n) - self.size - 1)[len(self.n) - self.size - 1])
            self.error += less
            stay = self.n > less
            self.a, self.b, self.n, self.text = self.a[stay], self.b[stay], self.n[stay] - less, self.text[stay]


class Summary:
    """All that is kept of one column."""

    def __init__(self, number: bool, frequent: int = 0, smallest: int = 0):
        self.number, self.smallest = number, smallest
        self.rows = self.filled = 0
        self.low = self.high = None
        self.mean = self.m2 = 0.0
        self.sketch = np.zeros(0, np.int64)
        self.frequent = Frequent(frequent) if frequent else None
        self.least: list[str] = []
        self.distinct = Distinct()

    def add(self, column):
        self.rows += len(column)
        column = column.drop_null()
        if not len(column):
            return
        if self.number:
            x = (column.cast(pa.float64()) if pa.types.is_decimal(column.type) else column).to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(all="ignore"):
                mean = float(x.mean())
                self.moments(len(x), mean, float(((x - mean) ** 2).sum()))
        self.filled += len(column)
        self.bounds(*_bounds(column))
        if self.distinct.add(column):
            self.settle()

    def moments(self, n: int, mean: float, m2: float):
        """Adds the moments of ``n`` further values (those of ``filled`` are known)."""
        total, away = self.filled + n, mean - self.mean
        self.m2 += m2 + away * away * self.filled * n / total
        self.mean += away * n / total

    def bounds(self, low, high):
        if low is not None and (self.low is None or _before(low, self.low)):
            self.low = low
        if high is not None and (self.high is None or _before(self.high, high)):
            self.high = high

    def settle(self):
        got = self.distinct.take()
        if got is None:
            return
        values, counts = got
        a, b = keys_of(values)
        self.sketched(hashes_of(a, b))
        if self.frequent:
            short = pc.less_equal(pc.utf8_length(values), SHORT)
            text = np.array(pc.if_else(short, values, None).to_pylist() + [None], object)[:-1]
            self.frequent.add(a, b, counts.to_numpy(), text)
        if self.smallest:
            first = values.take(pc.bottom_k_unstable(values, min(self.smallest, len(values))))
            self.low_values(first.to_pylist())

    def sketched(self, hashes):
        self.sketch = np.unique(np.concatenate([self.sketch, hashes]))[:SKETCH]

    def low_values(self, values):
        self.least = sorted({*self.least, *values})[: self.smallest]


def _before(x, y) -> bool:
    """Whether x sorts before y; NaN comes last."""
    return not _nan(x) and (_nan(y) or x < y)


def _nan(x) -> bool:
    return isinstance(x, float) and x != x


def _bounds(column) -> tuple:
    if pa.types.is_floating(column.type):
        nan = pc.is_nan(column)
        real = column.filter(pc.invert(nan))
        got = pc.min_max(real).as_py() if len(real) else {"min": float("nan"), "max": float("nan")}
        return got["min"], float("nan") if len(real) < len(column) else got["max"]
    got = pc.min_max(column)
    return (got["min"].value, got["max"].value) if pa.types.is_timestamp(column.type) else (got["min"].as_py(), got["max"].as_py())


def slot_types(df: DataFrame, columns: list[str]) -> list[T.DataType]:
    """The types of ``columns``, each once: bounds travel in a field of their own type."""
    kinds: list[T.DataType] = []
    for c in columns:
        kind = _plain(df.schema[c].dataType)
        if kind not in kinds:
            kinds.append(kind)
    return kinds


def slots(df: DataFrame, columns: list[str]) -> list[int]:
    """Per column the place of its type in ``slot_types``."""
    kinds = slot_types(df, columns)
    return [kinds.index(_plain(df.schema[c].dataType)) for c in columns]


def _plain(kind: T.DataType) -> T.DataType:
    """The type that a column is read in; what Arrow has no order for is read as text."""
    known = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return kind if isinstance(kind, known) else T.StringType()


def summarize(df: DataFrame, columns: list[str], frequent: int = 0, smallest: int = 0) -> DataFrame:
    """One row per column (none for an empty table): position, n, filled, low{k} and high{k} (per type), mean, m2, sketch, keys, error, least.

    ``frequent``: size of the summary of frequent values and ``smallest``: number of smallest values (both for texts only).
    ``keys`` holds (a, b, n, text) of the frequent values.
    """
    kinds, slot = slot_types(df, columns), slots(df, columns)
    number = [isinstance(df.schema[c].dataType, T.NumericType) for c in columns]
    view = df.select(*[F.col(quote(c)).cast(kinds[k]).alias(f"c{i}") for i, (c, k) in enumerate(zip(columns, slot))])
    entry = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType()), T.StructField("text", T.StringType())])
    fields = [T.StructField("position", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("filled", T.LongType())]
    fields += [T.StructField(f"{w}{k}", kind) for k, kind in enumerate(kinds) for w in ("low", "high")]
    fields += [T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(entry))]
    fields += [T.StructField("error", T.LongType()), T.StructField("least", T.ArrayType(T.StringType()))]
    schema = T.StructType(fields)
    names = [f.name for f in fields]

    def row_batch(arrow, rows: dict):
        columns = {n: [] for n in names}
        for i, s in rows.items():
            s.settle()
            f = s.frequent
            mine = {
                "position": i, "n": s.rows, "filled": s.filled, f"low{slot[i]}": s.low, f"high{slot[i]}": s.high, "mean": s.mean, "m2": s.m2, "sketch": s.sketch,
                "keys": [dict(zip("abn", x[:3]), text=x[3]) for x in zip(f.a.tolist(), f.b.tolist(), f.n.tolist(), f.text.tolist())] if f else None, "error": f.error if f else 0, "least": s.least,
            }
            for n in names:
                columns[n].append(mine.get(n))
        return pa.RecordBatch.from_arrays([pa.array(columns[n], arrow[n]) for n in names], names)

    def arrow_types(spark_schema):
        from pyspark.sql.pandas.types import to_arrow_type

        return {f.name: to_arrow_type(f.dataType) for f in spark_schema.fields}

    def scan(batches):
        found: dict = {}
        for batch in batches:
            for i in range(batch.num_columns):
                if i not in found:
                    found[i] = Summary(number[i], frequent, smallest)
                found[i].add(batch.column(i))
        if found:
            yield row_batch(arrow_types(schema), found)

    def merge(batches):
        found: dict = {}
        for batch in batches:
            where = {n: batch.schema.get_field_index(n) for n in names}
            col = lambda n, r: batch.column(where[n])[r]  # noqa: B023,E731
            for r in range(batch.num_rows):
                i = col("position", r).as_py()
                s = found.setdefault(i, Summary(number[i], frequent, smallest))
                filled = col("filled", r).as_py()
                if filled:
                    with np.errstate(all="ignore"):
                        s.moments(filled, col("mean", r).as_py(), col("m2", r).as_py())
                s.rows += col("n", r).as_py()
                s.filled += filled
                ends = [col(f"{w}{slot[i]}", r) for w in ("low", "high")]
                s.bounds(*[e.value if pa.types.is_timestamp(e.type) and e.is_valid else e.as_py() for e in ends])
                s.sketched(col("sketch", r).values.to_numpy(zero_copy_only=False))
                if frequent:
                    k = col("keys", r).values
                    a, b, n = (k.field(x).to_numpy(zero_copy_only=False) for x in ("a", "b", "n"))
                    s.frequent.add(a, b, n, np.array(k.field("text").to_pylist() + [None], object)[:-1], col("error", r).as_py())
                if smallest:
                    s.low_values(col("least", r).as_py())
        if found:
            yield row_batch(arrow_types(schema), found)

    return view.mapInArrow(scan, schema).repartition(max(1, min(len(columns), shuffle_width(df))), "position").mapInArrow(merge, schema)


def estimate(sketch: Column) -> Column:
    """Number of distinct values behind a sketch: exact below ``SKETCH``."""
    return F.when(F.size(sketch) < SKETCH, F.size(sketch).cast("bigint")).otherwise(F.round(F.lit((SKETCH - 1) * SPACE) / F.element_at(sketch, -1)).cast("bigint"))


def key_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, a, b, n): every distinct value of every column by its key, with its rows; one scan, one shuffle of 32 bytes a value."""
    kinds = [_plain(df.schema[c].dataType) for c in columns]
    view = df.select(*[F.col(quote(c)).cast(k).alias(f"c{i}") for i, (c, k) in enumerate(zip(columns, kinds))])

    def scan(batches):
        held = {}
        for batch in batches:
            for i in range(batch.num_columns):
                d = held.setdefault(i, Distinct())
                if d.add(batch.column(i).drop_null()):
                    yield rows(i, d)
        for i, d in held.items():
            if d.parts:
                yield rows(i, d)

    def rows(i, d):
        values, counts = d.take()
        a, b, n, _ = added_up(*keys_of(values), counts.to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), i, np.int32)), pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], ["position", "a", "b", "n"])

    return view.mapInArrow(scan, "position int, a long, b long, n long").groupBy("position", "a", "b").agg(F.sum("n").alias("n"))


def fetch(df: DataFrame, columns: list[str], wanted: dict[int, tuple]) -> DataFrame:
    """(position, value, n): the texts and exact rows of the values of ``columns`` (texts) with the ``wanted`` keys, (a, b) arrays per position."""
    view = df.select(*[F.col(quote(columns[i])).cast("string").alias(f"c{i}") for i in wanted])
    wanted = {i: tuple(map(np.asarray, ab)) for i, ab in wanted.items()}

    def scan(batches):
        sets = {i: set(zip(a.tolist(), b.tolist())) for i, (a, b) in wanted.items()}
        found: dict[int, dict[str, int]] = {i: {} for i in wanted}
        held = {i: Distinct() for i in wanted}

        def settle(i):
            got = held[i].take()
            if got is None:
                return
            a, b = keys_of(got[0])
            for j in np.flatnonzero(np.isin(a, wanted[i][0])).tolist():
                if (int(a[j]), int(b[j])) in sets[i]:
                    v = got[0][j].as_py()
                    found[i][v] = found[i].get(v, 0) + got[1][j].as_py()

        for batch in batches:
            for place, i in enumerate(wanted):
                if held[i].add(batch.column(place).drop_null()):
                    settle(i)
        for i in wanted:
            settle(i)
        rows = [(i, v, n) for i, some in found.items() for v, n in some.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64()))], ["position", "value", "n"])

    return view.mapInArrow(scan, "position int, value string, n long").groupBy("position", "value").agg(F.sum("n").alias("n"))
