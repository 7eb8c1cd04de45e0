"""Registered queries on time series: events per type (and per user) are the series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import random as R
from ..functions.dates import FREQUENCIES, calendar_step, next_point, roll_forward
from ..operators import series as S
from ..operators import seriesgen as SG
from ..operators.rows import ordered_index
from ..operators.stl import stl
from .common import load, sql_below, sql_normal, sql_pick, sql_u

BLOCK = 512  # small blocks, so that series cross block edges at test size


def events(spark, d) -> DataFrame:
    return load(spark, d, "events").select("event_type", "user_id", "event_id", "ts", "value")


def indexed(spark, d, key: str = "event_type") -> DataFrame:
    return ordered_index(events(spark, d), [key], ["ts", "event_id"])


def _ev(key: str = "event_type") -> str:
    return f"""ev AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY {key}) AS n FROM events)"""


def _steps_sql(key: str) -> str:
    return f"""{_ev(key)}, st AS (SELECT {key}, t, step FROM (SELECT {key}, t, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY t)) / 1e6::DOUBLE AS step FROM ev) WHERE step IS NOT NULL)"""


_FREQ = "CASE WHEN coalesce(m, 0) <= 0 THEN 'D' " + " ".join(f"WHEN m < {limit} THEN '{name}'" for limit, name in S.STEP_LIMITS) + " ELSE 'YS' END"


def ts_steps(spark, d):
    s = S.steps(indexed(spark, d), ["event_type"], "ts", rows=BLOCK)
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("step"), 3).alias("seconds"), F.max("step").alias("longest"))


def ts_median_step(spark, d):
    return S.median_step(indexed(spark, d), ["event_type"], "ts")


def ts_frequency(spark, d):
    return S.frequencies(indexed(spark, d, "user_id"), ["user_id"], "ts", rows=BLOCK)


def ts_frequency_classes(spark, d):
    """Calendar-like series: every event repeats its user's own step; all frequency classes occur."""
    e = events(spark, d)
    step = R.pick([30, 3600, 86400, 7 * 86400, 30 * 86400, 91 * 86400, 365 * 86400], F.col("user_id") % 7)
    start = F.lit("2000-01-01").cast("timestamp_ntz")
    s = ordered_index(e, ["user_id"], ["ts", "event_id"])
    s = s.withColumn("at", start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.least(F.col("t"), F.lit(20)) * step).cast("decimal(18,6)")))
    return S.frequencies(s, ["user_id"], "at", rows=BLOCK)


def season_lengths(spark, d):
    """Season rule over every event as a (frequency, length) question."""
    e = load(spark, d, "events")
    freq = R.pick(list(FREQUENCIES), R.below(1, "freq", "event_id", len(FREQUENCIES)))
    q = e.select("event_id", freq.alias("freq"), R.below(1, "n", "event_id", 1000).alias("n"))
    return q.withColumn("season", S.season_length(F.col("freq"), F.col("n"))).withColumn("period", S.season_period(F.col("season"), F.col("n")))


_SEASON = """CASE WHEN freq = 'D' THEN CASE WHEN n >= 730 THEN 365 WHEN n >= 52 THEN 7 ELSE greatest(2, n // 4) END WHEN freq = 'h' THEN 24 WHEN freq = 'min' THEN 1440
 WHEN freq = 'W' THEN CASE WHEN n >= 104 THEN 52 ELSE greatest(2, n // 4) END WHEN freq IN ('MS', 'QS') THEN CASE WHEN n >= 24 THEN 12 ELSE greatest(2, n // 2) END ELSE greatest(2, n // 4) END"""
SEASONS_SQL = f"""WITH q AS (SELECT event_id, {sql_pick(FREQUENCIES, sql_below(1, 'freq', 'event_id', len(FREQUENCIES)))} AS freq, {sql_below(1, 'n', 'event_id', 1000)} AS n FROM events),
s AS (SELECT *, {_SEASON} AS season FROM q) SELECT *, greatest(2, least(season, n // 2)) AS period FROM s"""


def ts_fill(spark, d):
    """Gaps in the values, also at the start, filled forward and then backward."""
    e = indexed(spark, d).withColumn("value", F.when((R.u(2, "gap", "event_id") < 0.6) & (F.col("t") > 3), F.col("value")))
    return S.fill_gaps(e, ["event_type"], ["value"], rows=BLOCK).select("event_id", "value")


TS_FILL_SQL = f"""WITH {_ev()}, g AS (SELECT *, CASE WHEN {sql_u(2, 'gap', 'event_id')} < 0.6 AND t > 3 THEN value END AS v FROM ev)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM g"""


def ts_moving_average(spark, d):
    """Window length differs per event type, odd and even, longer than a block."""
    e = indexed(spark, d)
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    x = e.join(n, "event_type").withColumn("w", F.length("event_type") * 30)
    return S.moving_average(x, ["event_type"], "value", F.least("w", "n"), F.col("n"), rows=BLOCK).withColumn("ma", F.round("ma", 6))


TS_MA_SQL = f"""WITH {_ev()}, x AS (SELECT *, least(length(event_type) * 30, n) AS w FROM ev)
SELECT event_type, t, value, round(sum(value) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN (w // 2) PRECEDING AND ((w - 1) // 2) FOLLOWING) / w, 6) AS ma FROM x"""


def ts_stl(spark, d):
    """Robust decomposition of the values of every event type by loess, a season of twelve events."""
    e = indexed(spark, d).select("event_type", "t", "value")
    info = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("period", F.lit(12)).where("n >= 2 * period")
    out = stl(e, ["event_type"], info, outer=STL_ROUNDS, rows=BLOCK)
    return out.withColumns({c: F.round(c, 6) for c in ("trend", "seasonal", "residual", "weight")})


STL_ROUNDS = 3
LONG, SEASON = 5_000_011, 8


def ts_long_spectrum(spark, d):
    """Strongest waves of series of over five million positions that repeat a season of eight: the mean value per event type and position in eight."""
    means = indexed(spark, d).groupBy("event_type", (F.col("t") % SEASON).alias("phase")).agg(F.avg("value").alias("seasonal"))
    info = means.select("event_type").distinct().withColumns({"n": F.lit(LONG).cast("bigint"), "season": F.lit(SEASON).cast("bigint")})
    out = S.harmonics(means, ["event_type"], info)
    return out.select("event_type", F.transform("amplitudes", lambda x: F.round(x, 4)).alias("amplitudes"), F.transform("freqs", lambda x: F.round(x, 9)).alias("freqs"))


_TURN = "2 * pi() * ((k * {0}) % {1}) / {1}"
TS_SPECTRUM_SQL = f"""WITH {_ev()}, p AS (SELECT event_type, t % {SEASON} AS j, avg(value) AS x FROM ev GROUP BY ALL),
k AS (SELECT range AS k FROM range(1, {LONG // 2 + 1})),
sums AS (SELECT event_type, k, sum(x * cos({_TURN.format('j', LONG)})) AS a, -sum(x * sin({_TURN.format('j', LONG)})) AS b,
  coalesce(sum(x * cos({_TURN.format('j', LONG)})) FILTER (WHERE j < {LONG % SEASON}), 0) AS c, -coalesce(sum(x * sin({_TURN.format('j', LONG)})) FILTER (WHERE j < {LONG % SEASON}), 0) AS e FROM p, k GROUP BY event_type, k),
g AS (SELECT *, sin(pi() * ((k * {LONG - LONG % SEASON}) % {2 * LONG}) / {LONG}) / sin(pi() * ((k * {SEASON}) % {2 * LONG}) / {LONG}) AS m, -pi() * ((k * {LONG - LONG % SEASON - SEASON}) % {2 * LONG}) / {LONG} AS f,
  -2 * pi() * ((k * {LONG - LONG % SEASON}) % {LONG}) / {LONG} AS h FROM sums),
x AS (SELECT event_type, k, m * (a * cos(f) - b * sin(f)) + c * cos(h) - e * sin(h) AS re, m * (a * sin(f) + b * cos(f)) + c * sin(h) + e * cos(h) AS im FROM g),
r AS (SELECT *, sqrt(re * re + im * im) * 2 / {LONG} AS amp, row_number() OVER (PARTITION BY event_type ORDER BY re * re + im * im DESC, k DESC) AS rank FROM x)
SELECT event_type, list(round(amp, 4) ORDER BY rank) AS amplitudes, list(round(k / {LONG}::DOUBLE, 9) ORDER BY rank) AS freqs FROM r WHERE rank <= 2 GROUP BY event_type"""


def ts_trend(spark, d):
    long = S.long_form(indexed(spark, d), ["event_type"], ["value", "user_id"])
    g = S.trends(long, ["event_type", "column"])
    return g.withColumn("slope", F.round("slope", 8)).withColumn("intercept", F.round("intercept", 6))


TS_TREND_SQL = f"""WITH {_ev()}, long AS (SELECT event_type, 'value' AS "column", t, value FROM ev UNION ALL SELECT event_type, 'user_id', t, user_id::DOUBLE FROM ev)
SELECT event_type, "column", round(regr_slope(value, t), 8) AS slope, round(regr_intercept(value, t), 6) AS intercept, min(value) AS value_min, max(value) AS value_max, count(value) AS n FROM long GROUP BY ALL"""


def ts_autocorr(spark, d):
    from ..operators.relate import safe_corr

    lagged = S.with_lag(indexed(spark, d), ["event_type"], ["value"], rows=BLOCK)
    return lagged.groupBy("event_type").agg(F.round(safe_corr(F.col("value"), F.col("prev_value")), 6).alias("autocorr"), F.count("prev_value").alias("pairs"))


TS_AUTOCORR_SQL = f"""WITH {_ev()}, l AS (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY t) AS p FROM ev)
SELECT event_type, round(corr(value, p), 6) AS autocorr, count(p) AS pairs FROM l GROUP BY 1"""


def ts_detect(spark, d):
    """Time columns of orders and events as they come out of CSV (all text) and as typed tables."""
    o = load(spark, d, "orders")
    text = o.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderstatus",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("shipped"), F.when(F.col("o_orderstatus") == "F", F.lit("soon")).otherwise("2020-01-01").alias("due_day"),
    ).drop("o_orderkey")
    a = S.detect_time_columns(text).withColumn("table", F.lit("orders"))
    b = S.detect_time_columns(load(spark, d, "events")).withColumn("table", F.lit("events"))
    return a.unionByName(b)


TS_DETECT_SQL = """SELECT * FROM (VALUES ('orders', 'o_orderdate', 1, false, true), ('orders', 'shipped', 2, false, false), ('events', 'ts', 1, true, true)) t("table", "column", rank, is_time_type, name_hint)
WHERE (SELECT count(*) FROM orders) > 0"""


# --- pattern models ------------------------------------------------------------------

# source: (key columns, time, values) -> CTE "ev" with s, ts, t, n and one column per value
_RAW = ("""ev AS (SELECT event_type AS s, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY event_type) AS n, value AS a, user_id::DOUBLE AS b FROM events)""", "value", "user_id")
_DAILY = ("""dd AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS a, count(*)::DOUBLE AS b FROM events GROUP BY ALL),
ev AS (SELECT event_type AS s, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY event_type) AS n, a, b FROM dd)""", "total", "hits")


def _model_ctes(src) -> str:
    cte, a, b = src
    return f"""{cte},
st AS (SELECT s, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY s ORDER BY t)) / 1e6::DOUBLE AS step FROM ev),
fq AS (SELECT s, {_FREQ} AS freq FROM (SELECT s, median(step) AS m FROM st GROUP BY s)),
info AS (SELECT *, {_SEASON} AS season FROM (SELECT s, count(*) AS n, min(ts) AS t0, max(ts) AS t1 FROM ev GROUP BY s) JOIN fq USING (s) WHERE n >= 4),
long AS (SELECT s, '{a}' AS c, t, a AS x FROM ev UNION ALL SELECT s, '{b}', t, b FROM ev),
lin AS (SELECT s, c, coalesce(regr_slope(x, t), 0) AS slope, regr_intercept(x, t) AS icept, min(x) AS lo, max(x) AS hi FROM long GROUP BY ALL),
flat AS (SELECT l.s, l.c, l.t, x - (slope * l.t + icept) AS f, i.n, greatest(2, least(season, i.n // 2)) AS p, season FROM long l JOIN lin USING (s, c) JOIN info i ON i.s = l.s),
mov AS (SELECT *, sum(f) OVER (PARTITION BY s, c ORDER BY t ROWS BETWEEN (p // 2) PRECEDING AND ((p - 1) // 2) FOLLOWING) / p AS ma FROM flat),
sea AS (SELECT *, avg(f - ma) OVER (PARTITION BY s, c, t % p) AS se FROM mov),
res AS (SELECT *, f - ma - se AS r FROM sea),
lagd AS (SELECT *, lag(r) OVER (PARTITION BY s, c ORDER BY t) AS pr FROM res),
rs AS (SELECT s, c, avg(r) AS m, stddev_pop(r) AS sd, corr(r, pr) AS ac, stddev_pop(se) AS sesd FROM lagd GROUP BY ALL),
cor AS (SELECT x.s, x.c AS ca, y.c AS cb, round(corr(x.r, y.r), 6) AS corr FROM res x JOIN res y ON x.s = y.s AND x.t = y.t GROUP BY ALL),
ks AS (SELECT s, n, unnest(range(1, n // 2 + 1)) AS k FROM info WHERE n >= season),
dft AS (SELECT s, c, k, sum(se * cos(2 * pi() * ((k * t) % ks.n) / ks.n)) AS re, -sum(se * sin(2 * pi() * ((k * t) % ks.n) / ks.n)) AS im, any_value(ks.n) AS n FROM sea JOIN ks USING (s) GROUP BY ALL),
amp AS (SELECT *, sqrt(re * re + im * im) * 2 / n AS a, row_number() OVER (PARTITION BY s, c ORDER BY sqrt(re * re + im * im) DESC, k DESC) AS rk FROM dft),
top AS (SELECT s, c, list(round(a, 6) ORDER BY rk) AS amps, list(round(atan2(im, re), 6) ORDER BY rk) AS phs, list(k::DOUBLE / n ORDER BY rk) AS frq FROM amp WHERE rk <= 2 AND a > 1e-6 GROUP BY ALL),
model AS (SELECT s, c, freq, i.n, t0, t1, season, round(slope, 6) AS slope, round(icept, 6) AS icept, coalesce(amps, [round(sesd, 6)]) AS amps, coalesce(phs, [0.0]) AS phs, coalesce(frq, [1.0::DOUBLE / season]) AS frq,
 round(m, 6) AS m, CASE WHEN round(coalesce(sd, 0), 6) = 0 THEN 0.001 ELSE round(sd, 6) END AS sd, round(coalesce(ac, 0), 6) AS ac, round(lo, 6) AS lo, CASE WHEN round(hi, 6) = 0 THEN 1.0 ELSE round(hi, 6) END AS hi
 FROM lin JOIN info i USING (s) JOIN rs USING (s, c) LEFT JOIN top USING (s, c))"""


def _analysis(spark, d):
    e = events(spark, d)
    return S.analyze(e, ["event_type"], "ts", ["value", "user_id"], tie=["event_id"], rows=BLOCK)


def daily(spark, d) -> DataFrame:
    e = load(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).cast("double").alias("hits"))


def _daily_analysis(spark, d):
    return S.analyze(daily(spark, d), ["event_type"], "ts", ["total", "hits"])


def _model_rows(models: DataFrame) -> DataFrame:
    def joined(c, k=6):
        return F.array_join(F.transform(c, lambda x: F.round(x * 10**k).cast("bigint").cast("string")), ";")

    return models.select(
        "event_type", "column", "frequency", "source_rows", "source_start", "source_end", "seasonal_period", "trend_slope", "trend_intercept",
        joined("seasonal_amplitudes", 4).alias("amplitudes"), joined("seasonal_phases", 4).alias("phases"), joined("seasonal_freqs").alias("freqs"),
        F.round("residual_mean", 5).alias("residual_mean"), "residual_std", "autocorr_lag1", "value_min", "value_max",
    )


def ts_model(spark, d):
    return _model_rows(_analysis(spark, d)[0])


def ts_model_daily(spark, d):
    return _model_rows(_daily_analysis(spark, d)[0])


def _model_sql(src) -> str:
    def joined(c, k=6):
        return f"list_aggregate(list_transform({c}, lambda x: CAST(CAST(round(x * {10**k}) AS BIGINT) AS VARCHAR)), 'string_agg', ';')"

    return f"""WITH {_model_ctes(src)} SELECT s AS event_type, c AS "column", freq AS frequency, n AS source_rows, t0 AS source_start, t1 AS source_end, season AS seasonal_period, slope AS trend_slope, icept AS trend_intercept,
    {joined('amps', 4)} AS amplitudes, {joined('phs', 4)} AS phases, {joined('frq')} AS freqs, round(m, 5) + 0.0 AS residual_mean, sd AS residual_std, ac AS autocorr_lag1, lo AS value_min, hi AS value_max FROM model"""


def ts_residual_corr(spark, d):
    return _daily_analysis(spark, d)[1]


def ts_decompose(spark, d):
    """The parts of every event value: line, moving average, season, rest."""
    placed = ordered_index(events(spark, d), ["event_type"], ["ts", "event_id"])
    long = S.long_form(placed, ["event_type"], ["value"]).drop("column")
    lines = S.trends(long, ["event_type"]).withColumn("season", F.length("event_type") * 7).withColumn("period", S.season_period(F.col("season"), F.col("n")))
    parts, _ = S.decompose(long, ["event_type"], lines, BLOCK)
    return parts.select("event_type", "t", *[F.round(c, 6).alias(c) for c in ("flat", "moving_trend", "seasonal", "residual")])


TS_DECOMPOSE_SQL = f"""WITH {_ev()}, lin AS (SELECT event_type, regr_slope(value, t) AS a, regr_intercept(value, t) AS b, greatest(2, least(length(event_type) * 7, count(*) // 2)) AS p FROM ev GROUP BY 1),
f AS (SELECT event_type, t, p, value - (a * t + b) AS flat FROM ev JOIN lin USING (event_type)),
m AS (SELECT *, sum(flat) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN (p // 2) PRECEDING AND ((p - 1) // 2) FOLLOWING) / p AS ma FROM f),
s AS (SELECT *, avg(flat - ma) OVER (PARTITION BY event_type, t % p) AS se FROM m)
SELECT event_type, t, round(flat, 6) AS flat, round(ma, 6) AS moving_trend, round(se, 6) AS seasonal, round(flat - ma - se, 6) AS residual FROM s"""


def ts_summary(spark, d):
    models, corr = _daily_analysis(spark, d)
    nested = S.nested_models(models, corr, ["event_type"])
    return nested.select("event_type", S.summary_text(nested).alias("summary"), F.array_join("numeric_columns", ",").alias("columns"), F.size(F.map_keys("residual_correlation_matrix")).alias("matrix"))


TS_SUMMARY_SQL = f"""WITH {_model_ctes(_DAILY)} SELECT s AS event_type, 'Daily data · ' || n || ' rows · ' || strftime(t0, '%Y-%m-%d') || ' → ' || strftime(t1, '%Y-%m-%d') || ' · 2 numeric column(s) · seasonal period ≈ ' || season || ' steps' AS summary,
'hits,total' AS columns, 2 AS matrix FROM info"""


def calendar(spark, d):
    """Calendar points: the n-th step from every order date, and the next point after it."""
    o = load(spark, d, "orders")
    freq = R.pick(list(FREQUENCIES), R.below(3, "freq", "o_orderkey", len(FREQUENCIES)))
    q = o.select("o_orderkey", freq.alias("freq"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(5))).alias("at"), (F.col("o_custkey") % 40).alias("i"))
    anchor = roll_forward(F.col("at"), F.col("freq"))
    return q.select("o_orderkey", "freq", anchor.alias("anchor"), calendar_step(anchor, F.col("freq"), F.col("i")).alias("point"), next_point(F.col("at"), F.col("freq")).alias("next"))


def _up(unit: str, months: int) -> str:
    return f"CASE WHEN date_trunc('{unit}', pt)::DATE = pt::DATE THEN pt ELSE date_trunc('{unit}', pt) + INTERVAL '{months} months 5 hours' END"


CALENDAR_SQL = f"""WITH q AS (SELECT o_orderkey, {sql_pick(FREQUENCIES, sql_below(3, 'freq', 'o_orderkey', len(FREQUENCIES)))} AS freq, o_orderdate + INTERVAL 5 HOUR AS pt, o_custkey % 40 AS i FROM orders),
a AS (SELECT *, CASE freq WHEN 'W' THEN pt + to_days(CAST((7 - isodow(pt)) % 7 AS INTEGER)) WHEN 'MS' THEN {_up('month', 1)} WHEN 'QS' THEN {_up('quarter', 3)} WHEN 'YS' THEN {_up('year', 12)} ELSE pt END AS anchor FROM q)
SELECT o_orderkey, freq, anchor, anchor + CASE freq WHEN 'D' THEN to_days(CAST(i AS INTEGER)) WHEN 'W' THEN to_days(CAST(7 * i AS INTEGER)) WHEN 'MS' THEN to_months(CAST(i AS INTEGER)) WHEN 'QS' THEN to_months(CAST(3 * i AS INTEGER)) WHEN 'YS' THEN to_months(CAST(12 * i AS INTEGER))
 WHEN 'h' THEN to_hours(i) ELSE to_minutes(i) END AS point,
CASE freq WHEN 'D' THEN pt + INTERVAL 1 DAY WHEN 'h' THEN pt + INTERVAL 1 HOUR WHEN 'min' THEN pt + INTERVAL 1 MINUTE WHEN 'W' THEN pt + to_days(CAST(CASE WHEN isodow(pt) = 7 THEN 7 ELSE 7 - isodow(pt) END AS INTEGER))
 WHEN 'MS' THEN date_trunc('month', pt) + INTERVAL '1 month 5 hours' WHEN 'QS' THEN date_trunc('quarter', pt) + INTERVAL '3 months 5 hours' ELSE date_trunc('year', pt) + INTERVAL '12 months 5 hours' END AS next FROM a"""


# --- generation ----------------------------------------------------------------------


def ts_generate(spark, d):
    """As many new rows as every series had, from the daily models."""
    models, corr = _daily_analysis(spark, d)
    return SG.generate(models, corr, ["event_type"], F.col("source_rows") * 10, seed=42, block_rows=64)


def ts_generate_events(spark, d):
    """Event-level models continued, one row per new event."""
    models, corr = _analysis(spark, d)
    g = SG.generate(models, corr, ["event_type"], F.col("source_rows"), seed=7, seasonal_scale=0.5, compat=True)
    return SG.wide(g, ["event_type"], ["value", "user_id"])


def _generate_sql(src, n: str, seed: int, scale: float, compat: bool, step: str) -> str:
    _, a, b = src
    first, second = sorted([a, b])
    if compat:
        wave = "list_sum(list_transform(range(1, len(amps) + 1), lambda i: amps[i] * sin(2 * pi() * t / greatest(season, 1) + phs[i])))"
    else:
        wave = "list_sum(list_transform(range(1, len(amps) + 1), lambda i: amps[i] * cos(2 * pi() * t * frq[i] + phs[i])))"
    z = "{0}"

    def zn(c):
        return sql_normal(seed, "series.noise", ["s", f"'{c}'", "t"])

    return f"""WITH RECURSIVE {_model_ctes(src)},
rho AS (SELECT s, least(greatest(corr, -0.99), 0.99) AS rho FROM cor WHERE ca = '{first}' AND cb = '{second}'),
tt AS (SELECT s, unnest(range(0, {n})) AS t FROM info),
z AS MATERIALIZED (SELECT s, t, {zn(first)} AS z1, {zn(second)} AS z2 FROM tt),
e AS MATERIALIZED (SELECT m.s, m.c, z.t, CASE WHEN m.c = '{first}' THEN m.sd * z1 ELSE m.sd * (rho * z1 + sqrt(1 - rho * rho) * z2) END AS e, m.m AS mu, least(greatest(m.ac, -0.99), 0.99) AS a FROM model m JOIN rho USING (s) JOIN z USING (s)),
ar AS (SELECT s, c, t, e + mu AS r FROM e WHERE t = 0 UNION ALL SELECT e.s, e.c, e.t, e.a * ar.r + e.e + e.mu * (1 - e.a) FROM ar JOIN e ON e.s = ar.s AND e.c = ar.c AND e.t = ar.t + 1)
SELECT ar.s AS event_type, ar.c AS "column", t, m.t1 + {step} AS ts,
round(greatest(least(m.slope * t + m.icept + {scale}::DOUBLE * {wave} + ar.r, m.hi), m.lo), 4) AS value FROM ar JOIN model m ON m.s = ar.s AND m.c = ar.c"""


_GEN_EVENTS = _generate_sql(_RAW, "n", 7, 0.5, True, "CASE freq WHEN 'min' THEN to_minutes(t + 1) WHEN 'h' THEN to_hours(t + 1) ELSE to_days(CAST(t + 1 AS INTEGER)) END")

QUERIES = {
    "ts_stl": ts_stl, "ts_long_spectrum": ts_long_spectrum,
    "ts_steps": ts_steps, "ts_median_step": ts_median_step, "ts_frequency": ts_frequency, "ts_frequency_classes": ts_frequency_classes, "season_lengths": season_lengths,
    "ts_fill": ts_fill, "ts_moving_average": ts_moving_average, "ts_trend": ts_trend, "ts_autocorr": ts_autocorr, "ts_detect": ts_detect, "ts_decompose": ts_decompose,
    "ts_model": ts_model, "ts_model_daily": ts_model_daily, "ts_residual_corr": ts_residual_corr, "ts_summary": ts_summary, "calendar": calendar,
    "ts_generate": ts_generate, "ts_generate_events": ts_generate_events,
}

ORACLES = {
    "ts_long_spectrum": TS_SPECTRUM_SQL,
    "ts_steps": f"WITH {_steps_sql('event_type')} SELECT event_type, count(*) AS steps, round(sum(step), 3) AS seconds, max(step) AS longest FROM st GROUP BY 1",
    "ts_median_step": f"WITH {_steps_sql('event_type')} SELECT event_type, median(step) AS median_step FROM st GROUP BY 1",
    "ts_frequency": f"WITH {_steps_sql('user_id')} SELECT user_id, {_FREQ} AS frequency, c AS steps FROM (SELECT user_id, median(step) AS m, count(*) AS c FROM st GROUP BY 1)",
    "ts_frequency_classes": f"""WITH {_ev('user_id')}, x AS (SELECT user_id, t, least(t, 20) * [30, 3600, 86400, 604800, 2592000, 7862400, 31536000][user_id % 7 + 1] AS pt FROM ev),
 st AS (SELECT user_id, pt - lag(pt) OVER (PARTITION BY user_id ORDER BY t) AS step FROM x) SELECT user_id, {_FREQ} AS frequency, c AS steps FROM (SELECT user_id, median(step) AS m, count(step) AS c FROM st GROUP BY 1 HAVING count(step) > 0)""",
    "season_lengths": SEASONS_SQL, "ts_fill": TS_FILL_SQL, "ts_moving_average": TS_MA_SQL, "ts_trend": TS_TREND_SQL, "ts_autocorr": TS_AUTOCORR_SQL, "ts_detect": TS_DETECT_SQL,
    "ts_decompose": TS_DECOMPOSE_SQL, "ts_model": _model_sql(_RAW), "ts_model_daily": _model_sql(_DAILY),
    "ts_residual_corr": f"WITH {_model_ctes(_DAILY)} SELECT s AS event_type, ca AS col_a, cb AS col_b, corr FROM cor",
    "ts_summary": TS_SUMMARY_SQL, "calendar": CALENDAR_SQL,
    "ts_generate": _generate_sql(_DAILY, "n * 10", 42, 1.0, False, "to_days(CAST(t + 1 AS INTEGER))"),
    "ts_generate_events": f"""SELECT event_type, t, ts, max(value) FILTER (WHERE "column" = 'value') AS value, max(value) FILTER (WHERE "column" = 'user_id') AS user_id FROM ({_GEN_EVENTS}) GROUP BY ALL""",
}
