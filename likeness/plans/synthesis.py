"""Registered queries on look-alike synthesis and on streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import copula as K
from ..operators import multitable as M
from ..operators.generate import Link
from ..session import cut_lineage, work_folder
from ..streaming import activity, drift, running_profile
from .common import STAR_KEYS, load, sql_normal

LI_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
MARGINS = ["l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]
SCORED = ["l_quantity", "l_discount", "l_linenumber", "l_returnflag"]


def copula_marginals(spark, d):
    """Exact quantiles of the numbers and times of all line items."""
    out = K.exact_quantiles(load(spark, d, "lineitem"), MARGINS, LI_IDS, 17)
    return out.withColumn("value", F.round("value", 4))


_VIEW = {"l_shipdate": "epoch_us(l_shipdate)::DOUBLE"}
MARGINALS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i / 16}::DOUBLE AS prob, round(quantile_cont({_VIEW.get(c, c)}, {i / 16}), 4) AS value FROM lineitem"
    for c in MARGINS for i in range(17)
)


def copula_corr(spark, d):
    """Correlation of normal scores of columns with few values."""
    model = K.fit(load(spark, d, "lineitem", "l_orderkey"), SCORED)
    rows = [(SCORED[i], SCORED[j], round(float(model.corr[i, j]), 6)) for i in range(4) for j in range(i + 1, 4)]
    return spark.createDataFrame(rows, "col_a string, col_b string, corr double")


# Coefficients of the public rational approximation of the normal quantile (relative error 1e-9).
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def _poly(c, x: str, tail: str = "") -> str:
    out = f"{c[0]!r}::DOUBLE"
    for k in c[1:]:
        out = f"(({out}) * {x} + {k!r}::DOUBLE)"
    return f"(({out}) * {x} + 1)" if tail else out


def sql_ppf(p: str) -> str:
    q = f"({p} - 0.5)"
    low = f"sqrt(-2 * ln({p}))"
    high = f"sqrt(-2 * ln(1 - {p}))"
    return (
        f"CASE WHEN {p} < 0.02425 THEN {_poly(_C, low)} / {_poly(_D, low, '1')} WHEN {p} > 0.97575 THEN -({_poly(_C, high)}) / {_poly(_D, high, '1')}"
        f" ELSE {_poly(_A, f'({q} * {q})')} * {q} / {_poly(_B, f'({q} * {q})', '1')} END"
    )


_ORDER = {"l_returnflag": "n DESC, v"}


def _scores_sql() -> str:
    parts = []
    for c in SCORED:
        order = _ORDER.get(c, "v")
        parts.append(
            f"""{c}_t AS (SELECT v, n, sum(n) OVER (ORDER BY {order}) AS cum, sum(n) OVER () AS tot FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1)),
            {c}_z AS (SELECT v, cum, tot, {sql_ppf('((cum - n / 2.0::DOUBLE) / tot)')} AS z, CASE WHEN cum < tot THEN {sql_ppf('(cum::DOUBLE / tot)')} ELSE 1e9 END AS cut FROM {c}_t WHERE n < tot)"""
        )
    joins = " ".join(f"JOIN {c}_z ON {c}_z.v = l.{c}" for c in SCORED)
    return f"{', '.join(parts)}, sc AS (SELECT {', '.join(f'{c}_z.z AS {c}' for c in SCORED)} FROM lineitem l {joins})"


COPULA_CORR_SQL = f"WITH {_scores_sql()} " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM sc" for i, a in enumerate(SCORED) for b in SCORED[i + 1 :]
)


def copula_sample(spark, d):
    """A sample as large as the source from columns with few values."""
    src = load(spark, d, "lineitem", "l_orderkey")
    out = K.synthesize(src.select("l_quantity", "l_discount"), src.count(), seed=21, stream="li", portable=True)
    return out.groupBy("l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("n"))


COPULA_SAMPLE_SQL = f"""WITH {_scores_sql()}, rho AS (SELECT corr(l_quantity, l_discount) AS r FROM sc),
g AS (SELECT range AS i FROM range((SELECT count(*) FROM lineitem))),
w AS (SELECT i, z1, r * z1 + sqrt(1 - r * r) * z2 AS z2 FROM (SELECT i, {sql_normal(21, 'li.l_quantity', 'i')} AS z1, {sql_normal(21, 'li.l_discount', 'i')} AS z2 FROM g), rho),
a AS (SELECT list(v ORDER BY cut) AS v, list(cut ORDER BY cut) AS c FROM l_quantity_z), b AS (SELECT list(v ORDER BY cut) AS v, list(cut ORDER BY cut) AS c FROM l_discount_z)
SELECT a.v[1 + len(list_filter(a.c, lambda x: x <= w.z1))] AS l_quantity, b.v[1 + len(list_filter(b.c, lambda x: x <= w.z2))] AS l_discount, count(*) AS n FROM w, a, b GROUP BY ALL"""


def single_synth(spark, d):
    """Orders with all column kinds: key, text, numbers, dates."""
    src = load(spark, d, "orders")
    return K.synthesize(src, src.count(), seed=1, key="o_orderkey", stream="orders").drop("_row")


def text_synth(spark, d):
    """Documents: texts are drawn from the source, short columns are modelled."""
    src = load(spark, d, "documents")
    out = K.synthesize(src, 2 * src.count(), seed=1, key="doc_id", stream="documents")
    return out.select("doc_id", "lang", "source", "n_chars", F.length("text").alias("length"))


def text_synth_checks(spark, d):
    """Every text, language and source of the documents with its rows, and whether a table of twice the size drew it about twice as often.

    A drawn count is near when it lies within 8 standard errors (and 4 rows) of twice the rows of the source. Texts stand by their MD5;
    a drawn value that the source has not would be a row of its own.
    """
    src = load(spark, d, "documents")
    out = K.synthesize(src, 2 * src.count(), seed=1, key="doc_id", stream="documents")

    def counted(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in (("text", F.md5("text")), ("lang", F.col("lang")), ("source", F.col("source")))])
        return df.select(F.explode(cells).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias(name))

    both = counted(src, "n").join(counted(out, "drawn"), ["column", "value"], "full").na.fill(0, ["n", "drawn"])
    return both.select("column", "value", "n", (F.abs(F.col("drawn") - 2 * F.col("n")) <= 4 + 8 * F.sqrt(2.0 * F.col("n"))).alias("near"))


TEXT_CHECKS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {v} AS value, count(*) AS n, true AS near FROM documents WHERE {c} IS NOT NULL GROUP BY 2" for c, v in (("text", "md5(text)"), ("lang", "lang"), ("source", "source"))
)
LINKS = [Link(*k) for k in STAR_KEYS if k[0] != "labels"]


def _star(spark, d) -> dict[str, DataFrame]:
    return {n: load(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}


def _multi(spark, d):
    tables = _star(spark, d)
    return tables, M.synthesize_tables(tables, LINKS, seed=42, row_counts={t: df.count() for t, df in tables.items()})


def multi_synth(spark, d):
    _, out = _multi(spark, d)
    return out["orders"].join(out["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("avg_price")
    )


def _checks(tables: dict[str, DataFrame], made: dict[str, DataFrame], links: list[Link], rows: bool) -> DataFrame:
    """Per link: rows without a parent; per table: rows, and whether every number lies within the source's bounds.

    One small plan after the other; a single one would hold the driver's plans and exchanges of all links at once.
    """
    found = []
    for k in links:
        lost = made[k.from_table].where(F.col(k.from_column).isNotNull()).join(made[k.to_table].select(F.col(k.to_column).alias("_p")), F.col(k.from_column) == F.col("_p"), "left_anti")
        found.append((f"{k.from_table}.{k.from_column}", lost.count()))
    for t, df in made.items():
        nums = [c for c, kind in df.dtypes if kind == "double"]
        src = tables[t].agg(*[f(c).alias(f"{w}_{c}") for c in nums for w, f in (("lo", F.min), ("hi", F.max))]) if nums else None
        out = F.lit(False)
        if src is not None:
            b = src.first()
            for c in nums:
                out = out | (F.col(c) < b[f"lo_{c}"]) | (F.col(c) > b[f"hi_{c}"])
        beyond, n = df.agg(F.count_if(out), F.count(F.lit(1))).first()
        found += [(f"{t} out of bounds", beyond), *([(f"{t} rows", n)] if rows else [])]
    return next(iter(made.values())).sparkSession.createDataFrame(found, "check string, n bigint")


def multi_synth_checks(spark, d):
    tables, made = _multi(spark, d)
    return _checks(tables, {t: cut_lineage(df) for t, df in made.items()}, LINKS, rows=True)  # each is made once and read by several checks


_T = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
CHECKS_SQL = " UNION ALL ".join(
    [f"SELECT '{k.from_table}.{k.from_column}' AS \"check\", 0 AS n" for k in LINKS] + [f"SELECT '{t} out of bounds', 0" for t in _T]
)
MULTI_CHECKS_SQL = CHECKS_SQL + "".join(f" UNION ALL SELECT '{t} rows', count(*) FROM {t}" for t in _T)


def _hier(spark, d):
    tables = {n: load(spark, d, n) for n in ("nation", "customer", "orders")}
    links = [k for k in LINKS if k.from_table in ("customer", "orders") and k.to_table in tables]
    keys = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}
    return tables, M.synthesize_hierarchy(tables, links, tables["orders"].count(), seed=5, keys=keys), links


def hier_synth(spark, d):
    """Distribution of orders per customer in the source and in the look-alike."""
    tables, made, _ = _hier(spark, d)

    def fan(t: dict, name: str) -> DataFrame:
        per = t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
        return per.groupBy("k").agg(F.count(F.lit(1)).alias("customers")).withColumn("dataset", F.lit(name))

    return fan(tables, "source").unionByName(fan(made, "made"))


def hier_synth_checks(spark, d):
    tables, made, links = _hier(spark, d)
    return _checks(tables, made, links, rows=False)


HIER_CHECKS_SQL = """SELECT * FROM (VALUES ('customer.c_nationkey', 0), ('orders.o_custkey', 0), ('nation out of bounds', 0), ('customer out of bounds', 0), ('orders out of bounds', 0)) t("check", n)
WHERE (SELECT count(*) FROM orders) > 0"""

# --- shapes of keys --------------------------------------------------------------------

SHAPES = [
    Link("badge", "id", "person", "id"), Link("visit", "badge_id", "badge", "id"), Link("visit", "person_code", "person", "code"),
    Link("visit", "earlier", "visit", "id"), Link("left", "k", "right", "k"), Link("right", "k", "left", "k"),
]
_SHAPE_TABLES = {
    "person": "SELECT c_custkey AS id, 'P' || c_custkey AS code, c_acctbal AS balance FROM customer",
    "badge": "SELECT c_custkey AS id, c_mktsegment AS colour FROM customer WHERE c_custkey % 3 <> 0",
    "visit": "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS badge_id, 'P' || o_custkey AS person_code,"
    " CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey END AS earlier, o_totalprice AS cost FROM orders",
    "left": "SELECT p_partkey AS k, p_size AS size FROM part",
    "right": "SELECT p_partkey AS k, p_retailprice AS price FROM part",
}


def _shape_tables(spark, d) -> dict[str, DataFrame]:
    names = {n: load(spark, d, n) for n in ("customer", "orders", "part")}
    return {t: spark.sql(sql.replace(" FROM customer", " FROM {customer}").replace(" FROM orders", " FROM {orders}").replace(" FROM part", " FROM {part}"), **{n: df for n, df in names.items() if f" FROM {n}" in sql}) for t, sql in _SHAPE_TABLES.items()}


def key_shapes(spark, d):
    """Chains of keys, two referenced columns, a link to the own table and a circle: rows, lost keys and distinct referenced keys of the look-alikes."""
    tables = _shape_tables(spark, d)
    made = M.synthesize_tables(tables, SHAPES, seed=9, row_counts={t: df.count() for t, df in tables.items()})
    parts = []
    for k in SHAPES:
        lost = made[k.from_table].where(F.col(k.from_column).isNotNull()).join(made[k.to_table].select(F.col(k.to_column).alias("_p")), F.col(k.from_column) == F.col("_p"), "left_anti")
        parts.append(lost.agg(F.lit(f"{k.from_table}.{k.from_column} lost").alias("check"), F.count(F.lit(1)).alias("n")))
        parts.append(made[k.to_table].agg(F.lit(f"{k.from_table}.{k.from_column} parents").alias("check"), F.count_distinct(k.to_column).alias("n")))
    parts += [df.agg(F.lit(f"{t} rows").alias("check"), F.count(F.lit(1)).alias("n")) for t, df in made.items()]
    return reduce(DataFrame.unionByName, parts)


_SHAPES_CTE = "WITH " + ", ".join(f'"{t}" AS ({sql})' for t, sql in _SHAPE_TABLES.items())
SHAPES_SQL = _SHAPES_CTE + " " + " UNION ALL ".join(
    [
        f"""SELECT '{k.from_table}.{k.from_column} lost' AS "check", count(*) AS n FROM "{k.from_table}" WHERE {k.from_column} IS NOT NULL AND {k.from_column} NOT IN (SELECT {k.to_column} FROM "{k.to_table}")
        UNION ALL SELECT '{k.from_table}.{k.from_column} parents', count(DISTINCT {k.to_column}) FROM "{k.to_table}" """
        for k in SHAPES
    ]
    + [f"""SELECT '{t} rows', count(*) FROM "{t}" """ for t in _SHAPE_TABLES]
)


def hier_free_children(spark, d):
    """Children without a parent stay without one in the look-alike, also for names with two underlines; links to the own table point to made rows."""
    tables = _shape_tables(spark, d)
    tables = {"my__person": tables["person"].select("id", "balance"), "my__visit": tables["visit"].select("id", F.when(F.col("cost") % 10 >= 3, F.regexp_extract("person_code", "[0-9]+", 0).cast("long")).alias("person_id"), "earlier", "cost")}
    links = [Link("my__visit", "person_id", "my__person", "id"), Link("my__visit", "earlier", "my__visit", "id")]
    made = M.synthesize_hierarchy(tables, links, tables["my__visit"].count(), seed=5, keys={"my__person": "id", "my__visit": "id"})
    v, p = made["my__visit"], made["my__person"]
    far = F.col("n") - tables["my__visit"].where("earlier IS NULL").count()
    lost = [v.where(f"{c} IS NOT NULL").join(o.select(F.col("id").alias(c)), c, "left_anti").agg(F.lit(f"{c} lost").alias("check"), F.count(F.lit(1)).alias("n")) for c, o in (("person_id", p), ("earlier", v))]
    free = v.where("person_id IS NULL").agg(F.lit("without a person").alias("check"), F.count(F.lit(1)).alias("n"))
    share = v.where("earlier IS NULL").agg(F.count(F.lit(1)).alias("n")).select(F.lit("without an earlier one, near the source").alias("check"), (F.abs(far) <= 4 * F.sqrt(F.col("n")) + 1).cast("bigint").alias("n"))
    return reduce(DataFrame.unionByName, [*lost, free, share])


FREE_SQL = _SHAPES_CTE + """, v AS (SELECT CASE WHEN cost % 10 >= 3 THEN CAST(substr(person_code, 2) AS BIGINT) END AS person_id, earlier, id FROM visit)
SELECT 'person_id lost' AS "check", count(*) AS n FROM v WHERE person_id IS NOT NULL AND person_id NOT IN (SELECT id FROM person)
UNION ALL SELECT 'earlier lost', count(*) FROM v WHERE earlier IS NOT NULL AND earlier NOT IN (SELECT id FROM v)
UNION ALL SELECT 'without a person', count(*) FROM v WHERE person_id IS NULL
UNION ALL SELECT 'without an earlier one, near the source', CAST(count(*) > 0 AS BIGINT) FROM v"""


# --- several parents -----------------------------------------------------------------------

_SALE = {
    "supplier": "SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier",
    "part": "SELECT p_partkey AS id, p_retailprice AS price, p_size AS size FROM part",
    "sale": "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS supplier_id, CASE WHEN l_quantity > 3 THEN l_partkey END AS part_id, p_retailprice + 2 * l_quantity AS cost, l_quantity AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey",
}
_SALE_LINKS = [Link("sale", "supplier_id", "supplier", "id"), Link("sale", "part_id", "part", "id")]


def hier_two_parents(spark, d):
    """Sales with a supplier and a part: per link the fan-out and, for the part, how a sale's cost goes with its price; the source's figures and whether the look-alike's are near."""
    given = {n: load(spark, d, n) for n in ("supplier", "part", "lineitem")}
    tables = {}
    for t, sql in _SALE.items():
        used = {n: df for n, df in given.items() if f" {n} " in sql.split(" FROM")[1] + " "}
        head, tail = sql.split(" FROM ")
        tables[t] = spark.sql(f"{head} FROM " + " ".join(f"{{{w}}} AS {w}" if w in used else w for w in tail.split()), **used)
    made = M.synthesize_hierarchy(tables, _SALE_LINKS, tables["sale"].count(), seed=3, keys={t: "id" for t in tables})

    def facts(t: dict[str, DataFrame]) -> DataFrame:
        sale, parts = t["sale"], []
        for k in _SALE_LINKS:
            per = sale.where(F.col(k.from_column).isNotNull()).groupBy(F.col(k.from_column).alias("id")).agg(F.count(F.lit(1)).alias("n"))
            every = t[k.to_table].select("id").join(per, "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
            both = F.array(*[F.struct(F.lit(name).alias("check"), F.col(c).alias("value")) for name, c in ((f"children per {k.to_table}", "_mean"), (f"spread of children per {k.to_table}", "_sd"))])
            parts.append(every.agg(F.avg("n").alias("_mean"), F.stddev_pop("n").alias("_sd")).select(F.explode(both).alias("x")).select("x.*"))
            lost = sale.where(F.col(k.from_column).isNotNull()).join(t[k.to_table].select(F.col("id").alias(k.from_column)), k.from_column, "left_anti")
            parts.append(lost.agg(F.lit(f"sales without their {k.to_table}").alias("check"), F.count(F.lit(1)).cast("double").alias("value")))
        met = sale.join(t["part"].select(F.col("id").alias("part_id"), "price", "size"), "part_id")
        parts.append(met.agg(F.lit("cost and price").alias("check"), F.corr("cost", "price").alias("value")))
        parts.append(sale.agg(F.lit("share without a part").alias("check"), F.avg(F.col("part_id").isNull().cast("double")).alias("value")))
        return reduce(DataFrame.unionByName, parts)

    a, b = cut_lineage(facts(tables)), cut_lineage(facts(made)).withColumnRenamed("value", "made")  # one set of plans after the other
    near = F.abs(F.col("made") - F.col("value")) <= F.when(F.col("check").startswith("spread"), 0.3 * F.col("value")).when(F.col("check").startswith("children"), 0.05 * F.col("value")).otherwise(0.1)
    return a.join(b, "check").select("check", F.round("value", 6).alias("source"), near.alias("near"))


_SALE_CTE = "WITH " + ", ".join(f's_{t} AS ({sql})' for t, sql in _SALE.items())
TWO_PARENTS_SQL = _SALE_CTE + " " + " UNION ALL ".join(
    [
        f"""SELECT 'children per {k.to_table}' AS "check", round(avg(n), 6) AS source, true AS near FROM (SELECT p.id, count(c.id) AS n FROM s_{k.to_table} p LEFT JOIN s_sale c ON c.{k.from_column} = p.id GROUP BY p.id)
        UNION ALL SELECT 'spread of children per {k.to_table}', round(stddev_pop(n), 6), true FROM (SELECT p.id, count(c.id) AS n FROM s_{k.to_table} p LEFT JOIN s_sale c ON c.{k.from_column} = p.id GROUP BY p.id)
        UNION ALL SELECT 'sales without their {k.to_table}', count(*)::DOUBLE, true FROM s_sale WHERE {k.from_column} NOT IN (SELECT id FROM s_{k.to_table})"""
        for k in _SALE_LINKS
    ]
    + [
        "SELECT 'cost and price', round(corr(cost, price), 6), true FROM s_sale s JOIN s_part p ON s.part_id = p.id",
        "SELECT 'share without a part', round(avg((part_id IS NULL)::INT), 6), true FROM s_sale",
    ]
)


# --- streams -------------------------------------------------------------------------


def _mixed_files(spark, d, files: int = 6) -> str:
    """The events dealt over several files without regard to time, so that every micro-batch brings late ones."""
    out = work_folder(spark, "mixed")
    load(spark, d, "events").repartition(files, F.xxhash64("event_id")).write.parquet(out)
    return out


def stream_rollup(spark, d):
    """Hourly events and token sums per action, from a stream over many files in mixed order."""
    return activity.run(spark, _mixed_files(spark, d), "*.parquet")


STREAM_ROLLUP_SQL = """SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type AS action, count(*) AS events, CAST(sum(json_extract_string(props, '$.k')::BIGINT) AS BIGINT) AS tokens FROM events GROUP BY ALL"""


def stream_hours(spark, d):
    """The hours of a stream over files in order of days, the last one with events of all days: late events, closed hours, compacted sums."""
    out, work = work_folder(spark, "days"), work_folder(spark, "hours")
    events = load(spark, d, "events")
    stray = F.pmod(F.col("event_id"), F.lit(50)) == 0
    for i, part in enumerate((~stray & (F.dayofmonth("ts") <= 10), ~stray & (F.dayofmonth("ts") > 10), stray)):
        events.where(part).coalesce(1).write.parquet(f"{out}/f={i}")
        source = spark.readStream.schema(activity._SCHEMA).parquet(f"{out}/f=*")
        activity.start(spark, source, f"{work}/out", f"{work}/state", "6 hours", 2).awaitTermination()
    return activity.hours(spark, f"{work}/out", "6 hours")


STREAM_HOURS_SQL = """WITH e AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type AS action, ts, json_extract_string(props, '$.k')::BIGINT AS k,
 CASE WHEN event_id % 50 = 0 THEN 2 WHEN day(ts) > 10 THEN 1 ELSE 0 END AS part FROM events),
m AS (SELECT max(ts) FILTER (WHERE part = 0) - INTERVAL 6 HOUR AS m0, max(ts) FILTER (WHERE part < 2) - INTERVAL 6 HOUR AS m1, max(ts) - INTERVAL 6 HOUR AS m2 FROM e)
SELECT hour, action, count(*) AS events, CAST(sum(k) AS BIGINT) AS tokens, count_if((part = 1 AND hour + INTERVAL 1 HOUR <= m0) OR (part = 2 AND hour + INTERVAL 1 HOUR <= m1)) AS late,
 hour + INTERVAL 1 HOUR <= max(m2) AS closed FROM e, m GROUP BY hour, action"""


def stream_rollup_batch(spark, d):
    """The same rollup as one batch."""
    return activity.rollup(activity.prepare(load(spark, d, "events")))


def stream_profile(spark, d):
    """Column profile of the events kept up to date by a stream."""
    events = load(spark, d, "events")
    out = running_profile.run(spark, _mixed_files(spark, d), "*.parquet", events.schema)
    exact = F.create_map(*[x for c, n in events.agg(*[F.count_distinct(c).alias(c) for c in events.columns]).first().asDict().items() for x in (F.lit(c), F.lit(n))])
    near = F.abs(F.col("cardinality") - exact[F.col("column")]) <= 0.05 * exact[F.col("column")] + 1  # the sketch's error bound
    return out.withColumn("sd", F.round("sd", 4)).withColumn("cardinality_near", near).drop("cardinality")


def stream_drift(spark, d):
    """Every day of the events against all days, from sketches kept by a stream over files in mixed order; moved: distance above 0.3."""
    events = load(spark, d, "events").drop("props", "event_type")
    out = drift.by_period(drift.run(spark, _mixed_files(spark, d), "*.parquet", events.schema, F.to_date("ts")))
    return out.select("column", F.col("period").alias("day"), "base_n", "n", "filled", (F.col("ks") > 0.3).alias("moved"))


# the largest difference of the two distribution functions, taken at every value
STREAM_DRIFT_SQL = " UNION ALL ".join(
    f"""SELECT * FROM (WITH e AS (SELECT ts::DATE AS day, {x} AS x FROM events), v AS (SELECT x, count(*) AS k FROM e WHERE x IS NOT NULL GROUP BY 1),
 a AS (SELECT x, sum(k) OVER (ORDER BY x) / sum(k) OVER () AS f FROM v), c AS (SELECT day, x, count(*) AS k FROM e WHERE x IS NOT NULL GROUP BY ALL),
 b AS (SELECT day, x, sum(k) OVER (PARTITION BY day ORDER BY x) / sum(k) OVER (PARTITION BY day) AS f, sum(k) OVER (PARTITION BY day ORDER BY x) - k AS before, sum(k) OVER (PARTITION BY day) AS total, k FROM c),
 g AS (SELECT day, max(greatest(abs(b.f - a.f), abs(b.before / b.total - (a.f - v.k / (SELECT sum(k) FROM v))), CASE WHEN b.before + b.k = b.total THEN 1 - a.f ELSE 0 END)) AS ks FROM b JOIN a USING (x) JOIN v USING (x) GROUP BY day)
 SELECT '{c}' AS "column", day, (SELECT count(*) FROM e) AS base_n, (SELECT count(*) FROM e e2 WHERE e2.day = g.day) AS n, (SELECT count(x) FROM e e2 WHERE e2.day = g.day) AS filled, ks > 0.3 AS moved FROM g)"""
    for c, x in (("event_id", "event_id"), ("ts", "ts"), ("user_id", "user_id"), ("value", "value"))
)
_EVENT_NUMBERS = ("event_id", "user_id", "value")
STREAM_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, "
    + (f"round(stddev_samp({c}), 4)" if c in _EVENT_NUMBERS else "NULL::DOUBLE")
    + " AS sd, true AS cardinality_near FROM events"
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
)

QUERIES = {
    "key_shapes": key_shapes, "hier_free_children": hier_free_children, "hier_two_parents": hier_two_parents,
    "stream_rollup": stream_rollup, "stream_rollup_batch": stream_rollup_batch, "stream_profile": stream_profile, "stream_hours": stream_hours, "stream_drift": stream_drift,
    "copula_marginals": copula_marginals, "copula_corr": copula_corr, "copula_sample": copula_sample, "single_synth": single_synth, "text_synth": text_synth, "text_synth_checks": text_synth_checks,
    "multi_synth": multi_synth, "multi_synth_checks": multi_synth_checks, "hier_synth": hier_synth, "hier_synth_checks": hier_synth_checks,
}

ORACLES = {
    "key_shapes": SHAPES_SQL, "hier_free_children": FREE_SQL, "hier_two_parents": TWO_PARENTS_SQL,
    "stream_rollup": STREAM_ROLLUP_SQL, "stream_rollup_batch": STREAM_ROLLUP_SQL, "stream_profile": STREAM_PROFILE_SQL, "stream_hours": STREAM_HOURS_SQL, "stream_drift": STREAM_DRIFT_SQL,
    "copula_marginals": MARGINALS_SQL, "copula_corr": COPULA_CORR_SQL, "copula_sample": COPULA_SAMPLE_SQL, "text_synth_checks": TEXT_CHECKS_SQL, "multi_synth_checks": MULTI_CHECKS_SQL, "hier_synth_checks": HIER_CHECKS_SQL,
}
