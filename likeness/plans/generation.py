"""Registered queries that generate tables and change them. Row counts and keys come from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_weighted
from ..operators import generate as G
from ..operators import postprocess as P
from ..operators import rows as W
from ..operators.generate import ColumnSpec, Link
from ..operators.pii import anonymize
from .common import load, sql_below, sql_bits, sql_list, sql_normal, sql_pick, sql_u, sql_weighted

SHOP = [
    ColumnSpec("customers", "customer_id", "INT", is_pk=True),
    ColumnSpec("customers", "full_name", "VARCHAR(255)", is_nullable=False),
    ColumnSpec("customers", "email", "VARCHAR(255)"),
    ColumnSpec("customers", "signup_date", "DATE"),
    ColumnSpec("orders", "order_id", "INT", is_pk=True),
    ColumnSpec("orders", "customer_id", "INT", is_nullable=False),
    ColumnSpec("orders", "order_date", "TIMESTAMP"),
    ColumnSpec("orders", "total_amount", "DECIMAL(10,2)"),
    ColumnSpec("orders", "status", "VARCHAR(50)", allowed_values="new|5, paid|3; sent|2, lost|0"),
    ColumnSpec("order_items", "item_id", "INT", is_pk=True),
    ColumnSpec("order_items", "order_id", "INT", is_nullable=False),
    ColumnSpec("order_items", "product_name", "VARCHAR(255)"),
    ColumnSpec("order_items", "quantity", "INT", null_percent=10),
    ColumnSpec("order_items", "unit_price", "DECIMAL(10,2)"),
    ColumnSpec("order_items", "line_total", "NUMERIC"),
]
SHOP_LINKS = [Link("orders", "customer_id", "customers", "customer_id"), Link("order_items", "order_id", "orders", "order_id")]


def shop(spark, d) -> G.SchemaGenerator:
    sizes = {"customers": "customer", "orders": "orders", "order_items": "lineitem"}
    return G.SchemaGenerator(spark, SHOP, SHOP_LINKS, {t: load(spark, d, s).count() for t, s in sizes.items()}, seed=42)


def gen_customers(spark, d):
    return shop(spark, d).table("customers")


def gen_orders_fk(spark, d):
    return shop(spark, d).table("orders").withColumn("total_amount", F.round("total_amount", 4))


def gen_price(spark, d):
    return shop(spark, d).table("order_items")


def _rows(table: str) -> str:
    return f"(SELECT range AS i FROM range((SELECT count(*) FROM {table})))"


_POOL = "greatest(500, (SELECT count(*) FROM {0}) // 2)"


def sql_text(kind: str, key: str, seed: int, stream: str) -> str:
    def n(part, size, start=0):
        return f"({sql_below(seed, f'{stream}.{part}', key, size)} + {start})"

    def w(part, values):
        return sql_pick(values, n(part, len(values)))

    first, last = w("first", G.FIRST_NAMES), w("last", G.LAST_NAMES)
    return {
        "first_name": first,
        "last_name": last,
        "name": f"{first} || ' ' || {last}",
        "email": f"lower({first}) || '.' || lower({last}) || {key} || '@example.' || {w('domain', G.DOMAINS)}",
        "phone_number": f"'+1-' || {n('area', 800, 200)} || '-' || {n('exchange', 800, 200)} || '-' || {n('line', 9000, 1000)}",
        "address": f"{n('number', 999, 1)} || ' ' || {last} || ' ' || {w('street', G.STREETS)}",
        "city": f"{w('start', G.CITY_STARTS)} || {w('end', G.CITY_ENDS)}",
        "country": w("country", G.COUNTRIES),
        "postcode": f"CAST({n('code', 90000, 10000)} AS VARCHAR)",
        "company": f"{last} || ' ' || {w('firm', G.FIRMS)}",
        "job": f"{w('level', G.JOB_LEVELS)} || ' ' || {w('job', G.JOBS)}",
        "ipv4": f"{n('a', 223, 1)} || '.' || {n('b', 256)} || '.' || {n('c', 256)} || '.' || {n('d', 254, 1)}",
    }[kind]


def _uv(stream: str, row: str = "i", seed: int = 42) -> str:
    return sql_u(seed, f"{stream}.value", row)


def _days_back(stream: str, row: str = "i") -> str:
    return f"(TIMESTAMP '2024-01-01' - to_days(CAST(floor({_uv(stream, row)} * 3650) AS INTEGER)))"


GEN_CUSTOMERS_SQL = f"""WITH k AS (SELECT i, CAST(floor({_uv('customers.full_name')} * {_POOL.format('customer')}) AS BIGINT) AS kn,
 CAST(floor({_uv('customers.email')} * {_POOL.format('customer')}) AS BIGINT) AS ke FROM {_rows('customer')})
SELECT i + 1 AS customer_id, {sql_text('name', 'kn', 42, 'customers.full_name')} AS full_name, {sql_text('email', 'ke', 42, 'customers.email')} AS email,
CAST({_days_back('customers.signup_date')} AS DATE) AS signup_date FROM k"""

_STATUS = parse_weighted("new|5, paid|3; sent|2, lost|0")
GEN_ORDERS_SQL = f"""SELECT i + 1 AS order_id, {sql_below(42, 'orders.customer_id.parent', 'i', '(SELECT count(*) FROM customer)')} + 1 AS customer_id,
{_days_back('orders.order_date')} AS order_date, round({_uv('orders.total_amount')} * 10000, 4) AS total_amount, {sql_weighted(_STATUS, _uv('orders.status'))} AS status FROM {_rows('orders')}"""


def _price_sql(key: str) -> str:
    return f"round(1.0::DOUBLE + ({sql_bits(0, 'price', key)} % 5000) / 100.0::DOUBLE, 2)"


GEN_PRICE_SQL = f"""WITH r AS (SELECT i, CASE WHEN {sql_u(42, 'order_items.quantity.null', 'i')} >= 0.1 THEN CAST(floor({_uv('order_items.quantity')} * 1000000) AS BIGINT) END AS quantity,
 CAST(floor({_uv('order_items.product_name')} * {_POOL.format('lineitem')}) AS BIGINT) AS kn, {_price_sql('(i + 1)')} AS price FROM {_rows('lineitem')})
SELECT i + 1 AS item_id, {sql_below(42, 'order_items.order_id.parent', 'i', '(SELECT count(*) FROM orders)')} + 1 AS order_id, {sql_text('name', 'kn', 42, 'order_items.product_name')} AS product_name,
quantity, price AS unit_price, round(price * least(greatest(coalesce(quantity, 1), 1), 25), 2) AS line_total FROM r"""


def gen_stitched(spark, d):
    """Generated payments that reference existing customers and line-item parts."""
    cols = [ColumnSpec("payments", "payment_id", "uuid", is_pk=True), ColumnSpec("payments", "o_custkey", "BIGINT"), ColumnSpec("payments", "part_type", "text"), ColumnSpec("payments", "paid", "bool")]
    links = [Link("payments", "o_custkey", "customer", "c_custkey"), Link("payments", "part_type", "part", "p_type")]
    gen = G.SchemaGenerator(
        spark, cols, links, load(spark, d, "orders").count(), seed=7, parents={"customer": load(spark, d, "customer"), "part": load(spark, d, "part")}
    )
    return gen.table("payments")


def _uuid_sql(seed: int, stream: str, key: str) -> str:
    h = f"md5(concat_ws('|', '{seed}', '{stream}', CAST({key} AS VARCHAR)))"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def _pool_sql(table: str, key: str, seed: int, stream: str) -> str:
    return f"(SELECT k, row_number() OVER (ORDER BY {sql_bits(seed, stream, 'k')}, k) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {key} AS k FROM {table} WHERE {key} IS NOT NULL))"


GEN_STITCHED_SQL = f"""WITH c AS {_pool_sql('customer', 'c_custkey', 7, 'payments.o_custkey.pool')}, p AS {_pool_sql('part', 'p_type', 7, 'payments.part_type.pool')},
r AS (SELECT i, {sql_below(7, 'payments.o_custkey.parent', 'i', '(SELECT count(*) FROM c)')} AS rc, {sql_below(7, 'payments.part_type.parent', 'i', '(SELECT count(*) FROM p)')} AS rp FROM {_rows('orders')})
SELECT {_uuid_sql(7, 'payments.payment_id', 'i')} AS payment_id, c.k AS o_custkey, p.k AS part_type, {sql_u(7, 'payments.paid.value', 'i')} > 0.5 AS paid
FROM r JOIN c ON c.r = rc JOIN p ON p.r = rp"""


def gen_cycle(spark, d):
    """Companies and users that reference each other; all keys resolve."""
    cols = [
        ColumnSpec("company", "id", "INT", is_pk=True), ColumnSpec("company", "head_user_id", "INT"),
        ColumnSpec("users", "id", "INT", is_pk=True), ColumnSpec("users", "company_id", "INT"),
    ]
    links = [Link("company", "head_user_id", "users", "id"), Link("users", "company_id", "company", "id")]
    gen = G.SchemaGenerator(spark, cols, links, {"company": load(spark, d, "supplier").count(), "users": load(spark, d, "customer").count()}, seed=3)
    company, users = gen.table("company"), gen.table("users")
    return users.join(company.select(F.col("id").alias("company_id"), "head_user_id"), "company_id").select("id", "company_id", "head_user_id")


GEN_CYCLE_SQL = f"""WITH u AS (SELECT i + 1 AS id, {sql_below(3, 'users.company_id.parent', 'i', '(SELECT count(*) FROM supplier)')} + 1 AS company_id FROM {_rows('customer')})
SELECT id, company_id, {sql_below(3, 'company.head_user_id.parent', '(company_id - 1)', '(SELECT count(*) FROM customer)')} + 1 AS head_user_id FROM u"""

_KINDS = {
    "first_name": "first_name", "LastName": "last_name", "name": "name", "email": "email", "phone": "phone_number", "contact": "phone_number", "address": "address",
    "city": "city", "country": "country", "zip": "postcode", "company": "company", "job": "job", "ip": "ipv4",
}


def gen_text_kinds(spark, d):
    """All text kinds, fallback text, other types, and nulls, one row per customer."""
    cols = [ColumnSpec("people", n, "varchar", is_nullable=i % 2 == 0, null_percent=20) for i, n in enumerate(_KINDS)]
    cols += [
        ColumnSpec("people", "note", "text", generator="auto"), ColumnSpec("people", "badge_id", "text"), ColumnSpec("people", "score", "float"),
        ColumnSpec("people", "visits", "smallint", null_percent="50"), ColumnSpec("people", "level", "text", allowed_values="low,mid", allowed_values_expanded="low|1, mid|1, top|2", expand_categories=True),
        ColumnSpec("people", "seen", "text", generator="datetime"),
    ]
    gen = G.SchemaGenerator(spark, cols, rows=load(spark, d, "customer").count(), seed=11)
    return gen.fill("people", spark.range(gen.row_counts["people"]), F.col("id")).withColumn("score", F.round("score", 4))


def _text_kinds_sql() -> str:
    out = ["i AS id"]
    for n, (name, kind) in enumerate(_KINDS.items()):
        key = f"CAST(floor({_uv(f'people.{name}', seed=11)} * {_POOL.format('customer')}) AS BIGINT)"
        value = sql_text(kind, "k", 11, f"people.{name}")
        value = f"(SELECT {value} FROM (SELECT {key} AS k))"
        out.append(f"CASE WHEN {sql_u(11, f'people.{name}.null', 'i')} >= 0.2 THEN {value} END AS {name}" if n % 2 == 0 else f"{value} AS {name}")
    out.append(f"'val_' || CAST(floor({_uv('people.note', seed=11)} * 1001) AS BIGINT) AS note")
    out.append(f"CAST(CAST(floor({_uv('people.badge_id', seed=11)} * 1000000) AS BIGINT) AS VARCHAR) AS badge_id")
    out.append(f"round({_uv('people.score', seed=11)} * 10000, 4) AS score")
    out.append(f"CASE WHEN {sql_u(11, 'people.visits.null', 'i')} >= 0.5 THEN CAST(floor({_uv('people.visits', seed=11)} * 1000000) AS BIGINT) END AS visits")
    out.append(f"{sql_weighted([('low', 0.25), ('mid', 0.25), ('top', 0.5)], _uv('people.level', seed=11))} AS level")
    out.append(f"strftime(TIMESTAMP '2024-01-01' - to_days(CAST(floor({_uv('people.seen', seed=11)} * 3650) AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS seen")
    return f"SELECT {', '.join(out)} FROM {_rows('customer')}"


def gen_lonely_keys(spark, d):
    """Foreign keys to tables that are not generated: a drawn number, or a stable id where the type is text; one row per customer."""
    cols = [ColumnSpec("visits", "shop_id", "bigint"), ColumnSpec("visits", "guide_id", "varchar")]
    links = [Link("visits", "shop_id", "shops", "id"), Link("visits", "guide_id", "guides", "id")]
    customers = load(spark, d, "customer").select("c_custkey")
    gen = G.SchemaGenerator(spark, cols, links, rows=customers.count(), seed=17)
    return gen.fill("visits", customers, F.col("c_custkey"))


_LONELY_ID = "md5(concat_ws('|', '17', 'visits.guide_id', CAST(c_custkey AS VARCHAR)))"
LONELY_SQL = f"""SELECT c_custkey, CAST(floor({sql_u(17, 'visits.shop_id.value', 'c_custkey')} * 1000000) AS BIGINT) AS shop_id,
concat_ws('-', substr({_LONELY_ID}, 1, 8), substr({_LONELY_ID}, 9, 4), substr({_LONELY_ID}, 13, 4), substr({_LONELY_ID}, 17, 4), substr({_LONELY_ID}, 21, 12)) AS guide_id FROM customer"""


def gen_planned(spark, d):
    """Table sizes from foreign-key layers, then counts of what is generated."""
    from ..operators.graph import plan_rows

    tables = spark.createDataFrame([(t,) for t in ("customers", "orders", "order_items")], "node string")
    edges = spark.createDataFrame([(k.to_table, k.from_table, "1:N") for k in SHOP_LINKS], "parent string, child string, cardinality string")
    base = load(spark, d, "customer").count()
    plan = {r["node"]: r["rows"] for r in plan_rows(tables, edges, base).collect()}
    gen = G.SchemaGenerator(spark, SHOP, SHOP_LINKS, plan, seed=42)
    o, c = gen.table("orders"), gen.table("customers")
    return o.join(c, "customer_id").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("customer_id").alias("buyers"), F.round(F.sum("total_amount"), 2).alias("total"))


GEN_PLANNED_SQL = f"""WITH r AS (SELECT range AS i FROM range((SELECT count(*) * 5 FROM customer)))
SELECT count(*) AS orders, count(DISTINCT {sql_below(42, 'orders.customer_id.parent', 'i', '(SELECT count(*) FROM customer)')}) AS buyers, round(sum({_uv('orders.total_amount')} * 10000), 2) AS total FROM r"""


# --- changes -------------------------------------------------------------------------


def anonymize_customer(spark, d):
    c = load(spark, d, "customer").withColumns({
        "email": F.concat("c_name", F.lit("@x.org")), "mobile": F.col("c_custkey").cast("string"), "street": F.col("c_mktsegment"),
        "c_mktsegment": F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")),
    })
    return anonymize(c, ["c_name", "email", "mobile", "street", "c_mktsegment"], ["c_custkey"]).drop("c_acctbal")


def _mask_sql(name: str, prefix: str, lo: int, hi: int, suffix: str = "") -> str:
    return f"'{prefix}' || ({sql_below(42, f'{name}.mask', 'c_custkey', hi - lo)} + {lo}) || '{suffix}' AS {name}"


ANONYMIZE_SQL = f"""SELECT c_custkey, c_nationkey, {_mask_sql('c_name', 'Person_', 10000, 99999)}, {_mask_sql('email', 'user', 100000, 999999, '@example.com')},
{_mask_sql('mobile', '+1', 2000000000, 9999999999)}, {_mask_sql('street', 'Address_', 10000, 99999)},
CASE WHEN c_acctbal > 0 THEN 'masked_' || ({sql_below(42, 'c_mktsegment.mask', 'c_custkey', 899999)} + 100000) END AS c_mktsegment FROM customer"""


def anonymize_joinable(spark, d):
    """Equal values get equal masks, so masked keys still join and count the same."""
    c = load(spark, d, "customer")
    return anonymize(c, ["c_mktsegment"], ["c_custkey"], consistent=True).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


JOINABLE_SQL = f"""SELECT 'masked_' || ({sql_below(42, 'mask', 'c_mktsegment', 899999)} + 100000) AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1"""


def randomize_orders(spark, d):
    cfg = [
        P.ColumnConfig("o_totalprice", "DOUBLE", randomization_pct=10), P.ColumnConfig("o_orderstatus", "VARCHAR", allowed_values="F|3, O|1, X|0"),
        P.ColumnConfig("o_orderdate", "TIMESTAMP", randomization_pct=5), P.ColumnConfig("o_orderpriority", "VARCHAR", randomization_pct=30),
        P.ColumnConfig("o_custkey", "BIGINT", randomization_pct=100), P.ColumnConfig("o_orderkey", "BIGINT", is_pk=True, randomization_pct=100),
    ]
    out = P.apply_config(load(spark, d, "orders", "o_orderkey"), "orders", cfg, ["o_orderkey"], seed=42, locked={"o_custkey"})
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


def _k_of(n: str, share: float) -> str:
    return f"greatest(1, CAST(round_even({n} * {share}::DOUBLE, 0) AS BIGINT))"


def _rank(stream: str, key: str, seed: int = 42, where: str = "") -> str:
    part = f"PARTITION BY {where} " if where else ""
    return f"row_number() OVER ({part}ORDER BY {sql_bits(seed, stream, key)}, {key})"


RANDOMIZE_SQL = f"""WITH s AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS d0, greatest(1, datediff('day', min(o_orderdate), max(o_orderdate))) AS span FROM orders),
r AS (SELECT *, {_rank('orders.o_totalprice.chosen', 'o_orderkey')} AS r1, {_rank('orders.o_orderdate.chosen', 'o_orderkey')} AS r2, {_rank('orders.o_orderpriority.chosen', 'o_orderkey')} AS r3 FROM orders)
SELECT o_orderkey, o_custkey, {sql_weighted(parse_weighted('F|3, O|1, X|0'), sql_u(42, 'orders.o_orderstatus.listed', 'o_orderkey'))} AS o_orderstatus,
round(CASE WHEN r1 <= {_k_of('n', 0.1)} THEN lo + {sql_u(42, 'orders.o_totalprice.random', 'o_orderkey')} * (hi - lo) ELSE o_totalprice END, 4) AS o_totalprice,
CASE WHEN r2 <= {_k_of('n', 0.05)} THEN d0 + to_days(CAST(floor({sql_u(42, 'orders.o_orderdate.random', 'o_orderkey')} * (span + 1)) AS INTEGER)) ELSE o_orderdate END AS o_orderdate,
CASE WHEN r3 <= {_k_of('n', 0.3)} THEN 'o_orderpriority_' || CAST(floor({sql_u(42, 'orders.o_orderpriority.random', 'o_orderkey')} * 10) + 1 AS BIGINT) ELSE o_orderpriority END AS o_orderpriority
FROM r, s"""


def randomize_typed(spark, d):
    """Value lists that become numbers and dates, and numbers inside text."""
    part = load(spark, d, "part").withColumns({"made": F.lit("2020-01-01"), "code": F.when(F.col("p_size") < 30, F.col("p_size").cast("string")).otherwise(F.col("p_type"))})
    cfg = [
        P.ColumnConfig("p_size", "INT", allowed_values="1|1,2.5|1,40|2", randomization_pct=20), P.ColumnConfig("made", "DATE", allowed_values="2021-01-05, 2022-02-06"),
        P.ColumnConfig("code", "VARCHAR", generator="numerical", randomization_pct=50), P.ColumnConfig("p_retailprice", "DECIMAL", allowed_values="1.5, many"),
    ]
    out = P.apply_config(part, "part", cfg, ["p_partkey"], seed=5)
    return out.withColumn("code", F.round("code", 4)).select("p_partkey", "p_size", "made", "code", "p_retailprice")


def _listed(col: str, values, n: int = 5) -> str:
    return sql_weighted(values, sql_u(n, f"part.{col}.listed", "p_partkey"))


_SIZES = [("1", 0.25), ("2.5", 0.25), ("40", 0.5)]
TYPED_SQL = f"""WITH s AS (SELECT count(*) AS n, min(p_size) FILTER (WHERE p_size < 30)::DOUBLE AS lo, max(p_size) FILTER (WHERE p_size < 30)::DOUBLE AS hi FROM part),
r AS (SELECT *, {_rank('part.p_size.chosen', 'p_partkey', 5)} AS r1, {_rank('part.code.chosen', 'p_partkey', 5)} AS r2 FROM part)
SELECT p_partkey, CAST(round_even(CAST(CASE WHEN r1 <= {_k_of('n', 0.2)} THEN {sql_weighted(_SIZES, sql_u(5, 'part.p_size.random', 'p_partkey'))} ELSE {_listed('p_size', _SIZES)} END AS DOUBLE), 0) AS BIGINT) AS p_size,
CAST({_listed('made', [('2021-01-05', .5), ('2022-02-06', .5)])} AS TIMESTAMP) AS made,
round(CASE WHEN r2 <= {_k_of('n', 0.5)} THEN lo + {sql_u(5, 'part.code.random', 'p_partkey')} * (hi - lo) WHEN p_size < 30 THEN p_size END, 4) AS code,
{_listed('p_retailprice', [('1.5', .5), ('many', .5)])} AS p_retailprice FROM r, s"""

_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def bounds_lineitem(spark, d):
    cfg = [
        P.ColumnConfig("l_quantity", "DOUBLE", min_val=40, max_val="10"), P.ColumnConfig("l_discount", "DOUBLE", min_val=0.02), P.ColumnConfig("l_tax", "DOUBLE", max_val=0.05),
        P.ColumnConfig("l_linenumber", "INT", min_val=2, max_val=2), P.ColumnConfig("l_extendedprice", "INTEGER", min_val="5000.5"), P.ColumnConfig("l_returnflag", "VARCHAR", min_val=1),
    ]
    out = P.apply_config(load(spark, d, "lineitem", "l_orderkey"), "li", cfg, _LI, seed=9)
    return out.withColumn("l_quantity", F.round("l_quantity", 4)).drop("l_shipdate")


BOUNDS_SQL = f"""SELECT l_orderkey, l_partkey, l_suppkey, CAST(2 AS BIGINT) AS l_linenumber, round(10.0::DOUBLE + {sql_u(9, 'li.l_quantity.bounds', _LI)} * 30.0::DOUBLE, 4) AS l_quantity,
CAST(round_even(greatest(l_extendedprice, 5000.5), 0) AS BIGINT) AS l_extendedprice, greatest(l_discount, 0.02) AS l_discount, least(l_tax, 0.05) AS l_tax, l_returnflag, l_linestatus FROM lineitem"""


def inject_nulls_part(spark, d):
    part = load(spark, d, "part").withColumn("p_retailprice", F.when(F.col("p_size") > 10, F.col("p_retailprice"))).withColumn("p_brand", F.when(F.col("p_size") > 5, F.col("p_brand")))
    cfg = [
        P.ColumnConfig("p_size", "INT", null_percent=12.5), P.ColumnConfig("p_type", "VARCHAR", null_percent="30", is_nullable="yes"), P.ColumnConfig("p_name", "VARCHAR", null_percent=50, is_nullable=False),
        P.ColumnConfig("p_retailprice", "DOUBLE", null_percent=5), P.ColumnConfig("p_brand", "VARCHAR", null_percent=40),
    ]
    return P.apply_config(part, "part", cfg, ["p_partkey"], seed=8)


def _null_rank(col: str, cond: str) -> str:
    return f"CASE WHEN {cond} THEN {_rank(f'part.{col}.nulls', 'p_partkey', 8, f'({cond})')} END"


NULLS_SQL = f"""WITH s AS (SELECT count(*) AS n, count_if(p_size <= 5) AS nb FROM part),
r AS (SELECT *, {_null_rank('p_size', 'true')} AS r1, {_null_rank('p_type', 'true')} AS r2, {_null_rank('p_brand', 'p_size > 5')} AS r3 FROM part)
SELECT p_partkey, p_name, CASE WHEN p_size > 5 AND r3 > round_even(n * 0.4::DOUBLE, 0) - nb THEN p_brand END AS p_brand, CASE WHEN r2 > round_even(n * 0.3::DOUBLE, 0) THEN p_type END AS p_type,
CASE WHEN r1 > round_even(n * 0.125::DOUBLE, 0) THEN p_size END AS p_size, CASE WHEN p_size > 10 THEN p_retailprice END AS p_retailprice FROM r, s"""


def noise_lineitem(spark, d):
    out = P.add_noise(load(spark, d, "lineitem", "l_orderkey").withColumn("fixed", F.lit(7.0)), ["l_quantity", "l_extendedprice", "fixed", "l_linenumber"], _LI[:3], seed=13, stddev_scale=0.5, variation_pct=20)
    return out.select(*_LI[:3], "l_linenumber", *[F.round(c, 4).alias(c) for c in ("l_quantity", "l_extendedprice", "fixed")])


NOISE_SQL = f"""WITH s AS (SELECT stddev_pop(l_quantity) AS a, stddev_pop(l_extendedprice) AS b, stddev_pop(l_linenumber) AS c FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, CAST(round_even(l_linenumber + {sql_normal(13, 'l_linenumber.noise', _LI[:3])} * (c * 0.5 * 20 / 100.0::DOUBLE), 0) AS BIGINT) AS l_linenumber,
round(l_quantity + {sql_normal(13, 'l_quantity.noise', _LI[:3])} * (a * 0.5 * 20 / 100.0::DOUBLE), 4) AS l_quantity,
round(l_extendedprice + {sql_normal(13, 'l_extendedprice.noise', _LI[:3])} * (b * 0.5 * 20 / 100.0::DOUBLE), 4) AS l_extendedprice,
round(7.0::DOUBLE + {sql_normal(13, 'fixed.noise', _LI[:3])} * 0.1::DOUBLE, 4) AS fixed FROM lineitem, s"""


def knn_smooth_part(spark, d):
    part = load(spark, d, "part").withColumn("p_size", F.when(F.col("p_type") != "SMALL", F.col("p_size")))
    out = P.knn_smooth(part, load(spark, d, "part"), ["p_size", "p_retailprice"], ["p_partkey"], seed=42, smoothing=0.4, neighbors=3)
    return out.select("p_partkey", "p_size", F.round("p_retailprice", 4).alias("p_retailprice"))


KNN_SQL = f"""WITH src AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b, {sql_bits(42, 'knn.source', 'p_partkey')} AS o FROM part),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM src),
z AS (SELECT a, b, o, (a - ma) / sa AS za, (b - mb) / sb AS zb FROM src, m),
q AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, (p_size - ma) / sa AS za, (p_retailprice - mb) / sb AS zb FROM part, m WHERE p_type <> 'SMALL'),
n AS (SELECT q.p_partkey, any_value(q.a) AS a, any_value(q.b) AS b,
  min({{'d': round(power(z.za - q.za, 2) + power(z.zb - q.zb, 2), 9), 'o': z.o, 'a': z.a, 'b': z.b}}, 3) AS near FROM q, z GROUP BY q.p_partkey)
SELECT p.p_partkey, CASE WHEN p_type <> 'SMALL' THEN CAST(round_even(0.6::DOUBLE * n.a + 0.4::DOUBLE * list_sum(list_transform(near, lambda x: x.a)) / 3, 0) AS BIGINT) END AS p_size,
round(CASE WHEN p_type <> 'SMALL' THEN 0.6::DOUBLE * n.b + 0.4::DOUBLE * list_sum(list_transform(near, lambda x: x.b)) / 3 ELSE p_retailprice END, 4) AS p_retailprice
FROM part p LEFT JOIN n USING (p_partkey)"""


def knn_smooth_lines(spark, d):
    """Suppliers pulled towards the nearest of all line items; many line items share a point."""
    s = load(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50 + 0.5).alias("l_quantity"), (F.col("s_suppkey") % 11 / 100.0).alias("l_discount"))
    li = load(spark, d, "lineitem")
    out = P.knn_smooth(s, li, ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"], seed=42, smoothing=0.5, neighbors=7)
    return out.select("s_suppkey", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"))


KNN_LINES_SQL = f"""WITH p AS (SELECT l_quantity AS a, l_discount AS b, min({sql_bits(42, 'knn.source', ['l_orderkey', 'l_linenumber'])}) AS o, count(*) AS c FROM lineitem GROUP BY ALL),
m AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, stddev_pop(l_quantity) AS sa, stddev_pop(l_discount) AS sb FROM lineitem),
q AS (SELECT s_suppkey, s_suppkey % 50 + 0.5::DOUBLE AS a, s_suppkey % 11 / 100.0::DOUBLE AS b FROM supplier),
n AS (SELECT s_suppkey, q.a AS qa, q.b AS qb, p.a, p.b, c, sum(c) OVER (PARTITION BY s_suppkey ORDER BY round(power((p.a - ma) / sa - (q.a - ma) / sa, 2) + power((p.b - mb) / sb - (q.b - mb) / sb, 2), 9), o
 ROWS UNBOUNDED PRECEDING) AS run FROM q, p, m)
SELECT s_suppkey, round(0.5 * any_value(qa) + 0.5 * sum(a * least(c, greatest(0, 7 - (run - c)))) / 7, 6) AS l_quantity, round(0.5 * any_value(qb) + 0.5 * sum(b * least(c, greatest(0, 7 - (run - c)))) / 7, 6) AS l_discount
FROM n GROUP BY s_suppkey"""


def parameter_gate(spark, d):
    """Noise and then smoothing, as asked for by generation parameters."""
    part = load(spark, d, "part", "p_partkey")
    cfg = [P.ColumnConfig("p_size", "INT"), P.ColumnConfig("p_retailprice", "DOUBLE"), P.ColumnConfig("p_name", "VARCHAR")]
    params = {"variation_pct": 5, "stddev_scale": 2.0, "knn_smoothing": 0.5, "knn_neighbors": 4}
    return P.generation_parameters(part, cfg, ["p_partkey"], 42, params, load(spark, d, "part"))


def numeric_columns(spark, d):
    """Columns that count as numeric by type and content."""
    o = load(spark, d, "orders").withColumns({"as_text": F.col("o_totalprice").cast("string"), "words": F.col("o_orderstatus")})
    cfg = [P.ColumnConfig("as_text", "VARCHAR", generator="numerical"), P.ColumnConfig("words", "VARCHAR", generator="numerical")]
    n = o.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.explode(F.array(*[F.lit(c) for c in P.config_numeric(o, cfg)])).alias("column"), "n")


def resample_up(spark, d):
    """Customers grown to the number of orders by draws with replacement."""
    c = load(spark, d, "customer")
    return W.resample(c, ["c_custkey"], load(spark, d, "orders").count(), 4, "grow").select("c_custkey", "copy")


RESAMPLE_UP_SQL = f"""WITH x AS (SELECT c_custkey, {_rank('grow.index', 'c_custkey', 4)} - 1 AS r FROM customer), n AS (SELECT count(*) AS n FROM customer),
e AS (SELECT range AS copy FROM range(1, (SELECT count(*) FROM orders) - (SELECT n FROM n) + 1))
SELECT c_custkey, 0 AS copy FROM customer UNION ALL SELECT c_custkey, copy FROM (SELECT copy, {sql_below(4, 'grow.extra', 'copy', 'n')} AS r FROM e, n) JOIN x USING (r)"""


def resample_down(spark, d):
    """Orders cut to the number of customers."""
    o = load(spark, d, "orders")
    return W.resample(o, ["o_orderkey"], load(spark, d, "customer").count(), 4, "shrink").select("o_orderkey", "o_totalprice")


RESAMPLE_DOWN_SQL = f"""SELECT o_orderkey, o_totalprice FROM (SELECT *, {_rank('shrink', 'o_orderkey', 4)} AS r FROM orders) WHERE r <= (SELECT count(*) FROM customer)"""


def row_index(spark, d):
    """Dense random-order numbers for orders, and dense time-order numbers per event type."""
    a = W.hashed_index(load(spark, d, "orders"), ["o_orderkey"], 1, "ix").select(F.lit("orders").alias("part"), F.col("o_orderkey").alias("id"), F.col("row_idx").cast("bigint").alias("n"))
    b = W.ordered_index(load(spark, d, "events"), ["event_type"], ["ts", "event_id"]).select(F.col("event_type"), F.col("event_id"), F.col("t").cast("bigint"))
    return a.union(b)


ROW_INDEX_SQL = f"""SELECT 'orders' AS part, o_orderkey AS id, {_rank('ix', 'o_orderkey', 1)} - 1 AS n FROM orders
UNION ALL SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 FROM events"""

QUERIES = {
    "gen_customers": gen_customers, "gen_orders_fk": gen_orders_fk, "gen_price": gen_price, "gen_stitched": gen_stitched, "gen_cycle": gen_cycle,
    "gen_text_kinds": gen_text_kinds, "gen_planned": gen_planned, "anonymize_customer": anonymize_customer, "anonymize_joinable": anonymize_joinable,
    "randomize_orders": randomize_orders, "randomize_typed": randomize_typed, "bounds_lineitem": bounds_lineitem, "inject_nulls_part": inject_nulls_part,
    "gen_lonely_keys": gen_lonely_keys, "parameter_gate": parameter_gate, "numeric_columns": numeric_columns, "noise_lineitem": noise_lineitem, "knn_smooth_part": knn_smooth_part, "knn_smooth_lines": knn_smooth_lines, "resample_up": resample_up, "resample_down": resample_down, "row_index": row_index,
}

ORACLES = {
    "gen_customers": GEN_CUSTOMERS_SQL, "gen_orders_fk": GEN_ORDERS_SQL, "gen_price": GEN_PRICE_SQL, "gen_stitched": GEN_STITCHED_SQL, "gen_cycle": GEN_CYCLE_SQL,
    "gen_text_kinds": _text_kinds_sql(), "gen_planned": GEN_PLANNED_SQL, "anonymize_customer": ANONYMIZE_SQL, "anonymize_joinable": JOINABLE_SQL,
    "randomize_orders": RANDOMIZE_SQL, "randomize_typed": TYPED_SQL, "bounds_lineitem": BOUNDS_SQL, "inject_nulls_part": NULLS_SQL,
    "gen_lonely_keys": LONELY_SQL,
    "numeric_columns": """SELECT c AS "column", (SELECT count(*) FROM orders) AS n FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice'), ('as_text')) t(c)""", "noise_lineitem": NOISE_SQL, "knn_smooth_part": KNN_SQL, "knn_smooth_lines": KNN_LINES_SQL, "resample_up": RESAMPLE_UP_SQL, "resample_down": RESAMPLE_DOWN_SQL, "row_index": ROW_INDEX_SQL,
}
