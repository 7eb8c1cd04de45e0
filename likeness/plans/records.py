"""Registered queries on logs, display text and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import random as R
from ..functions import replies as J
from ..functions import text as X
from ..operators import logs as L
from ..session import work_folder
from ..sources import bundle as B
from .common import load, sql_below, sql_u

_DETAILS = """CASE event_type WHEN 'click' THEN concat('{"total_tokens": ', user_id, ', "b": "x", "a": ', event_id, '}')
 WHEN 'view' THEN concat('{"prompt_tokens": ', user_id, ', "completion_tokens": 2}') WHEN 'error' THEN concat(' plain text ', user_id, ' ') ELSE props END"""


def activity_log(spark, d) -> DataFrame:
    """Events as an activity log: the JSON props are the details."""
    e = load(spark, d, "events")
    return e.select(
        F.col("event_id").alias("log_id"), F.concat(F.lit("User"), "user_id").alias("username"), F.concat("event_type", F.lit("_page")).alias("action"),
        F.concat(F.lit("project-"), F.col("user_id") + 1000).alias("project_id"), F.when(F.col("value") > 10, F.concat(F.lit("table-"), F.col("event_id") + 10000)).alias("table_id"),
        F.expr(_DETAILS).alias("details"), F.col("ts").alias("created_at"), "event_type", "user_id",
    )


LOG_SQL = f"""log AS (SELECT event_id AS log_id, 'User' || user_id AS username, event_type || '_page' AS action, 'project-' || (user_id + 1000) AS project_id,
 CASE WHEN value > 10 THEN 'table-' || (event_id + 10000) END AS table_id, {_DETAILS} AS details, ts AS created_at, event_type, user_id FROM events)"""
_SHOWN = ["log_id", "username", "action", "details"]


def activity_recent(spark, d):
    return L.recent(activity_log(spark, d), 100).select(*_SHOWN)


def activity_of_user(spark, d):
    return L.recent(activity_log(spark, d), 500, "uSER7").select(*_SHOWN)


def activity_newest_per_user(spark, d):
    return L.recent_per_user(activity_log(spark, d), 5).select("log_id", "username", "rank")


def user_search(spark, d):
    return L.search_users(activity_log(spark, d), " SER1 ").groupBy("username").agg(F.count(F.lit(1)).alias("events"))


def activity_tokens(spark, d):
    return L.activity_rows(activity_log(spark, d))


TOKENS_SQL = f"""WITH {LOG_SQL} SELECT log_id, replace(action, '_', ' ') AS action, CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR) ELSE '' END AS total_tokens,
CASE event_type WHEN 'click' THEN '{{"a": ' || log_id || ', "b": "x"}}' WHEN 'view' THEN '{{"completion_tokens": 2, "prompt_tokens": ' || user_id || '}}'
 WHEN 'error' THEN trim(details) ELSE details END AS details FROM log"""


def activity_rollup(spark, d):
    return L.token_rollup(activity_log(spark, d), ["username", "action"])


ROLLUP_SQL = f"""WITH {LOG_SQL}, u AS (SELECT *, CASE WHEN event_type = 'view' THEN user_id END AS p, CASE WHEN event_type = 'view' THEN 2 END AS c,
 CASE event_type WHEN 'click' THEN user_id WHEN 'view' THEN user_id + 2 END AS t FROM log)
SELECT username, action, count(*) AS events, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(t) AS BIGINT) AS total_tokens FROM u GROUP BY ALL"""


def activity_lines(spark, d):
    log = activity_log(spark, d)
    return log.select("log_id", J.activity_line("username", "action", "project_id", "table_id", "details", "created_at", "Asia/Kolkata").alias("line"))


LINES_SQL = f"""WITH {LOG_SQL} SELECT log_id, concat_ws(' | ', strftime(created_at + INTERVAL '5 hours 30 minutes', '%Y-%m-%d %H:%M:%S'), username, replace(action, '_', ' '),
'project ' || substr(project_id, 1, 8), 'table ' || substr(table_id, 1, 8), trim(details)) AS line FROM log"""


def timezone_display(spark, d):
    """The same instant as epoch text, ISO text and plain text."""
    e = load(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id", D.display_time(F.unix_seconds(ts).cast("string"), "America/New_York").alias("from_epoch"),
        D.display_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "Asia/Kolkata").alias("from_iso"),
        D.display_time(F.concat(F.lit("at T"), "event_type", F.lit(" of something long"))).alias("from_text"),
        D.display_time(F.when(F.col("value") < 5, F.lit(" "))).alias("from_blank"),
    )


TIMEZONE_SQL = """SELECT event_id, strftime(ts - INTERVAL '5 hours', '%Y-%m-%d %H:%M:%S') AS from_epoch, strftime(ts + INTERVAL '5 hours 30 minutes', '%Y-%m-%d %H:%M:%S') AS from_iso,
substr(replace('at T' || event_type || ' of something long', 'T', ' '), 1, 19) AS from_text, 'Never' AS from_blank FROM events"""


def format_dates(spark, d):
    """Real dates, date text and unreadable text in output formats."""
    o = load(spark, d, "orders")
    kind = dict((f.name, f.dataType) for f in o.schema.fields)["o_orderdate"]
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderstatus") == "O", F.lit("soon"))
    return o.select(
        "o_orderkey", D.format_datetime(F.col("o_orderdate"), "%d/%m/%Y", kind).alias("day"), D.format_datetime(F.col("o_orderdate"), "%b %d, %y at %I:%M %p", kind).alias("long_form"),
        D.format_datetime(text, D.TIMESTAMP_FORMAT).alias("stamp"), D.format_datetime(text, "%H-%j").alias("hour_day"),
    )


FORMAT_SQL = """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, strftime(o_orderdate, '%b %d, %y at %I:%M %p') AS long_form,
CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 'O' THEN 'soon' END AS stamp,
CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%H-%j') WHEN 'O' THEN 'soon' END AS hour_day FROM orders"""


def preview(spark, d):
    """First rows of a table with NaN and infinities shown as null."""
    p = load(spark, d, "part").withColumn("ratio", F.when(F.col("p_size") < 20, F.lit(float("nan"))).when(F.col("p_size") < 30, F.lit(float("-inf"))).otherwise(F.col("p_retailprice")))
    return B.preview(p, 25, order=["p_partkey"]).select("p_partkey", "p_size", "ratio")


PREVIEW_SQL = "SELECT p_partkey, p_size, CASE WHEN p_size >= 30 THEN p_retailprice END AS ratio FROM part ORDER BY p_partkey LIMIT 25"


def finite_values(spark, d):
    """NaN and infinities become null over the whole table."""
    li = load(spark, d, "lineitem").withColumn("x", F.when(F.col("l_discount") < 0.03, F.lit(float("nan"))).when(F.col("l_discount") < 0.05, F.lit(float("inf"))).otherwise(F.col("l_quantity")))
    return B.finite_rows(li).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("finite"), F.round(F.sum("x"), 2).alias("total"))


FINITE_SQL = """SELECT l_returnflag, count(*) AS n, count_if(l_discount >= 0.05) AS finite, round(sum(l_quantity) FILTER (WHERE l_discount >= 0.05), 2) AS total FROM lineitem GROUP BY 1"""


def csv_round_trip(spark, d):
    """Tables written as one CSV folder each and read back with their schema."""
    out = work_folder(spark, "csv")
    tables = {n: load(spark, d, n) for n in ("customer", "orders")}
    B.write_tables(tables, out, "csv", {"orders": [{"column_name": "o_orderdate", "data_type": "DATE"}]})
    back = B.read_tables(spark, out, "csv", {n: t.schema for n, t in tables.items()})
    return back["orders"].join(back["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last")
    )


ROUND_SQL = """SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""


def csv_sniffed(spark, d):
    """Column types found in CSV text without a schema."""
    out = work_folder(spark, "csv")
    B.write_tables({"part": load(spark, d, "part")}, out, "csv")
    t = B.read_csv(spark, f"{out}/part", escaped=True)
    types = t.schema
    row = t.agg(F.count(F.lit(1)).alias("n"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in types.fields])).alias("c"), "n").select("c.*", "n")


def _sniffed(c: str) -> str:
    """The narrowest type that all texts of a column can be read as, by casts."""
    text = f"CAST({c} AS VARCHAR)"
    kinds = [("int", "INTEGER"), ("bigint", "BIGINT"), ("double", "DOUBLE")]
    cases = " ".join(f"WHEN count(TRY_CAST({text} AS {sql})) = count({c}) AND (count_if({text} LIKE '%.%') = 0 OR '{name}' = 'double') THEN '{name}'" for name, sql in kinds)
    return f"SELECT '{c}' AS \"column\", CASE {cases} ELSE 'string' END AS type, count(*) AS n FROM part"


SNIFF_SQL = " UNION ALL ".join(_sniffed(c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))


def csv_documents(spark, d):
    """Whole texts with line breaks, quotes, backslashes and spaces at the ends through CSV files of one row per line."""
    out, docs = work_folder(spark, "csv"), load(spark, d, "documents")
    odd = docs.withColumn("text", F.concat(F.lit(" \\n\\\\"), "text", F.lit('\r\n"\\r" ')))
    B.write_tables({"documents": odd}, out, "csv")
    return B.read_tables(spark, out, "csv", {"documents": odd.schema})["documents"]


def csv_conversations(spark, d):
    out, turns = work_folder(spark, "csv"), load(spark, d, "conversations")
    B.write_tables({"conversations": turns}, out, "csv")
    return B.read_tables(spark, out, "csv", {"conversations": turns.schema})["conversations"]


CSV_DOCS_SQL = r"""SELECT doc_id, ' \n\\' || text || chr(13) || chr(10) || '"\r" ' AS text, lang, source, n_chars FROM documents"""


def parquet_round_trip(spark, d):
    out = work_folder(spark, "parquet")
    B.write_tables({"events": load(spark, d, "events")}, out, "parquet")
    return B.read_tables(spark, out, "parquet")["events"].groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def size_budgets(spark, d):
    """Upload sizes per source against a 50 MB budget; a document is a file of many kilobytes."""
    docs = load(spark, d, "documents")
    status = F.when(R.u(1, "status", "doc_id") < 0.1, F.lit(" Failed ")).otherwise(F.lit("ok"))
    files = docs.select("source", status.alias("status"), (F.col("n_chars") * 1000).alias("size_bytes"))
    return L.size_budget(files, ["source"])


SIZE_SQL = f"""WITH f AS (SELECT source, coalesce(sum(n_chars * 1000) FILTER (WHERE {sql_u(1, 'status', 'doc_id')} >= 0.1), 0)::BIGINT AS t FROM documents GROUP BY source)
SELECT source, t AS total_bytes, CASE WHEN t <= 0 THEN '0 B' WHEN t < 1024 THEN format('{{}} B', t) WHEN t < 1048576 THEN printf('%.2f KB', t / 1024.0::DOUBLE) WHEN t < 1073741824 THEN printf('%.2f MB', t / 1048576.0::DOUBLE)
 ELSE printf('%.2f GB', t / 1073741824.0::DOUBLE) END AS size_text, t <= 52428800 AS fits FROM f"""


def source_files(spark, d):
    """Bytes of the files behind the given tables."""
    return B.file_sizes(spark, [f"{d}/{n}.parquet" for n in ("orders", "customer", "lineitem")]).groupBy("name").agg(F.sum("size_bytes").alias("bytes"))


def user_counts(spark, d):
    cust = load(spark, d, "customer")
    return L.user_counters(cust.select(F.col("c_name").alias("username"), F.element_at(F.array(F.lit("super_admin"), F.lit("admin"), F.lit("user")), (R.below(1, "role", "c_custkey", 3) + 1).cast("int")).alias("role"), (F.col("c_acctbal") > 0).alias("is_active")))


USERS_SQL = f"""WITH u AS (SELECT {sql_below(1, 'role', 'c_custkey', 3)} AS r, c_acctbal > 0 AS a FROM customer)
SELECT count(*) AS total_users, count_if(a) AS active_users, count_if(r < 2) AS admin_users, count_if(r = 0) AS super_admin_users, count_if(r < 2 AND a) AS active_admins, count_if(r = 0 AND a) AS active_super_admins FROM u"""


def lenient_values(spark, d):
    """Numbers, dates and JSON objects found in conversation text, nothing raises."""
    c = load(spark, d, "conversations")
    n = F.when(F.col("role") == "user", F.concat(F.lit(" "), F.length("text").cast("string"), F.lit(".5 "))).when(F.col("role") == "system", F.lit(" NaN ")).otherwise(F.col("text"))
    return c.select(
        "conv_id", "turn", X.lenient_double(n).alias("number"), X.date_text(F.concat(F.lit(" 2024-01-"), F.lpad("turn", 2, "0"), F.lit("T10:00"))).alias("day"),
        X.date_text("role").alias("other"), J.json_object(F.concat(F.lit("Sure: "), F.lit('{"turn": '), "turn", F.lit("}"), F.lit(" end"))).alias("found"),
        J.json_object("text").alias("none"), X.clamp(F.col("turn") / 4.0, 0.25, 1.0).alias("clamped"),
    )


LENIENT_SQL = """SELECT conv_id, turn, CASE role WHEN 'user' THEN length(text) + 0.5::DOUBLE END AS number, '2024-01-' || lpad(CAST(turn AS VARCHAR), 2, '0') AS day,
role AS other, '{"turn": ' || turn || '}' AS found, CAST(NULL AS VARCHAR) AS none, least(greatest(turn / 4.0::DOUBLE, 0.25), 1.0) AS clamped FROM conversations"""

QUERIES = {
    "activity_recent": activity_recent, "activity_of_user": activity_of_user, "activity_newest_per_user": activity_newest_per_user, "user_search": user_search,
    "activity_tokens": activity_tokens, "activity_rollup": activity_rollup, "activity_lines": activity_lines, "timezone_display": timezone_display,
    "format_dates": format_dates, "preview": preview, "finite_values": finite_values, "csv_round_trip": csv_round_trip, "csv_sniffed": csv_sniffed,
    "csv_documents": csv_documents, "csv_conversations": csv_conversations, "parquet_round_trip": parquet_round_trip, "size_budgets": size_budgets, "source_files": source_files, "user_counts": user_counts, "lenient_values": lenient_values,
}

ORACLES = {
    "activity_recent": f"WITH {LOG_SQL} SELECT {', '.join(_SHOWN)} FROM log ORDER BY created_at DESC, log_id DESC LIMIT 100",
    "activity_of_user": f"WITH {LOG_SQL} SELECT {', '.join(_SHOWN)} FROM log WHERE lower(username) = 'user7' ORDER BY created_at DESC, log_id DESC LIMIT 500",
    "activity_newest_per_user": f"WITH {LOG_SQL} SELECT * FROM (SELECT log_id, username, row_number() OVER (PARTITION BY username ORDER BY created_at DESC, log_id DESC) AS rank FROM log) WHERE rank <= 5",
    "user_search": f"WITH {LOG_SQL} SELECT username, count(*) AS events FROM log WHERE contains(lower(username), 'ser1') GROUP BY 1",
    "activity_tokens": TOKENS_SQL, "activity_rollup": ROLLUP_SQL, "activity_lines": LINES_SQL, "timezone_display": TIMEZONE_SQL, "format_dates": FORMAT_SQL,
    "preview": PREVIEW_SQL, "finite_values": FINITE_SQL, "csv_round_trip": ROUND_SQL, "csv_sniffed": SNIFF_SQL,
    "csv_documents": CSV_DOCS_SQL, "csv_conversations": "SELECT * FROM conversations", "parquet_round_trip": "SELECT event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY 1", "size_budgets": SIZE_SQL, "user_counts": USERS_SQL, "lenient_values": LENIENT_SQL,
}
