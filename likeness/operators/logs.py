"""Activity logs, token usage, counters and size budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import action_label, json_details, other_details, token_count
from ..functions.text import byte_text, strip


def recent(logs: DataFrame, limit: int = 20, username: str | None = None) -> DataFrame:
    """The ``limit`` newest log rows, optionally of one user (any case)."""
    clean = (username or "").strip()
    if clean:
        logs = logs.where(F.lower("username") == clean.lower())
    return logs.orderBy(F.desc("created_at"), F.desc("log_id")).limit(max(1, int(limit)))


def recent_per_user(logs: DataFrame, limit: int = 5) -> DataFrame:
    """The newest rows of every user."""
    w = Window.partitionBy("username").orderBy(F.desc("created_at"), F.desc("log_id"))
    return logs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def search_users(logs: DataFrame, text: str) -> DataFrame:
    """Rows whose user name contains the text, any case; blank text keeps all."""
    t = text.strip().lower()
    return logs if not t else logs.where(F.contains(F.lower(F.coalesce("username", F.lit(""))), F.lit(t)))


def activity_rows(logs: DataFrame) -> DataFrame:
    """Display rows: readable action, token count and the other details."""
    return logs.select("log_id", action_label("action").alias("action"), token_count("details").alias("total_tokens"), other_details("details").alias("details"))


def with_usage(logs: DataFrame) -> DataFrame:
    """Adds prompt, completion and total token counts; the total falls back to the sum of the parts."""
    obj = json_details("details")
    p, c, t = [F.get_json_object(obj, f"$.{k}_tokens").try_cast("bigint") for k in ("prompt", "completion", "total")]
    parts = F.when(p.isNotNull() | c.isNotNull(), F.coalesce(p, F.lit(0)) + F.coalesce(c, F.lit(0)))
    return logs.withColumns({"prompt_tokens": p, "completion_tokens": c, "total_tokens": F.coalesce(t, parts)})


def token_rollup(logs: DataFrame, by: list[str]) -> DataFrame:
    """Events and token sums per group; the sum is null when no row of the group has usage."""
    return with_usage(logs).groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"),
    )


def user_counters(users: DataFrame) -> DataFrame:
    """Totals for a user table (username, role, is_active) in one pass."""
    admin = F.col("role").isin("super_admin", "admin")
    chief = F.col("role") == "super_admin"
    return users.agg(
        F.count(F.lit(1)).alias("total_users"), F.count_if("is_active").alias("active_users"),
        F.count_if(admin).alias("admin_users"), F.count_if(chief).alias("super_admin_users"),
        F.count_if(admin & F.col("is_active")).alias("active_admins"), F.count_if(chief & F.col("is_active")).alias("active_super_admins"),
    )


def size_budget(files: DataFrame, by: list[str], limit_mb: int = 50) -> DataFrame:
    """Bytes of the files that did not fail, as text, and whether they fit the budget."""
    good = F.lower(strip(F.coalesce("status", F.lit("")))) != "failed"
    total = F.coalesce(F.sum(F.when(good, F.col("size_bytes"))), F.lit(0))
    g = files.groupBy(*by).agg(total.alias("total_bytes"))
    return g.withColumn("size_text", byte_text("total_bytes")).withColumn("fits", F.col("total_bytes") <= limit_mb * 1024 * 1024)
