"""Accounts: registration, look-up, quotas, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text

# Conversions a day by plan; other plans have the first.
DAILY_LIMITS = {"free": 5, "pro": 1000, "enterprise": 999999}
PUBLIC = ["id", "email", "full_name", "plan", "is_active"]


def daily_limit(plan):
    other = DAILY_LIMITS["free"]
    case = F.lit(other)
    for name, limit in DAILY_LIMITS.items():
        case = F.when(plan == name, limit).otherwise(case)
    return F.coalesce(case, F.lit(other)).cast("long")


def register(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (seq, email, full_name) that make an account: the first of each normalised email that no user has."""
    asked = requests.withColumn("email", text.normal_email(F.col("email")))
    first = asked.groupBy("email").agg(F.min_by(F.struct("seq", "full_name"), "seq").alias("r"))
    known = users.select(text.normal_email(F.col("email")).alias("email"))
    return first.join(known, "email", "left_anti").select("r.seq", "email", "r.full_name", F.lit("free").alias("plan"), F.lit(True).alias("is_active"))


def login(users: DataFrame, attempts: DataFrame) -> DataFrame:
    """attempts (attempt_id, email) with the user's id and status: ok, unknown or inactive."""
    asked = attempts.withColumn("email", text.normal_email(F.col("email")))
    rows = asked.join(users.select("email", "id", "is_active"), "email", "left")
    status = F.when(F.col("id").isNull(), "unknown").when(~F.col("is_active"), "inactive").otherwise("ok")
    return rows.select("attempt_id", "email", "id", status.alias("status"))


def daily_usage(events: DataFrame) -> DataFrame:
    """user_id, day (text), n."""
    return events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def profiles(users: DataFrame, usage: DataFrame, day: str) -> DataFrame:
    """Public columns of each user with the conversions of a day, 0 where there is none."""
    today = usage.where(F.col("day") == day).select(F.col("user_id").alias("id"), "n")
    return users.select(*PUBLIC).join(today, "id", "left").select(*PUBLIC, F.coalesce("n", F.lit(0)).cast("long").alias("conversions_today"))


def check_quota(events: DataFrame, limit) -> DataFrame:
    """Each event with allowed and count_after: an event is allowed while fewer than the limit have been that day, and
    a denied one doesn't count. limit: a column or number."""
    limit = limit if not isinstance(limit, int) else F.lit(limit)
    day = F.date_format("ts", "yyyy-MM-dd")
    n = F.row_number().over(Window.partitionBy("user_id", day).orderBy("ts", "event_id"))
    rows = events.withColumn("_n", n.cast("long")).withColumn("_limit", limit.cast("long"))
    return rows.withColumn("allowed", F.col("_n") <= F.col("_limit")).withColumn("count_after", F.least("_n", "_limit")).drop("_n", "_limit")


def check_rate(events: DataFrame, per_hour: int) -> DataFrame:
    """Each event with allowed: the first per_hour of a user, endpoint and clock hour."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = events.withColumn("hour", hour)
    n = F.row_number().over(Window.partitionBy("user_id", "endpoint", "hour").orderBy("ts", "event_id"))
    return rows.withColumn("allowed", n <= per_hour)


def upgrade(users: DataFrame, plans: DataFrame) -> DataFrame:
    """users with the plan that `plans` (id, plan) gives them, else their own."""
    return users.join(plans.withColumnRenamed("plan", "_new"), "id", "left").withColumn("plan", F.coalesce("_new", "plan")).drop("_new")
