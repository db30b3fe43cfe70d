"""Orders and subscriptions as folds over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text

# What plans cost a month, in whole shekels; the gateway's number of that currency.
PLANS = {"pro": 39, "enterprise": 129}
CURRENCY = 1
PERIOD_DAYS = 30


def price(plan):
    case = F.lit(None).cast("int")
    for name, amount in PLANS.items():
        case = F.when(plan == name, amount).otherwise(case)
    return case


def order_states(events: DataFrame) -> DataFrame:
    """order_id, status, activations of each order's events (order_id, seq, event): create, success, notify_ok,
    notify_bad, fail. success completes and activates each time, notify_ok only if the order isn't completed then, fail
    makes it failed whatever it was."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"])
    first = F.struct(F.lit("none").alias("status"), F.lit(0).cast("long").alias("n"))

    def step(state, event):
        done = (event == "success") | ((event == "notify_ok") & (state["status"] != "completed"))
        status = F.when(event == "create", "pending").when(event.isin("success", "notify_ok"), "completed").when(event == "fail", "failed").otherwise(state["status"])
        return F.struct(status.alias("status"), (state["n"] + F.when(done, 1).otherwise(0)).alias("n"))

    rows = events.groupBy("order_id").agg(F.aggregate(ordered, first, step).alias("s"))
    return rows.select("order_id", "s.status", F.col("s.n").alias("activations"))


def activate(subscriptions: DataFrame, paid: DataFrame, now) -> DataFrame:
    """Subscriptions after the orders in `paid` (user_id, plan, amount, order_id; the last order of a user counts): new
    plan, next charge a period from now, not cancelled; the others as they were."""
    last = paid.groupBy("user_id").agg(F.max_by(F.struct("plan", "amount"), "order_id").alias("o"))
    rows = subscriptions.join(last, "user_id", "full")
    new = F.col("o").isNotNull()
    until = now + F.expr(f"interval {PERIOD_DAYS} days")
    return rows.select("user_id", F.coalesce("o.plan", "plan").alias("plan"), F.coalesce("o.amount", "amount").alias("amount"), F.when(new, until).otherwise(F.col("next_charge")).alias("next_charge"), F.when(new, False).otherwise(F.col("cancelled")).alias("cancelled"))


def renewals_due(subscriptions: DataFrame, today, fixed: bool = False) -> DataFrame:
    """Subscriptions of a known plan with a token whose charge is due. Cancelled ones are due too, unless fixed."""
    rows = subscriptions.where((F.to_date("next_charge") <= today) & price(F.col("plan")).isNotNull() & (F.coalesce("token", F.lit("")) != ""))
    rows = rows.where(~F.col("cancelled")) if fixed else rows
    order = F.concat(F.lit("REN-"), F.substring(F.col("user_id").cast("string"), 1, 8), F.lit("-"), F.date_format(today, "yyyy-MM-dd"))
    return rows.select("user_id", "plan", price(F.col("plan")).alias("amount"), order.alias("order_id"), "cancelled")


def renew(subscriptions: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """Subscriptions after charging: outcomes (user_id, ok); a failed charge changes nothing and is due again."""
    rows = subscriptions.join(outcomes, "user_id", "left")
    return rows.withColumn("next_charge", F.when(F.col("ok"), now + F.expr(f"interval {PERIOD_DAYS} days")).otherwise(F.col("next_charge")))


def charge_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if("ok").alias("charged"), F.count_if(~F.col("ok")).alias("failed"))


def cancel(subscriptions: DataFrame, requests: DataFrame, now) -> DataFrame:
    """Subscriptions with those of `requests` (user_id) cancelled; their plan stays."""
    rows = subscriptions.join(requests.select("user_id", F.lit(True).alias("_asked")).distinct(), "user_id", "left")
    asked = F.coalesce("_asked", F.lit(False))
    return rows.withColumn("cancelled", asked | F.col("cancelled")).withColumn("cancel_date", F.when(asked, now)).drop("_asked")


def status(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """user id with plan and active; without a subscription the plan is free and not active."""
    rows = users.select("id").join(subscriptions.select(F.col("user_id").alias("id"), "plan", "cancelled"), "id", "left")
    return rows.select("id", F.coalesce("plan", F.lit("free")).alias("plan"), F.coalesce(~F.col("cancelled"), F.lit(False)).alias("active"))


def checkout_url(orders: DataFrame, base: str, site: str) -> DataFrame:
    """order_id and the address of the gateway's payment page; parameters in the order that the gateway signs them."""
    oid = F.col("order_id").cast("string")
    name = F.concat(F.lit("Plan "), F.col("plan"))
    fields = [
        ("sum", F.col("amount").cast("string")), ("currency", F.lit(str(CURRENCY))), ("cred_type", F.lit("1")), ("description", name), ("tranmode", F.lit("AK")), ("txId", oid), ("pdesc", name),
        ("success_url", F.concat(F.lit(f"{site}/api/payments/success?order_id="), oid)), ("fail_url", F.concat(F.lit(f"{site}/api/payments/fail?order_id="), oid)),
        ("notify_url", F.lit(f"{site}/api/payments/notify")), ("store_card", F.lit("1")),
    ]
    return orders.select("order_id", F.concat(F.lit(base + "?"), text.query_string(fields)).alias("url"))


def gateway_results(replies: DataFrame) -> DataFrame:
    """replies (id, body) with the reply's fields and ok: the response code is 000."""
    rows = replies.withColumn("_f", text.gateway_reply(F.col("body")))
    get = lambda key: F.filter("_f", lambda x: x["k"] == key)
    first = lambda key: F.get(get(key), F.lit(0))["v"]
    return rows.select("id", first("Response").alias("response"), F.coalesce(first("Num"), F.lit("")).alias("num"), F.coalesce(first("Response") == "000", F.lit(False)).alias("ok"))


def success_redirects(calls: DataFrame) -> DataFrame:
    """calls (id, query) of the success page with what the gateway put into its address: token (or TranzilaTK),
    auth_number (Num, or authNr) and transaction_id (index); the first of the names that is there counts, even if its
    value is empty, and without any the value is empty."""
    rows = calls.withColumn("_f", text.query_fields(F.coalesce("query", F.lit(""))))
    first = lambda *keys: F.coalesce(*[F.try_element_at("_f", F.lit(k)) for k in keys], F.lit(""))
    return rows.select("id", first("token", "TranzilaTK").alias("token"), first("Num", "authNr").alias("auth_number"), first("index").alias("transaction_id"))


def webhook_orders(calls: DataFrame) -> DataFrame:
    """calls (id, body) with the form's order number, response, token and transaction."""
    f = lambda k: F.try_element_at("_f", F.lit(k))
    rows = calls.withColumn("_f", text.form_fields(F.col("body")))
    return rows.select("id", f("txId").alias("order_id"), f("Response").alias("response"), F.coalesce(f("token"), f("TranzilaTK")).alias("token"), f("Num").alias("num"))
