"""Sources: the driver's tables and, derived from them, the logical relations of the document engine.

The derivations are fixture plumbing: they give each relation deterministic rows from the tables at hand. On real data
the relations come from the readers beside them (files(), and the codec readers of sources.codecs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_CHARS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Files below a path: path, modificationTime, length, and content only where asked for, so that checks of size and
    sums of sizes never load bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found if with_content else found.drop("content")


def doc_pages(documents: DataFrame) -> DataFrame:
    """doc_id, page (from 1), text: each document's text in slices of PAGE_CHARS code points, one at least."""
    starts = F.expr(f"sequence(0, (greatest(length(text), 1) - 1) div {PAGE_CHARS})")
    cut = F.transform(starts, lambda i: F.substring("text", i.cast("int") * PAGE_CHARS + 1, F.lit(PAGE_CHARS)))
    return documents.select("doc_id", F.posexplode(cut).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("long").alias("page"), "text")


def doc_sizes(documents: DataFrame) -> DataFrame:
    """doc_id and n_pages, without making the pages."""
    return documents.select("doc_id", F.expr(f"cast((greatest(length(text), 1) - 1) div {PAGE_CHARS} + 1 as bigint)").alias("n_pages"))


def stored_files(documents: DataFrame) -> DataFrame:
    """A file registry row for each document: file_id, original_name, suffix, size, created_at, expires_at."""
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 7)")
    suffix = F.expr("element_at(array('.pdf', '.docx', '.png', '.txt'), cast(doc_id % 4 as int) + 1)")
    rows = documents.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit(" (v1)"), suffix).alias("original_name"), suffix.alias("suffix"), F.octet_length("text").cast("long").alias("size"), created.alias("created_at"))
    return rows.withColumn("expires_at", F.expr("created_at + interval 3600 seconds"))


def users(customer: DataFrame) -> DataFrame:
    """id, email, full_name, plan, is_active."""
    plan = F.expr("case c_mktsegment when 'BUILDING' then 'pro' when 'MACHINERY' then 'enterprise' else 'free' end")
    return customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.test")).alias("email"), F.col("c_name").alias("full_name"), plan.alias("plan"), (F.col("c_acctbal") >= 0).alias("is_active"))


def usage_events(events: DataFrame) -> DataFrame:
    """event_id, user_id, ts, endpoint."""
    return events.select("event_id", "user_id", "ts", F.col("event_type").alias("endpoint"))


def payment_orders(orders: DataFrame) -> DataFrame:
    """order_id, user_id, plan, amount, status, created_at."""
    plan = F.expr("case when o_orderkey % 3 = 0 then 'enterprise' else 'pro' end")
    status = F.expr("case o_orderstatus when 'F' then 'failed' when 'O' then 'completed' else 'pending' end")
    return orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), plan.alias("plan"), F.expr("case when o_orderkey % 3 = 0 then 129 else 39 end").alias("amount"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def order_events(orders: DataFrame) -> DataFrame:
    """order_id, seq, event, at: create, then what gateway and browser report, made from the key, all on the order's day."""
    kinds = F.expr("""case when o_orderkey % 5 = 0 then array('create', 'notify_ok', 'notify_ok', 'success')
        when o_orderkey % 5 = 1 then array('create', 'fail') when o_orderkey % 5 = 2 then array('create', 'notify_bad', 'success')
        when o_orderkey % 5 = 3 then array('create', 'notify_ok', 'fail') else array('create') end""")
    return orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("at"), F.posexplode(kinds).alias("seq", "event")).select("order_id", F.col("seq").cast("long").alias("seq"), "event", "at")


def subscriptions(orders: DataFrame) -> DataFrame:
    """user_id, plan, amount, next_charge, token, cancelled: of each user's latest completed order."""
    done = payment_orders(orders).where("status = 'completed'")
    last = done.groupBy("user_id").agg(F.max(F.struct("created_at", "order_id", "plan", "amount")).alias("o"))
    return last.select("user_id", "o.plan", "o.amount", F.expr("o.created_at + interval 30 days").alias("next_charge"), F.expr("case when user_id % 7 = 0 then '' else concat('tok', cast(user_id as string)) end").alias("token"), F.expr("user_id % 11 = 0").alias("cancelled"))


def words(pages: DataFrame) -> DataFrame:
    """doc_id, page, words and conf (parallel arrays) as a recogniser gives them for a page; confidences from -1 to 100."""
    split = F.split("text", " ")
    conf = F.transform(split, lambda _, i: F.pmod(F.col("doc_id") * 31 + F.col("page") * 13 + i * 17, F.lit(102)).cast("int") - 1)
    return pages.select("doc_id", "page", split.alias("words"), conf.alias("conf"))
