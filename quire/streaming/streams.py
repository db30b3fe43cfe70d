"""The engine's behaviour over time as Structured Streaming queries.

Each function builds the streaming plan and runs it to the end of the files at hand (Trigger.AvailableNow) into the
shared folder, so that its rows can be compared with a batch query; a service would start the same plan with a
processing-time trigger. All state is bounded by a watermark of LATE: what comes later than that, after a micro-batch
with newer events, is left out. Days and hours go by UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import tables
from quire.workers import shared_dir

CLEANUP_SECONDS = 300
#: How late an event may come; state older than that is dropped.
LATE = "1 day"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may name a file as well as a folder


def run(stream: DataFrame, key: list[str], mode: str = "append", merge=None) -> DataFrame:
    """Runs a stream to its end. Each micro-batch is written under its number, so one that is repeated after a failure
    replaces itself; the result is the last row of each key, or all rows in append mode; none where there is no input."""
    spark, out = stream.sparkSession, shared_dir(stream.sparkSession)
    schema = stream.withColumn("_batch", F.lit(0)).schema
    spark.createDataFrame([], schema).write.parquet(f"{out}/rows/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{out}/rows/*")
    if mode == "append":
        return rows.drop("_batch")
    value = [c for c in rows.columns if c not in (*key, "_batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*value), "_batch").alias("v")).select(*key, "v.*")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.usage_events(source(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, n: the usage counter as updates of windowed state."""
    days = _events(spark, sf_dir).withWatermark("ts", LATE).groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return run(days.select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n"), ["user_id", "day"], "update")


def hourly_rate(spark: SparkSession, sf_dir: str, per_hour: int) -> DataFrame:
    """user_id, endpoint, hour, n and denied: clock-aligned windows whose state ends with the watermark."""
    windows = _events(spark, sf_dir).withWatermark("ts", LATE).groupBy("user_id", "endpoint", F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    rows = windows.select("user_id", "endpoint", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", F.greatest(F.col("n") - per_hour, F.lit(0)).cast("long").alias("denied"))
    return run(rows, ["user_id", "endpoint", "hour"], "update")


def expiry(spark: SparkSession, sf_dir: str, now: str) -> DataFrame:
    """file_id and expires_at of registry rows whose time is over at `now`, as the cleanup would remove them."""
    registry = tables.stored_files(source(spark, sf_dir, "documents"))
    return run(registry.where(F.col("expires_at") < F.lit(now).cast("timestamp_ntz")).select("file_id", "expires_at"), ["file_id"])


def first_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, activations: repeated gateway notices of an order activate it once."""
    events = tables.order_events(source(spark, sf_dir, "orders")).where("event = 'notify_ok'").withColumn("at", F.col("at").cast("timestamp"))
    once = events.select(F.concat(F.lit("o"), F.col("order_id").cast("string")).alias("order_id"), "at").withWatermark("at", LATE).dropDuplicatesWithinWatermark(["order_id"])
    return run(once.select("order_id", F.lit(1).cast("long").alias("activations")), ["order_id"])
