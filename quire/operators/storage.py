"""Uploads, the file registry, expiry and space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text

# Accepted content types with their suffix, by group.
PDF = {"application/pdf": ".pdf"}
OFFICE = {
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.ms-powerpoint": ".ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
}
IMAGE = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/tiff": ".tiff", "image/bmp": ".bmp", "image/gif": ".gif"}
TEXT = {"text/plain": ".txt", "text/html": ".html"}
KNOWN = PDF | OFFICE | IMAGE | TEXT
# What an upload's error says, before and between its parts.
WRONG_TYPE, ALLOWED_TYPES = "סוג קובץ לא נתמך: ", ". נתמך: "
TOO_LARGE, AT_MOST = "הקובץ גדול מדי (", "MB). מקסימום: "
LIMIT_MB, PRO_LIMIT_MB = 100, 500
PRO = ("pro", "enterprise")
TTL_SECONDS = 3600


def is_pro(plan):
    return F.coalesce(plan.isin(*PRO), F.lit(False))


def _megabytes(length: Column) -> Column:
    """Length in megabytes to one place, a tie to the even one, in whole numbers."""
    tenths, rest = F.floor(length * 10 / 1048576), F.pmod(length * 10, F.lit(1048576))
    tenths = tenths + F.when((2 * rest > 1048576) | ((2 * rest == 1048576) & (F.pmod(tenths, F.lit(2)) == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def validate_uploads(uploads: DataFrame, allowed: list[str] | None = None, max_mb: int | None = None) -> DataFrame:
    """uploads (file_id, content_type, length, plan) with status 415 for a type that isn't allowed, else 413 above the
    limit (the plan's unless max_mb is given), else 200, and the error's detail, which names the allowed types in order.
    Lengths come from metadata; no content is read. No list or an empty one allows the KNOWN types; a null type is the
    empty one, which isn't known."""
    types = sorted(allowed or KNOWN)
    mime = F.coalesce("content_type", F.lit(""))
    mb = F.lit(max_mb) if max_mb else F.when(is_pro(F.col("plan")), PRO_LIMIT_MB).otherwise(LIMIT_MB)
    wrong, large = ~mime.isin(types), F.col("length") / 1048576 > mb
    detail = F.when(wrong, F.concat(F.lit(WRONG_TYPE), mime, F.lit(ALLOWED_TYPES + ", ".join(types)))).when(large, F.concat(F.lit(TOO_LARGE), _megabytes(F.col("length")), F.lit(AT_MOST), mb.cast("string"), F.lit("MB")))
    return uploads.select("file_id", "content_type", "length", F.when(wrong, 415).when(large, 413).otherwise(200).alias("status"), detail.alias("detail"))


def register(files: DataFrame) -> DataFrame:
    """Registry rows for files (file_id, original_name, size, created_at): suffix, expiry and download address."""
    suffix = F.coalesce(F.nullif(text.suffix(F.col("original_name")), F.lit("")), F.lit(".bin"))
    rows = files.withColumn("suffix", suffix).withColumn("expires_at", F.col("created_at") + F.expr(f"interval {TTL_SECONDS} seconds"))
    return rows.withColumn("download_url", F.concat(F.lit("/files/"), F.col("file_id").cast("string"), "suffix"))


def file_results(registry: DataFrame, now, started) -> DataFrame:
    """Result rows at the time `now`: their expiry counts from then, not from the registry's."""
    until = now + F.expr(f"interval {TTL_SECONDS} seconds")
    ms = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1000
    return registry.select("file_id", F.col("original_name").alias("filename"), "download_url", F.col("size").alias("size_bytes"), until.alias("expires_at"), ms.cast("int").alias("processing_time_ms"))


def expired(registry: DataFrame, now) -> DataFrame:
    """Rows whose time is over; one that ends just now is kept."""
    return registry.where(F.col("expires_at") < now)


def cleanup(registry: DataFrame, existing: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(what is left of the registry, counts): removed counts rows, deleted only those whose file was there."""
    gone = expired(registry, now).join(existing.select("file_id", F.lit(True).alias("_there")), "file_id", "left")
    return registry.where(F.col("expires_at") >= now), gone.agg(F.count("*").alias("removed"), F.count_if(F.coalesce("_there", F.lit(False))).alias("deleted"))


def disk_usage(files: DataFrame) -> DataFrame:
    """Sums of size by directory with a total row: directory, n_files, bytes."""
    return files.rollup("directory").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes")).select(F.coalesce("directory", F.lit("total")).alias("directory"), "n_files", "bytes")


def compression(sizes: DataFrame) -> DataFrame:
    """sizes (file_id, original, compressed) with saved_pct to one place, 0 for an empty original; may be negative."""
    share = F.when(F.col("original") == 0, F.lit(0.0)).otherwise(F.round((1 - F.col("compressed") / F.col("original")) * 100, 1))
    return sizes.withColumn("saved_pct", share)
