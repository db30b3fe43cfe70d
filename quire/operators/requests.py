"""Requests as rows: domain checks, dispatch, output rows, tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.workers import reach

# Compression presets, and the quality that images are written with.
PRESETS = [("low", 1, False), ("medium", 2, True), ("high", 3, True), ("extreme", 4, True)]
IMAGE_QUALITY = {"low": 40, "medium": 60, "high": 40, "extreme": 25}
DEFAULT_LEVEL, DEFAULT_QUALITY = "medium", 60
# Where an office program may be found, after what the settings name.
OFFICE_PROGRAMS = ["soffice", "libreoffice"]
# What each setting of a request may be.
DOMAINS = {
    "level": ["low", "medium", "high", "extreme"], "mode": ["ranges", "every_n", "pages"], "angle": ["90", "180", "270"],
    "output_format": ["txt", "pdf", "docx"], "image_format": ["jpg", "png", "webp", "tiff"],
}
RANGES = {"dpi": (72, 300), "quality": (10, 100), "every_n": (1, 10_000), "n_files": (2, 20), "n_images": (0, 50)}
# Fixed value: what stands before a date.
DATE = "תאריך: "
METADATA = ["title", "author", "subject", "creator", "producer", "creation_date"]


def check_settings(requests: DataFrame) -> DataFrame:
    """requests (id, setting, value as text) with status: 400 where a value isn't one of its setting's, 422 where a
    number is out of its range or none, 404 for an unknown setting, else 200."""
    value, number = F.col("value"), F.col("value").try_cast("bigint")
    status = F.lit(404)
    for name, (low, high) in RANGES.items():
        status = F.when(F.col("setting") == name, F.when(F.coalesce(number.between(low, high), F.lit(False)), 200).otherwise(422)).otherwise(status)
    for name, allowed in DOMAINS.items():
        status = F.when(F.col("setting") == name, F.when(F.coalesce(value.isin(allowed), F.lit(False)), 200).otherwise(400)).otherwise(status)
    return requests.select("id", "setting", "value", status.alias("status"))


def compression_plan(requests: DataFrame) -> DataFrame:
    """requests (id, level) with the preset and image quality of the level; an unknown level is the default one."""
    spark = requests.sparkSession
    dim = spark.createDataFrame([(n, g, lin, IMAGE_QUALITY.get(n, DEFAULT_QUALITY)) for n, g, lin in PRESETS], "_level string, garbage int, linear boolean, quality int")
    known = F.when(F.col("level").isin([n for n, _, _ in PRESETS]), F.col("level")).otherwise(DEFAULT_LEVEL)
    return requests.withColumn("_level", known).join(F.broadcast(dim), "_level").select("id", "level", F.lit(True).alias("deflate"), F.lit(True).alias("clean"), "garbage", "linear", "quality")


def first_existing(candidates: DataFrame) -> DataFrame:
    """candidates (id, ordinal, path, found) as id, path: the first that is there, null where none is."""
    return candidates.groupBy("id").agg(F.min_by(F.when(F.col("found"), F.col("path")), F.when(F.col("found"), F.col("ordinal"))).alias("path"))


def look_up(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (file_id) with the registry's row; status 404 where there is none."""
    rows = wanted.join(registry.select("file_id", "original_name", "size"), "file_id", "left")
    return rows.withColumn("status", F.when(F.col("size").isNull(), 404).otherwise(200))


def languages(installed: DataFrame, fallback: list[str]) -> DataFrame:
    """Recogniser languages without the orientation model; the fallback where none is installed."""
    rows = installed.where("code <> 'osd'").select("code")
    spare = installed.sparkSession.createDataFrame([(c,) for c in fallback], "code string")
    some = installed.agg(F.count_if(F.col("code") != "osd").alias("_n"))
    return rows.unionByName(spare.crossJoin(F.broadcast(some)).where("_n = 0").select("code"))


def iso_z(ts: Column) -> Column:
    """ISO text with Z; a fraction, of six digits, only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def date_line(day: Column) -> Column:
    return F.concat(F.lit(DATE), F.date_format(day, "dd/MM/yyyy"))


def order_id(uuid: Column) -> Column:
    return F.upper(F.substring(uuid, 1, 12))


def temp_name(prefix: str, uuid: Column, suffix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.regexp_replace(uuid, "-", ""), 1, 8), F.lit(suffix))


def metadata(documents: DataFrame) -> DataFrame:
    """doc_id and the known metadata fields of documents (doc_id, meta: map), empty where missing."""
    return documents.select("doc_id", *[F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit("")).alias(k) for k in METADATA])


def _sign(body: bytes, secret: str) -> bytes:
    return base64.urlsafe_b64encode(hmac.new(secret.encode(), body, hashlib.sha256).digest()).rstrip(b"=")


def token(subject: str, issued: int, expires: int, secret: str) -> str:
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).rstrip(b"=")
    body = part({"alg": "HS256", "typ": "JWT"}) + b"." + part({"sub": subject, "exp": expires, "iat": issued})
    return (body + b"." + _sign(body, secret)).decode()


def subject(text: str | None, now: int, secret: str) -> str | None:
    """The subject of a token that is signed with the secret and hasn't expired, else None."""
    try:
        body, _, signature = text.encode().rpartition(b".")
        head, claims = (json.loads(base64.urlsafe_b64decode(x + b"=" * (-len(x) % 4))) for x in body.split(b"."))
        fine = head["alg"] == "HS256" and hmac.compare_digest(signature, _sign(body, secret)) and claims["exp"] > now
        return (claims.get("sub") or None) if fine else None
    except (ValueError, KeyError, AttributeError, TypeError):
        return None


def verify_tokens(tokens: DataFrame, secret: str, now: int) -> DataFrame:
    """tokens (id, token) with the subject, null for a token that doesn't hold. In SQL the signature would be two sha2()
    over the padded key, but then the key would stand in the plan's text, which goes to logs; so it goes to workers within
    an Arrow-batched function."""
    reach(tokens.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "subject": [subject(t, now, secret) for t in b["token"]]})

    return tokens.select("id", "token").mapInPandas(run, "id long, subject string")
