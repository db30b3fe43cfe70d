"""Protected files: content under a user's password, which an owner's password opens too, with a permission mask.

A protected file is a mark, the mask, the user's key under the owner's (a box of fixed size) and the content under the
user's key, by AES-256 in GCM mode; it isn't a PDF reader's format. Passwords are columns, never literals of a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "QUIRE-LOCKED-1"
#: Fixed value: what is added to a password where no owner's password is given.
OWNER = "_owner"
_AT = len(MARK)
#: Digits of the mask, and bytes of the box: a nonce, a key and a tag.
_MASK, _BOX = 8, 12 + 32 + 16


def _key(password: Column) -> Column:
    return F.unhex(F.sha2(password.cast("binary"), 256))


def protect(files: DataFrame) -> DataFrame:
    """files (id, content, password, owner_password: null or empty for the usual one, mask) as id, content."""
    password = F.col("password")
    owner = F.when(F.coalesce("owner_password", F.lit("")) == "", F.concat(password, F.lit(OWNER))).otherwise(F.col("owner_password"))
    mask = F.lpad(F.hex(F.col("mask")), _MASK, "0").cast("binary")
    box = F.aes_encrypt(_key(password), _key(owner), F.lit("GCM"))
    return files.select("id", F.concat(F.lit(MARK).cast("binary"), mask, box, F.aes_encrypt(F.col("content"), _key(password), F.lit("GCM"))).alias("content"))


def unlock(files: DataFrame) -> DataFrame:
    """files (id, content, password) as id, content, mask and error: content that isn't protected is passed on as it is,
    the user's and the owner's password open it, any other gives an error."""
    part = lambda start, n: F.substring(F.col("content"), start, n)
    locked = part(1, _AT) == F.lit(MARK).cast("binary")
    body = F.substr(F.col("content"), F.lit(_AT + _MASK + _BOX + 1))
    own = F.try_aes_decrypt(body, _key(F.col("password")), F.lit("GCM"))
    inner = F.try_aes_decrypt(part(_AT + _MASK + 1, _BOX), _key(F.col("password")), F.lit("GCM"))
    opened = F.coalesce(own, F.try_aes_decrypt(body, inner, F.lit("GCM")))
    mask = F.conv(part(_AT + 1, _MASK).cast("string"), 16, 10).cast("long")
    rows = files.select("id", locked.alias("_locked"), F.when(locked, opened).otherwise(F.col("content")).alias("content"), F.when(locked, mask).alias("mask"))
    return rows.select("id", "content", "mask", F.when(F.col("_locked") & F.col("content").isNull(), "Incorrect password").alias("error"))
