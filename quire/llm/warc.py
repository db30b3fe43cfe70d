"""Fixity audit of WARC replicas with Merkle trees.

Records of a file stand one after the other, so each covers a range of offsets. A leaf is the hash of a record's bytes
and range; a node is the hash of FANOUT children in order and covers their joint range, up to one root for each file.
Two replicas are compared from the roots down: a level is only looked at below nodes of the level above that differ, so
for a few damaged records the comparison reads a few nodes of each level. Trees are built by DataFrame aggregation, one
level after another; a group has FANOUT rows at most.

A lost or added record moves all that come after it, and so changes their leaves. So the differing leaves of both sides
are matched once more by record, and their digests compared apart from the offsets: what has only moved is told as one
range for each distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT = 16
#: Records in a file of warc_records().
RECORDS_PER_FILE = 1024


def record(uri: Column, payload: Column, ident: Column) -> Column:
    """The bytes of a WARC resource record: version, headers, an empty line, the payload, two line ends. The date is
    fixed and the record id derives from the ident, so equal rows give equal records."""
    digest = F.sha2(ident.cast("string").cast("binary"), 256)
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def warc_records(pages: DataFrame) -> DataFrame:
    """page_id, file and data of each page's record; files hold about RECORDS_PER_FILE ids in a row. Rows with a null
    page_id have no place and are left out; null url and html count as empty."""
    rows = pages.where("page_id is not null")
    return rows.select(F.col("page_id").cast("long").alias("page_id"), F.floor(F.col("page_id") / RECORDS_PER_FILE).cast("long").alias("file"), record(F.col("url"), F.col("html"), F.col("page_id")).alias("data"))


def leaves(records: DataFrame) -> DataFrame:
    """file, pos (the record's number in its file), page_id, nth (of equal page_ids), low, high (its range of offsets), sha
    (of the record) and hash (of both), in the order of page_id, then of the record's hash for repeated ids."""
    small = records.select("file", "page_id", F.octet_length("data").cast("long").alias("_n"), F.sha2("data", 256).alias("_sha"))
    by_file = Window.partitionBy("file").orderBy("page_id", "_sha")
    rows = small.select("file", (F.row_number().over(by_file) - 1).cast("long").alias("pos"), "page_id", (F.row_number().over(by_file) - F.rank().over(Window.partitionBy("file").orderBy("page_id"))).cast("long").alias("nth"), F.sum("_n").over(by_file.rowsBetween(Window.unboundedPreceding, 0)).alias("high"), "_n", "_sha")
    rows = rows.withColumn("low", F.col("high") - F.col("_n"))
    return rows.select("file", "pos", "page_id", "nth", "low", "high", F.col("_sha").alias("sha"), F.sha2(F.concat_ws(":", F.lit("leaf"), "low", "high", "_sha").cast("binary"), 256).alias("hash"))


def tree(leaf: DataFrame, name: str, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves up to one root for each file, each written to the shared folder: file, pos, low, high,
    hash; the number of levels follows from the largest file."""
    level = stored(leaf.select("file", "pos", "page_id", "nth", "low", "high", "sha", "hash"), f"{name}-0")
    most = level.agg(F.max("pos")).first()[0]
    levels = [level]
    while most:
        most //= fanout
        child = F.struct("pos", "hash")
        up = levels[-1].groupBy("file", F.floor(F.col("pos") / fanout).cast("long").alias("up")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(child)).alias("children"))
        joined = F.concat_ws(":", F.lit("node"), "low", "high", F.array_join(F.transform("children", lambda c: c["hash"]), ":"))
        levels.append(stored(up.select("file", F.col("up").alias("pos"), "low", "high", F.sha2(joined.cast("binary"), 256).alias("hash")), f"{name}-{len(levels)}"))
    return levels


def audit(first: list[DataFrame], second: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Where two trees differ: file, pos, page_id, low, high of the first replica (of the second where only it has the
    record), hash and other_hash of the leaves, kind, records and shift.

    kind is corrupt (a record's bytes differ), missing (in the second), extra, or moved: a row for all records of a file
    that are whole but `shift` bytes further on in the second replica, from the first of them (pos, page_id, low) to the end
    of the last (high), `records` of them, without hashes. Records with one page_id in a file are matched in the order of
    their digests. Equal trees give no rows, as do two empty tables.
    """
    height = max(len(first), len(second))
    # a shorter tree has its roots again on each level above
    pad = lambda levels: levels + [levels[-1]] * (height - len(levels))
    first, second = pad(first), pad(second)
    suspects = None

    def below(level: DataFrame) -> DataFrame:
        """The nodes of a level that hang on suspects; all of the top level."""
        if suspects is None:
            return level
        return level.withColumn("_up", F.floor(F.col("pos") / fanout).cast("long")).join(suspects, ["file", "_up"], "left_semi").drop("_up")

    for depth in range(height - 1, 0, -1):
        a, b = below(first[depth]), below(second[depth])
        differ = a.select("file", "pos", "hash").join(b.select("file", "pos", F.col("hash").alias("other")), ["file", "pos"], "full").where(~F.col("hash").eqNullSafe(F.col("other")))
        suspects = stored(differ.select("file", F.col("pos").alias("_up")), f"suspects-{depth}")
        if suspects.isEmpty():
            break
    # leaves that differ where they stand, matched by record
    stands = ["file", "pos", "hash"]
    a, b = below(first[0]), below(second[0])
    a, b = a.join(b.select(*stands), stands, "left_anti"), b.join(a.select(*stands), stands, "left_anti")
    names = ["pos", "low", "high", "sha", "hash"]
    both = a.join(b.withColumnsRenamed({c: f"_{c}" for c in names}), ["file", "page_id", "nth"], "full")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    kind = F.when(F.col("hash").isNull(), "extra").when(F.col("_hash").isNull(), "missing").when(F.col("sha") != F.col("_sha"), "corrupt").otherwise("moved")
    both = stored(both.withColumn("kind", kind), "differing")
    found = both.where("kind <> 'moved'").select("file", F.coalesce("pos", "_pos").alias("pos"), "page_id", *[F.coalesce(c, f"_{c}").alias(c) for c in ("low", "high")], "hash", F.col("_hash").alias("other_hash"), "kind", one.alias("records"), none.alias("shift"))
    moved = both.where("kind = 'moved'").withColumn("shift", F.col("_low") - F.col("low")).groupBy("file", "shift")
    moved = moved.agg(F.min("pos").alias("pos"), F.min_by("page_id", "pos").alias("page_id"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("records"))
    empty = F.lit(None).cast("string")
    return found.unionByName(moved.withColumns({"hash": empty, "other_hash": empty, "kind": F.lit("moved")}))


def damaged(records: DataFrame, one_in: int = 97) -> DataFrame:
    """A replica for tests and the query: in one record of `one_in`, chosen by its page_id, one character of the payload
    is another, as a bad disk block would leave it."""
    hit = F.pmod(F.col("page_id"), F.lit(one_in)) == one_in // 2
    text = F.expr("concat(substring(data, 1, octet_length(data) - 5), cast('#' as binary), substring(data, octet_length(data) - 3, 4))")
    return records.withColumn("data", F.when(hit, text).otherwise(F.col("data")))
