"""Length-delimited binary record files with masked checksums, and an offset index beside them.

A file is a run of frames in ascending doc_id; a frame is

    length of the body, u64 | masked crc32 of those 8 bytes, u32 | body | masked crc32 of the body, u32 | line feed

little-endian, with body = doc_id i64 | bytes per id u8 | ids. A crc is masked by a rotation of 15 bits plus a constant,
so a checksum over bytes that hold checksums stays sound. The line feed ends a record for Spark's text writer, which
takes the frame's bytes as they are: files reach any store that Spark can write, under its commit protocol, and a lost
or repeated task leaves nothing behind. The reader goes by the lengths alone and checks the line feed too.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import known_bytes, partitions, passing_shuffles, pieces, texts

END_ID = 1
#: About how large a file gets; a reader holds one at a time.
FILE_BYTES = 64 << 20
#: Fixed value: the constant of the usual masked checksum.
MASK = 0xA282EAD8
_HEAD, _FOOT, _BODY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qB")


class CorruptRecord(ValueError):
    pass


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray) -> bytes:
    """The frame of one record, without the line feed."""
    wide = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    body = _BODY.pack(doc_id, wide) + ids.astype(f"<u{wide}").tobytes()
    head = struct.pack("<Q", len(body))
    return head + _FOOT.pack(masked(head)) + body + _FOOT.pack(masked(body))


def parse(data: bytes | memoryview, offset: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(doc_id, offset, frame length, ids) of each frame; raises CorruptRecord where a checksum or length is off."""
    data = memoryview(data)
    stop = len(data) if stop is None else stop
    while offset < stop:
        if offset + _HEAD.size > len(data):
            raise CorruptRecord(f"cut short at {offset}")
        size, check = _HEAD.unpack_from(data, offset)
        if masked(data[offset : offset + 8]) != check:
            raise CorruptRecord(f"length at {offset}")
        low = offset + _HEAD.size
        high = low + size
        if high + _FOOT.size + 1 > len(data):
            raise CorruptRecord(f"cut short at {offset}")
        if masked(data[low:high]) != _FOOT.unpack_from(data, high)[0] or data[high + _FOOT.size] != 10:
            raise CorruptRecord(f"body at {offset}")
        doc_id, wide = _BODY.unpack_from(data, low)
        end = high + _FOOT.size + 1
        yield doc_id, offset, end - offset, np.frombuffer(data[low + _BODY.size : high], f"<u{wide}")
        offset = end


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encodes every text (null: empty), appends end_id, and writes record files below out/records in ascending
    doc_id; then reads the files back, checks every frame, and writes what it found as the index out/index, in Parquet:
    shard, doc_id, offset, length, before (ids of the shard before the record), n_tokens, ids_crc32.

    Rows with equal doc_id give a record each, in the order of their texts. Rows with a null doc_id cannot be addressed
    and are not written. An empty table gives no files. A file has as many records as fill FILE_BYTES on average."""
    spark, path = docs.sparkSession, path or tokens.vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.WordEncoder.shared(path), np.array([end_id], "<u4")
        for batch in batches:
            for b in pieces(batch):
                encoded = encoder.encode(b.column("text").to_pylist())
                frames = [frame(doc, np.concatenate([ids, end])) for doc, ids in zip(b.column("doc_id").to_pylist(), encoded, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    dealt = texts(docs).where("doc_id is not null").repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    frames = dealt.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    known = known_bytes(docs)
    per_file = max(1, FILE_BYTES * docs.count() // known) if known else FILE_BYTES >> 10
    with passing_shuffles(spark):
        frames.write.option("maxRecordsPerFile", max(per_file, 1)).text(f"{out}/records")
    read(spark, out).write.parquet(f"{out}/index")


def files(spark: SparkSession, out: str) -> DataFrame:
    """The record files with their number in the order of doc_id: that of the task, then that of its file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/records")
    number = lambda group: F.regexp_extract("path", "/part-([0-9]+)-[^/]*-c([0-9]+)[^/]*$", group).cast("long")
    return found.select((number(1) * (1 << 20) + number(2)).alias("shard"), "content")


def read(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Every record of every file, checked: shard, doc_id, offset, length, before (ids of the shard before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and ids where with_ids."""
    schema = "shard long, doc_id long, offset long, length long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                rows, before = [], 0
                for doc, offset, size, ids in parse(content.as_buffer()):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((shard, doc, offset, size, before, len(ids), zlib.crc32(raw), raw)[: len(names)])
                    before += len(ids)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    return files(spark, out).mapInArrow(run, schema)


def fetch(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """A shuffled read: the records of the doc_ids in `wanted`, found through the index; only their frames are parsed.
    doc_id, ids (binary, little-endian unsigned 32-bit). An id that isn't there gives no row, one asked for twice gives
    its records once, one that has several records gives them all; null ids are not asked for."""
    at = spark.read.parquet(f"{out}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    by_shard = at.groupBy("shard").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column("content"), batch.column("offsets").to_pylist(), strict=True):
                rows = [next(parse(content.as_buffer(), x)) for x in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[3].astype("<u4").tobytes() for r in rows], pa.binary())], ["doc_id", "ids"])

    return files(spark, out).join(by_shard, "shard").select("content", "offsets").mapInArrow(run, "doc_id long, ids binary")


def numbered(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record as the files were read back into the index; start counts the
    ids of all records before it, over all shards, whose totals are a row each."""
    index = spark.read.parquet(f"{out}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("_ids"))
    base = totals.select("shard", (F.sum("_ids").over(Window.orderBy("shard")) - F.col("_ids")).alias("_base"))
    return index.join(base, "shard").select("doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
