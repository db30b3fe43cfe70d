"""Packing along a space-filling curve: documents whose hashed vectors are alike become neighbours in the sequences.

Plan: one pass hashes each text's words into a vector of BUCKETS counts, projects it to DIMS coordinates and reads its
place on a Hilbert curve; one shuffle deals the texts out by ranges of that place; each range is sorted, encoded and
cut into sequences as it streams by, so nothing but the open sequence is held. Range ends come from the keys of about
BOUNDS_ROWS rows drawn at random, so that ranges have as much text: they move work between tasks, never rows in or out
of the result.
Equal places on the curve (copies) are parted by a hash of doc_id and text, so a large group of copies spreads over
ranges; only rows that are repeated with id and text stay together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, tokens
from .common import partitions, pieces, texts

LENGTH, END_ID = 2048, 1
BUCKETS, DIMS, BITS = 1024, 4, 12
BOUNDS_ROWS, SEED = 20_000, 17
#: Bytes of text that a document's other costs amount to.
OVERHEAD = 256
#: Low bits of the sort key, from a hash of doc_id and text.
TIE_BITS = 63 - DIMS * BITS

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def project(array: pa.Array) -> np.ndarray:
    """DIMS coordinates for each text in [0, 2**BITS): the text's vector of hashed word counts, divided by its number
    of words, times a fixed random matrix. Texts without words lie in the middle."""
    matrix = np.random.default_rng(7).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    words, at = hashing.words(array)
    out = np.zeros((len(array), DIMS))
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(matrix[(words >> np.uint64(40)) % np.uint64(BUCKETS)], at[full], axis=0)
    mean = out / np.maximum(np.diff(at), 1)[:, None]
    return np.minimum(((np.tanh(2 * mean) + 1) * 2 ** (BITS - 1)).astype(np.int64), 2**BITS - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer points (n, dims) on the Hilbert curve: Gray-code rotation of the axes from the top bit down,
    then the bits of all axes interleaved."""
    x = points.astype(np.int64).T.copy()
    dims, level = len(x), 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(dims):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _keys(ids: pa.Array, array: pa.Array) -> np.ndarray:
    data, at = hashing.buffers(array)
    digest = np.array([xxhash.xxh3_64_intdigest(data[a:z]) for a, z in zip(at.tolist(), at[1:].tolist())], np.uint64)
    tie = hashing.mix(np.array(ids.fill_null(0)).astype(np.int64).view(np.uint64) ^ digest) >> np.uint64(64 - TIE_BITS)
    return hilbert(project(array)) << TIE_BITS | tie.astype(np.int64)


def place(docs: DataFrame, bounds: np.ndarray | None) -> DataFrame:
    """doc_id, text, key and the range `part` that the key falls into; without bounds the key and size of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                key = _keys(b.column("doc_id"), b.column("text"))
                if bounds is None:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pc.binary_length(b.column("text")).cast(pa.int64())], ["key", "size"])
                else:
                    part = pa.array(np.searchsorted(bounds, key, side="right").astype(np.int32))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(key), part], ["doc_id", "text", "key", "part"])

    return docs.mapInArrow(run, "key long, size long" if bounds is None else "doc_id long, text string, key long, part int")


class Packer:
    """Cuts a stream of documents into sequences of `length` ids. The rest at the end becomes sequences whose lengths
    are powers of two, which need no padding either."""

    def __init__(self, first: int, length: int):
        self.next, self.length, self.used = first, length, 0
        self.open: list[tuple] = []

    def _close(self, items: list[tuple]) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, ids, total in items:
            rows.append((doc, start, len(ids), ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1
        return rows

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            cut = ids[start : start + self.length - self.used]
            self.open.append((doc, start, cut, len(ids)))
            self.used += len(cut)
            start += len(cut)
            if self.used == self.length:
                yield from self._close(self.open)
                self.open, self.used = [], 0

    def finish(self) -> Iterator[tuple]:
        rest, self.open = self.open, []
        while self.used:
            room = 1 << (self.used.bit_length() - 1)
            self.used -= room
            items = []
            while room:
                doc, start, ids, total = rest.pop(0)
                items.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            yield from self._close(items)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Packs all documents into sequences; one row per piece, with its `ids` (binary, little-endian unsigned 32-bit)
    where with_ids.

    doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens, sequence_id, offset. A null or
    empty text is its end id alone. A null doc_id is kept as null; rows with equal doc_id are packed each for itself.
    An empty table gives no rows. Other columns of docs are not looked at.
    """
    spark, path = docs.sparkSession, path or tokens.vocabulary("byte_bpe_50k.json")
    docs = texts(docs)
    n = partitions(docs)
    rows = docs.count()
    sample = sorted(tuple(r) for r in place(docs.where(F.rand(SEED) < min(1.0, BOUNDS_ROWS / max(rows, 1))), None).collect())
    keys, weight = np.array([k for k, _ in sample], np.int64), np.cumsum([size + OVERHEAD for _, size in sample])
    bounds = keys[np.searchsorted(weight, np.arange(1, n) * weight[-1] / n)] if len(keys) else keys
    schema = SCHEMA + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.ByteEncoder.shared(path)
        packer = Packer(TaskContext.get().partitionId() << 32, length)

        def rows(found: Iterator[tuple]) -> pa.RecordBatch:
            out = []
            for doc, start, size, ids, total, sequence, offset in found:
                raw = ids.tobytes()
                out.append((doc, start, size, zlib.crc32(raw), total, sequence, offset, raw)[: len(names)])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(names), kinds, strict=True)], names)

        end = np.array([end_id], "<u4")
        for batch in batches:
            for b in pieces(batch):
                encoded = encoder.encode(b.column("text").to_pylist())
                yield rows(x for doc, ids in zip(b.column("doc_id").to_pylist(), encoded, strict=True) for x in packer.add(doc, np.concatenate([ids, end])))
        yield rows(packer.finish())

    placed = place(docs, bounds).repartitionById(n, F.col("part")).sortWithinPartitions("key", "doc_id")
    return placed.select("doc_id", "text").mapInArrow(run, schema)
