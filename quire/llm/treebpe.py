"""Byte-level BPE of long texts as a tree: halves are encoded side by side, then joined.

A text above LEAF bytes is halved until its parts fit, the parts of a batch are encoded by THREADS threads (the encoder
lets go of the interpreter while it works), and neighbours are joined upwards. A join takes a window of both sides around the cut, from token boundary to token boundary, encodes it
again and looks whether it agrees with both sides; if not, the window grows fourfold, at most to both sides whole. It
agrees on a side if

* it has the same tokens there up to a sure boundary - a single space between two visible ASCII characters, where the
  pre-tokenizer cuts in any context - or
* all of it, with a character on either side, is one run of ASCII letters, which is one pre-token, and its outermost
  token is the side's own. A sequence of tokens is the BPE encoding of its bytes if each two neighbours are the encoding
  of theirs, and then each such pair stands in an encoding already made.

So the joined ids are exactly those of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .common import pieces, texts

LEAF = 4096
WINDOW = 48
#: Threads that encode the leaves of a batch; a batch of fewer leaves for each than LEAVES isn't shared out.
THREADS, LEAVES = 2, 64

_LETTERS = re.compile(rb"[A-Za-z]+")


def _sure(data: bytes, p: int) -> bool:
    return 0 < p < len(data) - 1 and data[p] == 32 and 33 <= data[p - 1] <= 126 and 33 <= data[p + 1] <= 126


def _char(data: bytes, p: int) -> bool:
    """Whether a character begins at p."""
    return p >= len(data) or data[p] & 0xC0 != 0x80


class TreeEncoder:
    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, threads: int = THREADS):
        self.encoder = tokens.ByteEncoder.shared(path)
        self.bytes = self.encoder.merges.bytes
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.leaf, self.window, self.threads = leaf, window, threads
        special = self.encoder.merges.special
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def encode(self, texts_: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        leaves: list[str] = []
        plans = [self._plan(text, leaves) for text in texts_]
        done = self._leaves(leaves)
        return [self._build(plan, done) for plan in plans]

    def _leaves(self, leaves: list[str]) -> list[np.ndarray]:
        each = -(-len(leaves) // self.threads)
        if each < LEAVES:
            return self.encoder.encode(leaves)
        with ThreadPoolExecutor(self.threads) as pool:
            parts = pool.map(self.encoder.encode, [leaves[i : i + each] for i in range(0, len(leaves), each)])
            return [x for part in parts for x in part]

    def _plan(self, text: str, leaves: list[str]) -> list:
        """Parts of a text: leaves' numbers for short ones; for long ones the bytes and a tree of numbers. Special
        tokens in a text are ids of their own, which no part crosses."""
        if len(text) <= self.leaf // 4 or len(text.encode()) <= self.leaf:
            leaves.append(text)
            return [len(leaves) - 1]
        cuts = [0, *(x for m in self.special.finditer(text) for x in m.span()), len(text)] if self.special else [0, len(text)]
        plan: list = []
        for a, b in zip(cuts, cuts[1:]):
            data = text[a:b].encode()
            if data:
                plan.append((data, self._halve(data, 0, len(data), leaves)))
        return plan

    def _halve(self, data: bytes, low: int, high: int, leaves: list[str]):
        mid = (low + high) // 2
        while mid < high and not _char(data, mid):
            mid += 1
        if high - low <= self.leaf or mid == high:
            leaves.append(data[low:high].decode())
            return len(leaves) - 1
        return self._halve(data, low, mid, leaves), mid, self._halve(data, mid, high, leaves)

    def _build(self, plan: list, done: list[np.ndarray]) -> np.ndarray:
        if len(plan) == 1 and isinstance(plan[0], int):
            return done[plan[0]]
        out = [self._join(data, tree, 0, len(data), done) for data, tree in plan]
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def _join(self, data: bytes, tree, low: int, high: int, done: list[np.ndarray]) -> np.ndarray:
        if isinstance(tree, int):
            return done[tree]
        mid = tree[1]
        left, right = self._join(data, tree[0], low, mid, done), self._join(data, tree[2], mid, high, done)
        width = self.window
        while True:
            n, x = self._reach(data, left[::-1], mid, low, -1, width)
            m, y = self._reach(data, right, mid, high, 1, width)
            middle = self.encoder.encode([data[x:y].decode()])[0]
            p = self._left(data, left[len(left) - n :], middle, x, y, low)
            q = self._right(data, right[:m], middle, x, y, high)
            if p is not None and q is not None and p[1] <= q[1]:
                return np.concatenate([left[: len(left) - n + p[0]], middle[p[0] : len(middle) - q[0]], right[m - q[0] :]])
            if x == low and y == high:
                return middle
            width *= 4

    def _reach(self, data: bytes, ids: np.ndarray, mid: int, limit: int, way: int, width: int) -> tuple[int, int]:
        """How many tokens from the cut outwards make at least `width` bytes and end where a character begins, and
        where they end; all, if there are no more."""
        ends = mid + way * np.cumsum(self.sizes[ids[: width + 8]])
        for k in np.flatnonzero(np.abs(ends - mid) >= width):
            if _char(data, int(ends[k])):
                return int(k) + 1, int(ends[k])
        return len(ids), limit

    def _letters(self, data: bytes, x: int, y: int) -> bool:
        return _LETTERS.fullmatch(data, x - 1, min(y + 1, len(data))) is not None

    def _left(self, data: bytes, old: np.ndarray, new: np.ndarray, x: int, y: int, low: int) -> tuple[int, int] | None:
        """(tokens of the left side kept within the window, where they end) if the window agrees on the left."""
        if x == low:
            return 0, x
        k = min(len(old), len(new))
        differ = np.flatnonzero(old[:k] != new[:k])
        same = int(differ[0]) if len(differ) else k
        ends = x + np.cumsum(self.sizes[new[:same]])
        for i in range(same):
            if _sure(data, int(ends[i])):
                return i + 1, int(ends[i])
        return (0, x) if same and x > 0 and self._letters(data, x, y) else None

    def _right(self, data: bytes, old: np.ndarray, new: np.ndarray, x: int, y: int, high: int) -> tuple[int, int] | None:
        if y == high:
            return 0, y
        k = min(len(old), len(new))
        old, new = old[len(old) - k :][::-1], new[len(new) - k :][::-1]
        differ = np.flatnonzero(old != new)
        same = int(differ[0]) if len(differ) else k
        begins = y - np.cumsum(self.sizes[new[:same]])
        for i in range(same):
            if _sure(data, int(begins[i])):
                return i + 1, int(begins[i])
        return (0, y) if same and y < len(data) and x > 0 and self._letters(data, x, y) else None

    def decode(self, ids: np.ndarray) -> str:
        """tokenizer.decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """Encodes every text (null: empty) and decodes it again: doc_id, n_tokens, ids_sha256, decoded_sha256 and, where
    with_ids, ids (binary, little-endian unsigned 32-bit) and decoded. One row per row, repeated ones too; no rows for an
    empty table; other columns are not looked at."""
    path = path or tokens.vocabulary("byte_bpe_50k.json")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TreeEncoder(path, leaf)
        for batch in batches:
            for b in pieces(batch):
                ids = tree.encode(b.column("text").to_pylist())
                back = [tree.decode(x) for x in ids]
                raw = [x.tobytes() for x in ids]
                columns = [
                    b.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                    pa.array(raw, pa.binary()),
                    pa.array(back, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return texts(docs).mapInArrow(run, schema)
