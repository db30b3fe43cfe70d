"""Words of whole texts as 64-bit hashes, with numpy over the bytes of many texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A word of up to LANES * 8 bytes is read in
lanes of 8 bytes, and the hash is mixed between lanes, so that it has no linear structure; a longer word goes through
xxh3. No word but those becomes a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import CHUNK_BYTES

LANES = 4

_RNG = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The bytes of a lane that belong to a word of which so many are left.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LANE = _RNG.integers(0, 2**63, LANES + 1, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ORDER = _RNG.integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each value begins and the last ends."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    elif pa.types.is_string(array.type) or pa.types.is_binary(array.type):
        kind = np.int32
    else:
        array, kind = array.cast(pa.large_string()), np.int64
    _, at, data = array.buffers()
    at = np.frombuffer(at, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _runs(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; first: where texts begin, which no word crosses."""
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[first] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = first[first > 0] - 1
    after[ends] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _hash(folded: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes from begin, of these sizes; folded ends in 8 * LANES zeros."""
    lanes = np.ndarray(len(folded) - 7, "<u8", folded, strides=(1,))
    value = mix((lanes[begin] & _LEFT[np.minimum(size, 8)]) ^ _LANE[0])
    for i in range(1, LANES):
        more = np.flatnonzero(size > 8 * i)
        if not len(more):
            break
        left = np.minimum(size[more] - 8 * i, 8)
        value[more] = mix((value[more] + _LANE[i]) ^ (lanes[begin[more] + 8 * i] & _LEFT[left]))
    for k in np.flatnonzero(size > 8 * LANES).tolist():
        value[k] = xxhash.xxh3_64_intdigest(folded[begin[k] : begin[k] + size[k]])
    return mix(value ^ (size.astype(np.uint64) * _LANE[LANES]))


def _block(data: np.ndarray, first: np.ndarray, most: tuple[int | None, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    begin, end = _runs(data, first)
    folded = np.zeros(len(data) + 8 * LANES, np.uint8)
    folded[: len(data)] = _FOLD[data]
    size = end - begin
    return [_hash(folded, begin, size if n is None else np.minimum(size, n)) for n in most], begin


def beginnings(array: pa.Array, *most: int | None) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n of `most` hashes of the first n bytes (None: all) of all words in order, and for text i the range
    at[i]:at[i+1] of them. Besides the result, some 20 bytes for each of CHUNK_BYTES bytes; longer texts are cut at white
    space."""
    data, at = buffers(array)
    found: list[list[np.ndarray]] = []
    counts = np.zeros(len(array) + 1, np.int64)
    row = 0
    while row < len(array):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, side="right")) - 1)
        low, high = at[row], at[stop]
        if high - low > 2 * CHUNK_BYTES:  # one long text
            while low < high:
                cut = min(high, low + CHUNK_BYTES)
                while cut < high and not _SPACE[data[cut]]:
                    spaces = np.flatnonzero(_SPACE[data[cut : min(high, cut + CHUNK_BYTES)]])
                    cut = cut + int(spaces[0]) if len(spaces) else min(high, cut + CHUNK_BYTES)
                values, begin = _block(data[low:cut], np.zeros(1, np.int64), most)
                found.append(values)
                counts[row + 1] += len(begin)
                low = cut
        elif high > low:
            first = np.unique(at[row:stop][at[row + 1 : stop + 1] > at[row:stop]] - low)
            values, begin = _block(data[low:high], first, most)
            found.append(values)
            counts[row + 1 : stop + 1] = np.diff(np.searchsorted(begin, at[row : stop + 1] - low))
        row = stop
    return [np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in found)]) for i in range(len(most))], np.cumsum(counts)


def words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all whole words, as beginnings()."""
    (value,), at = beginnings(array, None)
    return value, at


def shingles(value: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and their ranges; a text with fewer words gives its whole sequence as one,
    a text without words none."""
    n = np.diff(at)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(to[-1], np.uint64)
    long = np.flatnonzero(n >= width)
    if len(long):
        start = np.repeat(at[long] - np.concatenate([[0], np.cumsum(many[long])])[:-1], many[long]) + np.arange(many[long].sum())
        acc = np.zeros(len(start), np.uint64)
        for j in range(width):
            acc += value[start + j] * _ORDER[j]
        where = np.repeat(to[long] - np.concatenate([[0], np.cumsum(many[long])])[:-1], many[long]) + np.arange(many[long].sum())
        out[where] = mix(acc + np.uint64(width))
    for i in np.flatnonzero((n > 0) & (n < width)):
        acc = np.uint64(n[i])
        with np.errstate(over="ignore"):
            for j in range(n[i]):
                acc = acc + value[at[i] + j] * _ORDER[j]
        out[to[i]] = mix(np.array([acc]))[0]
    return out, to
