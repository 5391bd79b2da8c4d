"""Vectorised helpers over Arrow text columns: words, shingles and their hashes.

A batch of texts is one byte buffer with offsets; words and shingles are spans
of bytes, so no Python object is made for a word.  White space is the six
bytes 0x20 and 0x09-0x0D; these never occur inside a UTF-8 sequence.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def give_back() -> None:
    """Hand free memory of this worker back to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # of the GNU C library; others do it unasked
    if trim:
        trim(0)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The column that ``buffers`` takes apart (under 2 GB)."""
    return pa.Array.from_buffers(kind or pa.string(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pieces(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts, of about ``size`` bytes each, so that work stays in the cache."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of words of each text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:n]
    ends = word
    ends[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A-Z lower-cased, all words joined by one space: the bytes, and each word's new span."""
    length = end - start
    to = np.cumsum(length + 1)
    new_end = to - 1
    new_start = new_end - length
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    if len(start):
        at = np.arange(int(length.sum())) + np.repeat(np.arange(len(start)), length)
        out[at] = LOWER[data[np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)]]
    return out, new_start, new_end


def shingle_words(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first and last word of each ``k``-word shingle, and the number of shingles of each text.

    A text of fewer words has one shingle, its whole sequence; one without words has none."""
    n = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    first_word = np.cumsum(counts) - counts
    first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first_word, n)
    return first, first + np.repeat(np.minimum(counts, k), n) - 1, n


# The published constants of the XXH64 hash.
PRIMES = [np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161,
                                 9650029242287828579, 2870177450012600261)]
LONG_SLICE = 2048


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of ``data`` at once, as uint64."""
    p1, p2, p3, p4, p5 = PRIMES
    with np.errstate(over="ignore"):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,)).copy()
        at, left = start.astype(np.int64), length.astype(np.int64)
        s = np.uint64(seed)
        h = np.full(len(at), s + p5, np.uint64)
        large = np.flatnonzero(left >= 32)
        if len(large):
            pos = at[large].copy()
            stripes = np.minimum(left[large], LONG_SLICE) // 32
            acc = [np.full(len(large), v, np.uint64) for v in (s + p1 + p2, s + p2, s, s - p1)]
            for i in range(int(stripes.max())):
                on = slice(None) if i < stripes.min() else np.flatnonzero(stripes > i)
                for j in range(4):
                    acc[j][on] = _rotl(acc[j][on] + eight[pos[on] + 8 * j] * p2, 31) * p1
                pos[on] += 32
            v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                v = (v ^ (_rotl(a * p2, 31) * p1)) * p1 + p4
            h[large] = v
            at[large] = pos
            left[large] -= stripes * 32
        h += length.astype(np.uint64)
        on = np.flatnonzero(left >= 8)
        while len(on):
            h[on] = _rotl(h[on] ^ (_rotl(eight[at[on]] * p2, 31) * p1), 27) * p1 + p4
            at[on] += 8
            left[on] -= 8
            on = on[left[on] >= 8]
        on = np.flatnonzero(left >= 4)
        if len(on):
            h[on] = _rotl(h[on] ^ ((eight[at[on]] & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
            at[on] += 4
            left[on] -= 4
        on = np.flatnonzero(left > 0)
        while len(on):
            h[on] = _rotl(h[on] ^ ((eight[at[on]] & np.uint64(0xFF)) * p5), 11) * p1
            at[on] += 1
            left[on] -= 1
            on = on[left[on] > 0]
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    very_long = np.flatnonzero(length >= LONG_SLICE)
    if len(very_long):
        import xxhash

        whole = data.tobytes()
        for i in very_long:
            h[i] = xxhash.xxh64_intdigest(whole[start[i]:start[i] + length[i]], seed)
    return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``k``-word shingle (A-Z lower-cased words) and the number of shingles of each text."""
    start, end, counts = word_spans(data, offsets)
    words = xxh64(LOWER[data], start, end - start)
    first, last, n = shingle_words(counts, k)
    with np.errstate(over="ignore"):
        h = np.zeros(len(first), np.uint64)
        for j in range(k):
            at = first + j
            on = at <= last
            h = np.where(on, h * np.uint64(0x9E3779B97F4A7C15) + words[np.where(on, at, 0)] if len(words) else h, h)
    return mixed(h), n
