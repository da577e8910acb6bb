"""Numpy helpers that turn Arrow text batches into word-hash arrays.

They run inside ``mapInArrow`` tasks.  A "chunk" is a run of documents with
about one MB of text, so that every temporary array stays small; one longer
document is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on nothing but key and seed."""
    salt = (seed * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)
    return ((mix(keys.astype(np.uint64) ^ mix(np.array([salt], np.uint64))) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty texts, and the documents' offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    width = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, width, count=len(column) + 1, offset=column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes, or one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """The words of a run of documents: maximal runs of bytes that are not ASCII white space.

    ``hash`` has a 64-bit hash per word, ``start`` and ``end`` its byte range,
    and words ``at[i]:at[i + 1]`` belong to document i.
    """

    __slots__ = ("at", "end", "hash", "raw", "start")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool):
        offsets = offsets - offsets[0]
        self.raw = raw = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = ~_WHITE[raw]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside
        after = before[1:].copy() if n else before[:0]
        edge = offsets[(offsets > 0) & (offsets < n)]
        previous = before[:n].copy()
        previous[edge] = False
        following = np.zeros(n, bool)
        following[:-1] = after[1:]
        following[edge - 1] = False
        self.start = np.flatnonzero(inside & ~previous)
        self.end = np.flatnonzero(inside & ~following) + 1
        self.at = np.searchsorted(self.start, offsets)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw] * powers(_BASE, n), out=total[1:])
        value = total[self.end] - total[self.start]
        value *= powers(_BASE_INV, n)[self.start] if n else value
        self.hash = mix(value ^ (self.end - self.start).astype(np.uint64))

    def document(self) -> np.ndarray:
        """The index of each word's document."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def word_chunks(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first document, end, words) for each chunk of a text column."""
    raw, offsets = text_buffers(column)
    for a, b in chunks(offsets):
        yield a, b, Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1], lower)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words, by first word; no document limits."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * powers(_BASE, n), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(_BASE_INV, n)[: n - size + 1])


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
