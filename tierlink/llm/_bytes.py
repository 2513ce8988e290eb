"""Vectorised byte-level text primitives used inside Arrow functions.

Everything works on one concatenated ``uint8`` buffer and the documents' offsets in it, so
tokenising, shingling and fingerprinting are numpy passes without a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = U64(0x9E6D62D06F6A9A9B)  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


_KEPT = 1 << 20


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse; the first ``_KEPT`` are kept."""
    if len(_powers["up"]) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    out = []
    for b in (_BASE, U64(pow(int(_BASE), -1, 1 << 64))):
        a = np.full(n, b, U64)
        a[0] = 1
        out.append(np.multiply.accumulate(a, out=a))
    _powers["up"], _powers["down"] = (a[:_KEPT].copy() if n > _KEPT else a for a in out)
    return out[0], out[1]


def release() -> None:
    """Hand freed memory back to the system: allocators of a worker that waits for its next task hold it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run: Callable) -> Callable:
    """An Arrow function (of batches; of a group; of a key and two groups) that releases memory when it is done."""

    def of_batches(batches):
        try:
            yield from run(batches)
        finally:
            release()

    def of_group(table):
        try:
            return run(table)
        finally:
            release()

    def of_two(key, left, right):
        try:
            return run(key, left, right)
        finally:
            release()

    return of_batches if isgeneratorfunction(run) else of_group if len(signature(run).parameters) == 1 else of_two


class Fingerprints:
    """Polynomial fingerprints of any byte range of one buffer in constant time each."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        up, self._down = _power(n + 1)
        self._sums = np.zeros(n + 1, U64)
        np.cumsum(TABLE[buf] * up[:n], out=self._sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))

    def every(self, size: int) -> np.ndarray:
        """Scattered (not finalised) fingerprints of the range of ``size`` bytes at each position."""
        n = max(0, len(self._sums) - size)
        return (self._sums[size:] - self._sums[:n]) * (self._down[:n] * U64(0xD6E8FEB86659FD93))


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def row_slices(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of bytes that are not ASCII white space."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(word: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of k words; a document with fewer words gives its whole sequence."""
    n = len(word)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    full = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    h = np.zeros(len(full), U64)
    for j in range(k):
        h += mix(word[full + j] + _STEP[j]) * _STEP[j]
    count = np.bincount(doc)
    short = np.flatnonzero((count > 0) & (count < k))
    if not len(short):
        return mix(h), doc[full]
    first = np.searchsorted(doc, short)
    g = np.zeros(len(short), U64)
    for j in range(k - 1):
        on = count[short] > j
        g[on] += mix(word[first[on] + j] + _STEP[j]) * _STEP[j]
    g += count[short].astype(U64) * U64(0xD1B54A32D192ED03)
    return np.concatenate([mix(h), mix(g)]), np.concatenate([doc[full], short])


def distinct_per_doc(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document: (hash, document)."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of each run of equal values."""
    n = len(sorted_values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return first, np.diff(np.append(first, n))


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary array whose row i holds the bytes of values[bounds[i]:bounds[i + 1]]."""
    data = np.ascontiguousarray(values)
    off = (np.asarray(bounds, np.int64) * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])
