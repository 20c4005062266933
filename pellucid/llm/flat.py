"""Vectorised text kernels over Arrow string buffers.

A column of texts is one byte buffer plus offsets.  All kernels work on the
whole buffer with numpy, so the cost for each byte is a handful of vector
operations and no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

#: Bytes of text that one vectorised step handles; bounds a worker's memory.
STEP_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: True for bytes of words `[^\x20\x09-\x0D]+`.
WORD_BYTES = ~_SPACE
#: True for bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ITEM_BYTES = np.zeros(256, bool)
ITEM_BYTES[0x30:0x3A] = ITEM_BYTES[0x61:0x7B] = True
ITEM_BYTES[0x80:] = True
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240917)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_GRAM = int(_rng.integers(1, 2**62)) * 2 + 1
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(64, 1 << (n - 1).bit_length() if n > 1 else 64), U64)
        have[1:] = U64(base)
        have = np.multiply.accumulate(have)
        _pow[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds at most so many bytes of the column's text, or one row."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        start = 0
        while start < len(size):
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and for each text the index of its first word (n+1 values)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = kind[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    begin[edge] = inside[edge]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = at[1:][at[:-1] < at[1:]] - 1
    end[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    size = ends - starts
    base = np.cumsum(size) - size
    total = int(base[-1] + size[-1])
    inner = np.arange(total, dtype=np.int64) - np.repeat(base, size)
    source = inner + np.repeat(starts, size)
    part = _VALUE[data[source]] * powers(_BASE, int(size.max()))[inner]
    return mix(np.add.reduceat(part, base) + size.astype(U64) * U64(0x9E3779B97F4A7C15))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k consecutive values; len(h) - k + 1 of them, across texts too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p = powers((_GRAM + 2 * seed) % 2**64 | 1, k)
    out = np.zeros(n, U64)
    for j in range(k):
        out += h[j : j + n] * p[j]
    return mix(out + U64(seed))


def owner(first: np.ndarray, n: int) -> np.ndarray:
    """Index of the text for each of n words; first has the index of each text's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


def whole_windows(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """True at word i if the k words from i lie in one text; length n - k + 1."""
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m + k, bool)
    for j in range(1, k):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < m)]] = False
    return ok[:m]


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each i, the leftmost index of the least value in h[i:i+w]; len(h) - w + 1 of them."""
    n = len(h)
    index = np.arange(n)
    span = 1
    while span * 2 <= w:
        a, b = index[:-span], index[span:]
        index = np.where(h[a] <= h[b], a, b)
        span *= 2
    if span < w:
        a, b = index[: n - w + 1], index[w - span : w - span + n - w + 1]
        index = np.where(h[a] <= h[b], a, b)
    return index


def spread(part: np.ndarray, n: int, columns: dict[str, np.ndarray]) -> Iterator[dict[str, bytes | int]]:
    """For each target part with entries: its number and the bytes of its rows of every column."""
    part = part.astype(np.uint16 if n <= 1 << 16 else np.int64)  # small keys are sorted by radix
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    held = {k: v[order] for k, v in columns.items()}
    for p in np.flatnonzero(np.diff(cut)):
        yield {"part": int(p)} | {k: v[cut[p] : cut[p + 1]].tobytes() for k, v in held.items()}
