"""Words and their hashes for whole Arrow batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_BASE))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, dtype=U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if len(have) <= 1 << 22:
            _powers[base] = have
    return have[:n]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = raw(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and its n + 1 offsets from 0; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    ends = np.frombuffer(where, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]], ends - ends[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of value(byte) * base**position over s <= position < e."""
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_BYTES[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of each byte span, from ``prefix_sums``."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start] + (end - start).astype(U))


def words(data: np.ndarray, ends: np.ndarray, is_word: np.ndarray):
    """Start, end and hash of each word after lower-casing A-Z, and the first word of each text."""
    inside = is_word[data]
    open_ = inside.copy()
    open_[1:] &= ~inside[:-1]
    close = inside.copy()
    close[:-1] &= ~inside[1:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    open_[cuts] = inside[cuts]
    close[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(open_), np.flatnonzero(close) + 1
    hashes = span_hash(prefix_sums(LOWER[data]), start, end)
    return start, end, hashes, np.searchsorted(start, ends)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; shorter than the input by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= U(_BASE)
        total += hashes[j:j + n]
    return mix(total + U(k))
