"""The hash that Spark's xxhash64 gives a long, for looking up key bitmaps inside Python tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
# The primes of the public XXH64 definition and Spark's default seed.
P1, P2, P3 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
P4, P5, SEED = U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5), U(42)


def _left(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def spark_long(values: np.ndarray) -> np.ndarray:
    x = values.view(np.uint64)
    with np.errstate(over="ignore"):
        h = (SEED + P5 + U(8)) ^ (_left(x * P2, 31) * P1)
        h = _left(h, 27) * P1 + P4
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        return h ^ (h >> U(32))
