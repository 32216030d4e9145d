"""Hashed character n-gram counts of whole texts, with numpy."""
from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Characters looked at together; n-grams across the cut are kept.
SLICE = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed_counts(points: np.ndarray, sizes: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of the n-grams of ``points``, each n with a hash of its own, in ``dims`` (a power of two) cells."""
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    total = np.zeros(dims, np.int64)
    longest = max(sizes)
    for at in range(0, max(1, len(points)), SLICE):
        part = points[max(0, at - longest + 1):at + SLICE]
        for n in sizes:
            # What lies wholly in the slice before is counted there.
            own = part[max(0, min(at, longest - 1) - n + 1):]
            if len(own) < n:
                continue
            h = np.full(len(own) - n + 1, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ own[k:len(own) - n + 1 + k]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            total += np.bincount((h * np.uint32(0xC2B2AE35)) >> shift, minlength=dims)
    return total
