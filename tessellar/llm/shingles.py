"""Hashes of words and of runs of words, vectorised over one text."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

#: Word hashes that a worker remembers; at the bound it starts anew.
REMEMBERED = 500_000
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def powers(n: int, base: int = _STEP) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of width words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(_STEP) + hashes[k : n + k]
    return mix(total)


class Spans:
    """Hashes of any run of words, from prefix sums of a polynomial in an odd base (divided back to the run's start)."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        self.back = powers(n, _BACK)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(n)[:-1], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + lengths)
