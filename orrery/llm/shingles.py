"""Hashed word shingles of whole texts, vectorised over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULT = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the runs of non-space bytes."""
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.arange(len(b))
    within = at - np.maximum.accumulate(np.where(first, at, 0))
    within[: starts[0]] = 0
    within[space] = 0
    powers = np.cumprod(np.full(int(within.max()) + 1, _BASE), dtype=np.uint64)
    return starts, mix(np.add.reduceat(_BYTE[b] * powers[within], starts))


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text; A-Z are lower-cased. A text of fewer than k words has one, of no words none."""
    i = 0
    while i < len(texts):
        parts, size, j = [], 0, i
        while j < len(texts) and (j == i or size < CHUNK):
            parts.append((texts[j] or "").encode("utf-8", "surrogatepass").lower())
            size += len(parts[-1]) + 1
            j += 1
        starts, words = word_hashes(b" ".join(parts) + b" ")
        bounds = np.searchsorted(starts, np.cumsum([0, *[len(p) + 1 for p in parts]]))
        if len(words) >= k:
            grams = words[: len(words) - k + 1] * _MULT[0]
            for m in range(1, k):
                grams = grams + words[m : len(words) - k + 1 + m] * _MULT[m]
            grams = mix(grams)
        for d in range(j - i):
            a, z = bounds[d], bounds[d + 1]
            n = z - a
            if n >= k:
                yield np.unique(grams[a : z - k + 1])
            elif n:
                yield mix(np.array([np.sum(words[a:z] * _MULT[:n], dtype=np.uint64) + np.uint64(n)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        i = j
