"""Words of many texts at once: where they are, and 64-bit hashes of their bytes, in numpy.

A word is a run of bytes other than ASCII white space. Its hash is of two random polynomials over its
bytes modulo the prime 2**31 - 1 (one random value for each byte value), taken from differences of
prefix sums and mixed afterwards. Two words of n bytes at most share it by a chance under (n / 2**31)**2,
whatever they are: the field has no zero divisors that a text could aim at.
"""

from __future__ import annotations

import numpy as np

from .shared import BLANKS

CHUNK = 1 << 16  # bytes whose prefix sums are held at once
PRIME = np.uint64((1 << 31) - 1)

_rng = np.random.default_rng(20_240_501)
VALUES = _rng.integers(1, int(PRIME), (2, 256), dtype=np.uint64)
BASES = [int(x) for x in _rng.integers(1 << 20, int(PRIME), 2)]
IS_WORD = np.ones(256, bool)
IS_WORD[list(BLANKS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: list[list[np.ndarray]] = []


def folded(x: np.ndarray) -> np.ndarray:
    """Numbers under 2**62 modulo PRIME, but for PRIME itself in place of 0."""
    x = (x & PRIME) + (x >> np.uint64(31))
    return (x & PRIME) + (x >> np.uint64(31))


def powers(n: int) -> list[list[np.ndarray]]:
    """For each base, its powers and those of its inverse, n of them at least."""
    if not _powers or len(_powers[0][0]) < n:
        size, out = max(n, CHUNK), []
        for base in BASES:
            out.append([])
            for x in (base, pow(base, -1, int(PRIME))):
                own = np.ones(1, np.uint64)
                while len(own) < size:
                    own = np.r_[own, folded(own * np.uint64(pow(x, len(own), int(PRIME))))]
                out[-1].append(own)
        _powers[:] = out
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit hangs on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text's end. Words do not span texts."""
    inside = IS_WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = ends[:-1]
    edges = edges[edges < len(data)]
    begin[edges] = inside[edges]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, ends)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        own = data[base : ends[j - 1]]
        s, e, half = starts[i:j] - base, ends[i:j] - base, []
        for values, (up, down) in zip(VALUES, powers(len(own))):
            sums = np.zeros(len(own) + 1, np.uint64)
            x = values[own] * up[: len(own)]
            np.cumsum((x & PRIME) + (x >> np.uint64(31)), out=sums[1:])  # each under 2**32, which the sums have room for
            x = folded(folded(sums[e] - sums[s]) * down[s])
            half.append(np.where(x == PRIME, np.uint64(0), x))
        out[i:j] = (half[0] << np.uint64(32)) | half[1]
        i = j
    return mixed(out)
