"""Hashed words and word shingles of many texts at once, with NumPy.

Words are maximal runs of bytes other than blank and 0x09-0x0D, with A-Z lower-cased. A word's hash is a polynomial of
its bytes modulo 2^64, taken from prefix sums over the whole batch and then mixed; a shingle's hash combines the hashes
of its words in order. Hashes depend on the words alone, so they agree between tasks.
"""

from __future__ import annotations

import numpy as np

_BASE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    for i, b in enumerate((_BASE, _INVERSE)):
        if len(_powers[i]) < n:
            p = np.full(1 << (n - 1).bit_length(), b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _grow(len(buf) + 1)
    total = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)])
    h = (total[ends - 1] - total[starts - 1]) * inverse[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(_WORD))
    return h, np.diff(np.searchsorted(starts, offsets + 1))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words (of the whole text where it has fewer, if it has any), and their number."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())
    limit = np.repeat(first + counts, n)
    out = np.zeros(len(at), np.uint64)
    used = np.zeros(len(at), np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * _BASE % (1 << 64)
        inside = at + k < limit
        out[inside] += words[at[inside] + k] * np.uint64(factor)
        used += inside
    return mix(out + used * np.uint64(_WORD)), n


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    h, n = shingle_hashes(*word_hashes(texts), size)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]
