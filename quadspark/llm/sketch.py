"""Fast similarity sketches of hash sets, and their bands."""

from __future__ import annotations

import numpy as np

from .textops import mix64, seeded


def sketch(values: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """A (documents x bins) sketch of sets of 64-bit hashes laid end to end; bin i of two sets agrees with probability J.

    In round i < bins every element of a set throws itself into one hashed bin with a hashed value, in round bins + i it
    goes to bin i; the least value of the earliest round that reaches a bin stays.  Thus every bin of a non-empty set
    fills, in one or two rounds for all but small sets, and because the rounds place elements without replacement over bins
    the number of agreements is at least as concentrated as that of independent minima.  Empty sets have rows of zeros.
    """
    n = len(first) - 1
    out = np.full(n * bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = np.zeros(n * bins, dtype=bool)
    size = np.diff(first)
    active = size > 0
    salts = seeded(41, 2 * bins)
    x, owner = values, np.repeat(np.arange(n, dtype=np.int64), size)
    for i in range(2 * bins):
        keep = active[owner]
        if not keep.all():
            x, owner = x[keep], owner[keep]
        if not len(x):
            break
        h = mix64(x ^ salts[i])
        cell = owner * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else owner * bins + (i - bins)
        if i:
            new = ~filled[cell]
            cell, h = cell[new], h[new]
        np.minimum.at(out, cell, mix64(h))
        filled[cell] = True
        active = active & ~filled.reshape(n, bins).all(axis=1)
    out[~filled] = 0
    return out.reshape(n, bins)


def bands(s: np.ndarray, rows: int) -> np.ndarray:
    """(documents x bands) 64-bit keys of runs of `rows` bins; the number of the band enters the key."""
    n, bins = s.shape
    count = bins // rows
    salt, key = seeded(43, count), np.zeros((n, count), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix64(key + s[:, r : count * rows : rows])
        return mix64(key ^ salt[None, :])
