"""Byte-level text kernels shared by the corpus operators.

Everything here works on one Arrow batch at a time: the batch's UTF-8 buffer is viewed as a numpy byte array, so words,
shingles and n-grams of all documents of the batch are hashed with a handful of vectorised passes and no per-word Python
objects.  Bytes 0x80 and up never occur inside ASCII separators, hence splitting UTF-8 bytes equals splitting code points.
"""

from __future__ import annotations

import numpy as np

#: Batches are cut into runs of documents of about this many bytes, which bounds the temporaries (8 bytes each a byte).
RUN_BYTES = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def seeded(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003 & (1 << 64) - 1)) * _ODD)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^0..p^n and p^-0..p^-n modulo 2^64 for the fixed odd base p."""
    if "p" not in _POWERS or len(_POWERS["p"]) <= n:
        m = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in (("p", _ODD), ("q", _INV)):
                a = np.full(m, base, dtype=np.uint64)
                a[0] = 1
                _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["p"][: n + 1], _POWERS["q"][: n + 1]


_BYTE = seeded(7, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_table() -> np.ndarray:
    return _LOWER


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n + 1 offsets; nulls count as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    n = len(column)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, dtype=np.int64)
    if column.null_count:  # a null may own bytes of the buffer
        return string_buffers(column.fill_null(""))
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES):
    """Ranges of whole documents with about `most` bytes each (a longer document stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H[i] = sum of values[j] * p^j over j < i, modulo 2^64."""
    p, _ = powers(len(values))
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(values * p[:-1], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of values[start:end] from the prefix sums; equal windows hash equal wherever they stand."""
    _, q = powers(len(prefix) - 1)
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64) * _M2)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of documents laid end to end.

    Returns the 64-bit hash, start and end of every word, and the n + 1 offsets of the documents' words.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(offsets), dtype=np.int64)
    gap = _SPACE[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = True, True
    np.not_equal(gap[1:], gap[:-1], out=edge[1:n])
    edge[offsets] = True  # a word ends with its document
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = ~gap[start]
    start, end = start[keep], end[keep]
    h = window_hash(prefix_hash(_BYTE[_LOWER[data] if lower else data]), start, end)
    return h, start, end, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document as sorted 64-bit hashes, and the n + 1 offsets of the documents.

    A document of fewer words has its whole sequence as one shingle, one without words has none.  The length enters the
    hash, so a short document never equals a piece of a longer one by accident of the sum.
    """
    n_docs, count = len(first) - 1, np.diff(first)
    c = seeded(11, k)
    with np.errstate(over="ignore"):
        m = max(0, len(h) - k + 1)
        full = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            full += mix64(h[j : j + m] ^ c[j])
        full = mix64(full + np.uint64(k))
    doc = np.repeat(np.arange(n_docs), count)
    pos = np.arange(len(h)) - first[:-1][doc]
    ok = pos[:m] + k <= count[doc[:m]]
    values, owner = [full[ok]], [doc[:m][ok]]
    short = np.flatnonzero((count > 0) & (count < k))
    for d in short:
        w = h[first[d] : first[d + 1]]
        with np.errstate(over="ignore"):
            s = np.uint64(0)
            for j in range(len(w)):
                s = s + mix64(w[j : j + 1] ^ c[j])[0]
            values.append(mix64(np.array([s + np.uint64(len(w))], dtype=np.uint64)))
        owner.append(np.array([d]))
    v, o = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((v, o))
    v, o = v[order], o[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    return v, np.searchsorted(o, np.arange(n_docs + 1))
