"""LM scoring: an interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and kept as sorted arrays."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mapped, qualified, store
from .common import Workspace, as_long, groups_of
from .textops import mix64, runs, string_buffers, words

END = np.uint64(0x5DEECE66D1234567)  # the hash that stands for a text's end
FLUSH = 1_500_000  # entries a task holds before it merges them
BUCKET_BYTES = 8 << 20  # bytes of training text for each bucket of n-grams, which is one task's
LONG = 16  # followers from which a context's sums are stored
BLOCK = 64  # contexts that share the base of their offsets
LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Vocabulary:
    """Distinct training tokens by hash.  A token's id is its rank; bucket b holds ranks first[b] to first[b + 1]."""

    path: str
    buckets: int
    first: np.ndarray  # ranks before each bucket
    mass: np.ndarray  # training tokens before each bucket
    texts: int

    @property
    def size(self) -> int:
        return int(self.first[-1])

    @property
    def tokens(self) -> int:
        return int(self.mass[-1])

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted hashes: id (-1 if unknown) and count."""
        ids, count = np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        bucket = bucket_of(h, self.buckets)
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.unique(bucket):
            own = slice(cuts[b], cuts[b + 1])
            if self.first[b] == self.first[b + 1]:
                continue  # an empty bucket has no file
            known = mapped(f"{self.path}/hash-{b}", "<u8")
            at = np.minimum(np.searchsorted(known, h[own]), len(known) - 1)
            ok = known[at] == h[own]
            ids[own] = np.where(ok, at + self.first[b], -1)
            count[own] = np.where(ok, mapped(f"{self.path}/count-{b}", "<i8")[at], 0)
        return ids, count


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def merge_triples(contexts: np.ndarray, tokens: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a context and a token, sorted, and the sums of their counts (of 1 if none are given)."""
    order = np.lexsort((tokens, contexts))
    contexts, tokens = contexts[order], tokens[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (contexts[1:] != contexts[:-1]) | (tokens[1:] != tokens[:-1])
    at = np.flatnonzero(new)
    if counts is None:
        counts = np.diff(at, append=len(tokens))
    else:
        counts = np.add.reduceat(counts[order], at) if len(at) else counts
    return contexts[at], tokens[at], counts


class Tally:
    """Counts of 64-bit keys, merged whenever many have gathered."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.limit = 0, FLUSH

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > self.limit:
            self.parts = [self.all()]
            self.held = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.held > self.limit

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return merge(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))

    def clear(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.all()
        self.parts, self.held = [], 0
        return out


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte of their places: a block compressor finds the zeros of the high ones."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    x = np.frombuffer(blob, dtype=np.uint8, count=4 * n, offset=at).reshape(4, n)
    return np.ascontiguousarray(x.T).view("<u4").reshape(-1), at + 4 * n


def encode(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts: high halves as differences, all by byte planes."""
    high = (keys >> np.uint64(32)).astype(np.uint32)
    return b"".join(map(_planes, (np.diff(high, prepend=np.uint32(0)), keys & LOW, counts & 0xFFFFFFFF, counts >> 32)))


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at, a = len(blob) // 16, 0, []
    for _ in range(4):
        x, at = _unplaned(blob, at, n)
        a.append(x)
    keys = np.cumsum(a[0], dtype=np.uint64) << np.uint64(32) | a[1].astype(np.uint64)
    return keys, a[2].astype(np.int64) | a[3].astype(np.int64) << 32


def encode_triples(contexts: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> bytes:
    """Each context once with the number of its tokens, then tokens and counts."""
    at = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(contexts) else np.zeros(0, np.int64)
    own = contexts[at]
    high = (own >> np.uint64(32)).astype(np.uint32)
    head = np.array([len(own), len(tokens)], dtype="<u8").tobytes()
    return head + b"".join(map(_planes, (np.diff(high, prepend=np.uint32(0)), own & LOW, np.diff(at, append=len(contexts)), tokens, counts & 0xFFFFFFFF, counts >> 32)))


def decode_triples(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, dtype="<u8", count=2).astype(int)
    at, a = 16, []
    for k in (n, n, n, m, m, m):
        x, at = _unplaned(blob, at, k)
        a.append(x)
    own = np.cumsum(a[0], dtype=np.uint64) << np.uint64(32) | a[1].astype(np.uint64)
    return np.repeat(own, a[2]), a[3], a[4].astype(np.int64) | a[5].astype(np.int64) << 32


def _spans(of: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal numbers."""
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _sliced(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, of keys sorted by it."""
    spans = _spans(bucket)
    return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([encode(keys[a:b], counts[a:b]) for a, b in spans], pa.binary())], ["bucket", "blob"])


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows, their word hashes and the offsets of the rows' words."""
    data, off = string_buffers(batch.column(column))
    for i, j in runs(off):
        h, _, _, first = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, j, h, first


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, texts = Tally(), 0
        for batch in batches:
            texts += batch.num_rows
            for _, _, h, _ in _texts(batch, 0):
                tally.add(*np.unique(h, return_counts=True))
            if tally.full:
                k, c = tally.clear()
                yield _sliced(k, c, bucket_of(k, buckets))
        tally.add(np.array([END]), np.array([texts]))
        k, c = tally.clear()
        k, c = (k, c) if texts else (k[:0], c[:0])
        yield _sliced(k, c, bucket_of(k, buckets))

    return run


def _merged(g: dict) -> tuple[np.ndarray, np.ndarray]:
    parts = [decode(b) for b in g["blob"]]
    return merge(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def _store_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["bucket"]):
            b = int(g["bucket"][0])
            k, c = _merged(g)
            store(f"{path}/hash-{b}", k)
            store(f"{path}/count-{b}", c)
            store(f"{path}/before-{b}", np.cumsum(c) - c)
            ends = int(c[k == END].sum())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (b, len(k), int(c.sum()), ends)], ["bucket", "n", "tokens", "ends"])

    return run


def _positions(v: Vocabulary, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each token of the rows, the end of each included: the row, the token's id (-1 if unknown), its count, and the ids of
    the one and two before it (before a text's start the vocabulary's size)."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first) + 1)
    last = np.cumsum(np.diff(first) + 1) - 1
    token = np.empty(len(row), dtype=np.uint64)
    inner = np.ones(len(row), dtype=bool)
    inner[last] = False
    token[inner], token[last] = h, END
    distinct, back = np.unique(token, return_inverse=True)
    ids, count = (x[back] for x in v.look_up(distinct))
    start = np.concatenate(([0], last[:-1] + 1)) if n else last
    one, two = np.empty_like(ids), np.empty_like(ids)
    one[1:] = ids[:-1]
    one[start] = v.size
    two[1:] = one[:-1]
    two[start] = v.size
    return row, ids, count, one, two


def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)


def _count_triples(v: Vocabulary, buckets: int):
    """Each task's distinct trigrams and their counts, dealt by the hash of the two first tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def give() -> pa.RecordBatch:
            k, t = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
            parts.clear()
            k, t, c = merge_triples(k, t)
            b = bucket_of(mix64(k), buckets)
            order = np.argsort(b, kind="stable")
            k, t, c, b = k[order], t[order], c[order], b[order]
            spans = _spans(b)
            return pa.RecordBatch.from_arrays([pa.array([int(b[x]) for x, _ in spans], pa.int64()), pa.array([encode_triples(k[x:y], t[x:y], c[x:y]) for x, y in spans], pa.binary())], ["bucket", "blob"])

        held = 0
        for batch in batches:
            for _, _, h, first in _texts(batch, 0):
                _, ids, _, one, two = _positions(v, h, first)
                parts.append((_key(two, one), ids.astype(np.uint32)))
                held += len(ids)
                if held > FLUSH:
                    yield give()
                    held = 0
        if parts:
            yield give()

    return run


def _count_pairs(v: Vocabulary, buckets: int):
    """Each task's distinct bigrams and their counts, dealt by `pair_bucket`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def give() -> pa.RecordBatch:
            k, c = tally.clear()
            b = pair_bucket(v, k, buckets)
            order = np.argsort(b, kind="stable")
            return _sliced(k[order], c[order], b[order])

        for batch in batches:
            for _, _, h, first in _texts(batch, 0):
                _, ids, _, one, _ = _positions(v, h, first)
                tally.add(*np.unique(_key(one, ids), return_counts=True))
            if tally.full:
                yield give()
        yield give()

    return run


def pair_bucket(v: Vocabulary, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of sorted bigram keys: by the share of training bigrams with a smaller left token, and within one left token by
    the share of tokens smaller than the right one.  A left token that is very frequent is dealt over many buckets."""
    left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & LOW).astype(np.int64)
    c, s = v_mass(v, left)
    _, r = v_mass(v, right)
    share = (s + c * (r / max(v.tokens, 1))) / max(v.tokens + v.texts, 1)
    return np.clip((share * buckets).astype(np.int64), 0, buckets - 1)


def v_mass(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count of each id, and number of training tokens of smaller ids; the start's id is the vocabulary's size."""
    distinct, back = np.unique(ids, return_inverse=True)
    c, s = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
    cuts = np.searchsorted(distinct, v.first)
    for b in range(v.buckets):
        if cuts[b] < cuts[b + 1]:
            own = slice(cuts[b], cuts[b + 1])
            at = distinct[own] - v.first[b]
            c[own] = mapped(f"{v.path}/count-{b}", "<i8")[at]
            s[own] = mapped(f"{v.path}/before-{b}", "<i8")[at] + v.mass[b]
    c[cuts[-1] :], s[cuts[-1] :] = v.texts, v.tokens
    return c[back], s[back]


def _store_counts(path: str, b: int, counts: np.ndarray) -> None:
    """Counts as bytes, those of 255 and more besides with their places."""
    store(f"{path}/times-{b}", np.minimum(counts, 255).astype("<u1"))
    big = np.flatnonzero(counts >= 255)
    store(f"{path}/more-{b}", np.stack((big, counts[big])).astype("<i8"))


def _counts(path: str, b: int, at: np.ndarray) -> np.ndarray:
    c = mapped(f"{path}/times-{b}", "<u1")[at].astype(np.int64)
    big = np.flatnonzero(c == 255)
    if len(big):
        place, n = mapped(f"{path}/more-{b}", "<i8").reshape(2, -1)
        c[big] = n[np.searchsorted(place, at[big])]
    return c


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _store_triples(path: str, v: Vocabulary, buckets: int):
    """Stores a bucket of trigrams: contexts, the offsets of their tokens, tokens and counts, and the sums of long contexts; gives,
    dealt by buckets of bigrams, how many distinct tokens each bigram of second and third tokens has before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def give() -> pa.RecordBatch:
            k, c = tally.clear()
            b = pair_bucket(v, k, buckets)
            order = np.argsort(b, kind="stable")
            return _sliced(k[order], c[order], b[order])

        for g in groups_of(batches, ["bucket"]):
            b = int(g["bucket"][0])
            k, t, c = merge_triples(*(np.concatenate(x) for x in zip(*(decode_triples(x) for x in g["blob"]), strict=True)))
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            at = np.append(at, len(k))
            base = at[::BLOCK]
            off = at - np.repeat(base, BLOCK)[: len(at)]
            wide = 2 if off.max() < 1 << 16 else 4
            store(f"{path}/context-{b}", k[at[:-1]])
            store(f"{path}/base-{b}", base.astype("<i8"))
            store(f"{path}/offset-{b}", off.astype(f"<u{wide}"))
            store(f"{path}/token-{b}", t.astype("<u4"))
            _store_counts(path, b, c)
            long = np.flatnonzero(np.diff(at) >= LONG)
            sums = [np.add.reduceat(x, at[:-1])[long] if len(long) else long for x in (c, c == 1, c == 2)]
            store(f"{path}/long-{b}", np.stack((long, *sums)).astype("<i8"))
            store(f"{path}/meta-{b}", np.array([wide, *_of_counts(c)], dtype="<i8"))
            tally.add(*np.unique(_key(k & LOW, t), return_counts=True))
            if tally.full:
                yield give()
        yield give()

    return run


def _store_pairs(path: str, size: int, parts: int):
    """Stores a bucket of bigrams and their numbers (counts, or of distinct tokens before them under trigrams); gives, dealt by ranges of ids, for each left
    token how many of its bigrams have 1, 2 and more and the sum (kind 0), for each right token how many bigrams end
    with it (kind 1), and the bucket's numbers of numbers (kind 2)."""

    def rows(kind: int, own: np.ndarray, n: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        spans = _spans(part)
        blobs = [encode(own[x:y].astype(np.uint64), n[x:y]) for x, y in spans]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(spans), pa.int64()), pa.array([int(part[x]) for x, _ in spans], pa.int64()), pa.array(blobs, pa.binary())], ["kind", "part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # right tokens of all the task's buckets together: their rows do not grow with the number of buckets
        followed = Tally()
        for g in groups_of(batches, ["bucket"]):
            b = int(g["bucket"][0])
            k, c = _merged(g)
            store(f"{path}/pair-{b}", k)
            _store_counts(path, b, c)
            left, right = (k >> np.uint64(32)).astype(np.int64), k & LOW
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int64()), pa.array([0], pa.int64()), pa.array([np.array(_of_counts(c), dtype=np.int64).tobytes()], pa.binary())], ["kind", "part", "blob"])
            own, n = merge(np.concatenate((left * 4 + np.minimum(c, 3) - 1, left * 4 + 3)), np.concatenate((np.ones(len(c), dtype=np.int64), c)))
            yield rows(0, own, n, own // 4 * parts // (size + 1))
            followed.add(*np.unique(right, return_counts=True))
            if followed.full:
                own, n = followed.clear()
                yield rows(1, own, n, own.astype(np.int64) * parts // (size + 1))
        own, n = followed.clear()
        yield rows(1, own, n, own.astype(np.int64) * parts // (size + 1))

    return run


def part_range(part: int, size: int, parts: int) -> tuple[int, int]:
    """The ids of a part: those with id * parts // (size + 1) == part."""
    return -(-part * (size + 1) // parts), -(-(part + 1) * (size + 1) // parts)


def _store_sides(path: str, size: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["kind", "part"]):
            kind, part = int(g["kind"][0]), int(g["part"][0])
            k, c = _merged(g)
            k = k.astype(np.int64)
            lo, hi = part_range(part, size, parts)
            width, of = (1 if kind else 4), [0, 0, 0, 0]
            n = np.zeros((hi - lo) * width, dtype="<i8")
            n[k - width * lo] = c
            store(f"{path}/{'right' if kind else 'left'}-{part}", n)
            if kind:
                of = _of_counts(c)
            more = int((c >= 3).sum()) if kind else 0
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (kind, part, *of, more, int(c.sum()))], ["kind", "part", "n1", "n2", "n3", "n4", "n3p", "total"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; with too few data the usual stand-ins 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(d if 0 <= d <= k else f for d, k, f in zip(raw, (1, 2, 3), (0.5, 1.0, 1.5), strict=True))


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(counts - np.array((0.0, *d))[np.minimum(counts, 3)], 0)


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    path: str
    order: int
    buckets: int
    parts: int
    triple_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    types: int  # distinct bigrams
    word_classes: tuple[int, int, int]  # tokens that follow 1, 2, and 3 or more distinct ones

    def side(self, name: str, ids: np.ndarray, width: int) -> np.ndarray:
        """Stored numbers of sorted ids."""
        size = self.vocabulary.size
        out = np.zeros((len(ids), width), dtype=np.int64)
        part = ids * self.parts // (size + 1)
        for p in np.unique(part):
            own = slice(*np.searchsorted(part, (p, p + 1)))
            try:
                a = mapped(f"{self.path}/pairs/{name}-{p}", "<i8").reshape(-1, width)
            except FileNotFoundError:
                continue  # no id of the part has any
            out[own] = a[ids[own] - part_range(int(p), size, self.parts)[0]]
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """The number of each of sorted bigrams, 0 if it was not seen."""
        out = np.zeros(len(keys), dtype=np.int64)
        bucket = pair_bucket(self.vocabulary, keys, self.buckets)
        order = np.argsort(bucket, kind="stable")
        for x, y in _spans(bucket[order]):
            own, b = order[x:y], int(bucket[order[x]])
            try:
                known = mapped(f"{self.path}/pairs/pair-{b}", "<u8")
            except FileNotFoundError:
                continue
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                out[own] = np.where(known[at] == keys[own], _counts(f"{self.path}/pairs", b, at), 0)
        return out

    def triples(self, contexts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each context and token: the count of the trigram, the context's total (0 if not seen) and its discounts' sum."""
        distinct, back = np.unique(contexts, return_inverse=True)
        order = np.argsort(back, kind="stable")
        first = np.searchsorted(back[order], np.arange(len(distinct) + 1))
        count, total, weight = np.zeros(len(contexts), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct))
        bucket = bucket_of(mix64(distinct), self.buckets)
        by = np.argsort(bucket, kind="stable")
        path = f"{self.path}/triples"
        for x, y in _spans(bucket[by]):
            own, b = by[x:y], int(bucket[by[x]])
            try:
                known = mapped(f"{path}/context-{b}", "<u8")
            except FileNotFoundError:
                continue
            at = np.minimum(np.searchsorted(known, distinct[own]), len(known) - 1)
            ok = known[at] == distinct[own]
            own, at = own[ok], at[ok]
            if not len(own):
                continue
            base, off = mapped(f"{path}/base-{b}", "<i8"), mapped(f"{path}/offset-{b}", f"<u{mapped(f'{path}/meta-{b}', '<i8')[0]}")
            lo, hi = (base[k // BLOCK] + off[k] for k in (at, at + 1))
            size = hi - lo
            # sums over the followers of short contexts; those of long ones are stored
            sums = np.zeros((3, len(own)), dtype=np.int64)
            short = np.flatnonzero(size < LONG)
            n = size[short]
            ends = np.cumsum(n)
            c = _counts(path, b, np.repeat(lo[short] - ends + n, n) + np.arange(ends[-1] if len(n) else 0))
            for k, z in enumerate((c, c == 1, c == 2)):
                s = np.concatenate(([0], np.cumsum(z)))
                sums[k, short] = s[ends] - s[ends - n]
            long = np.flatnonzero(size >= LONG)
            if len(long):
                table = mapped(f"{path}/long-{b}", "<i8").reshape(4, -1)
                sums[:, long] = table[1:, np.searchsorted(table[0], at[long])]
            total[own] = sums[0]
            weight[own] = np.array(self.triple_discounts) @ np.stack((sums[1], sums[2], size - sums[1] - sums[2]))
            # the tokens asked for, by bisection in their context's followers
            m = first[own + 1] - first[own]
            ask = order[np.repeat(first[own] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            a, z, t = np.repeat(lo, m), np.repeat(hi, m), tokens[ask].astype(np.int64)
            end, token = z, mapped(f"{path}/token-{b}", "<u4")
            for _ in range(int(size.max()).bit_length()):
                mid = (a + z) // 2
                open_ = a < z
                less = token[np.minimum(mid, len(token) - 1)] < t
                a, z = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, z)
            hit = a < end
            hit[hit] = token[a[hit]] == t[hit]
            count[ask[hit]] = _counts(path, b, a[hit])
        return count, total[back], weight[back]

    def log10(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each row: tokens, known tokens, base score and score."""
        v = self.vocabulary
        row, ids, count, one, two = _positions(v, h, first)
        n = len(first) - 1
        base = np.log10((count + 0.1) / (v.tokens + 0.1 * (v.size + 1)))
        known = ids >= 0
        distinct, back = np.unique(ids, return_inverse=True)
        follow = np.zeros(len(distinct), dtype=np.int64)
        ok = distinct >= 0
        follow[ok] = self.side("right", distinct[ok], 1)[:, 0]
        rest = sum(a * b for a, b in zip(self.word_discounts, self.word_classes, strict=True)) / self.types if self.types else 1.0
        p = (_less(follow, self.word_discounts) / max(self.types, 1) + rest / (v.size + 1))[back]

        # bigrams; a context that nothing follows gives way to the lower order
        before = one >= 0
        both = known & before
        keys, kb = np.unique(_key(one[both], ids[both]), return_inverse=True)
        c = np.zeros(len(ids), dtype=np.int64)
        c[both] = self.pairs(keys)[kb]
        left, lb = np.unique(one[before], return_inverse=True)
        stats = np.zeros((len(ids), 4), dtype=np.int64)
        stats[before] = self.side("left", left, 4)[lb]
        use = stats[:, 3] > 0
        kept = _less(c[use], self.pair_discounts)
        p[use] = (kept + stats[use, :3] @ np.array(self.pair_discounts) * p[use]) / stats[use, 3]

        if self.order == 3:
            at = np.flatnonzero(before & (two >= 0))
            token = np.where(ids[at] >= 0, ids[at], 1 << 32)  # no token has this id
            c, total, weight = self.triples(_key(two[at], one[at]), token)
            use = total > 0
            at, total = at[use], total[use]
            p[at] = (_less(c[use], self.triple_discounts) + weight[use] * p[at]) / total
        add = lambda x: np.bincount(row, x, n)
        return np.bincount(row, minlength=n), add(known.astype(float)).astype(np.int64), add(base), add(np.log10(p))


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Counts the model of all texts of `docs`; its arrays are written to the shared folder by the tasks that sort them.

    Order 2 counts bigrams; order 3 counts trigrams, of which bigrams and the number of distinct tokens before them follow.
    What is counted and shuffled are each task's distinct tokens and n-grams, packed in a few blobs for each bucket.  A
    bucket is what `BUCKET_BYTES` of text give and one task's, so no task grows with the input.
    More than 2**32 - 2 distinct tokens are an error."""
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram")
    path = qualified(spark, ws.path)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(buckets, *keys).sortWithinPartitions(*keys)

    def done() -> None:
        """Lets Spark delete the shuffle files of steps that are over: its cleaner waits for the driver to collect garbage."""
        gc.collect()
        spark._jvm.System.gc()

    blobs = texts.mapInArrow(_count_words(buckets), "bucket long, blob binary")
    held = dealt(blobs, "bucket").mapInArrow(_store_words(f"{path}/words"), "bucket long, n long, tokens long, ends long").collect()  # a row for each bucket
    del blobs
    done()
    n, mass = np.zeros(buckets + 1, dtype=np.int64), np.zeros(buckets + 1, dtype=np.int64)
    for r in held:
        n[r.bucket + 1], mass[r.bucket + 1] = r.n, r.tokens
    v = Vocabulary(f"{path}/words", buckets, np.cumsum(n), np.cumsum(mass), sum(r.ends for r in held))
    if v.size > (1 << 32) - 2:
        raise ValueError("the vocabulary has more tokens than ids have numbers")
    if order not in (2, 3):
        raise ValueError("models have order 2 or 3")
    of3 = np.zeros(4, dtype=np.int64)
    if order == 2:
        pairs = texts.mapInArrow(_count_pairs(v, buckets), "bucket long, blob binary")
    else:
        triples = dealt(texts.mapInArrow(_count_triples(v, buckets), "bucket long, blob binary"), "bucket")
        pairs = ws.table(triples.mapInArrow(_store_triples(f"{path}/triples", v, buckets), "bucket long, blob binary"), "pairs")
        del triples
        done()
        for b in range(buckets):
            try:
                of3 += mapped(f"{path}/triples/meta-{b}", "<i8")[1:]
            except FileNotFoundError:
                continue  # an empty bucket
    parts = buckets
    sides = ws.table(dealt(pairs, "bucket").mapInArrow(_store_pairs(f"{path}/pairs", v.size, parts), "kind long, part long, blob binary"), "sides")
    ws.clear("sides")
    done()
    of2 = np.zeros(4, dtype=np.int64)
    for r in sides.where("kind = 2").select("blob").collect():  # a row for each bucket
        of2 += np.frombuffer(r.blob, dtype=np.int64)
    schema = "kind long, part long, n1 long, n2 long, n3 long, n4 long, n3p long, total long"
    sums = dealt(sides.where("kind < 2"), "kind", "part").mapInArrow(_store_sides(f"{path}/pairs", v.size, parts), schema).where("kind = 1")
    s = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "n3p", "total")]).first()
    ws.clear()
    return Model(v, path, order, buckets, parts, discounts(*of3.tolist()), discounts(*of2.tolist()), discounts(s.n1, s.n2, s.n3, s.n4), s.total, (s.n1, s.n2, s.n3p))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 of the model's probability) of every text.

    A null or empty text is its end alone; ids are cast to long (null where they can't be); repeated rows are scored each.
    A token that the model never saw has the probability of any one unseen token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, first in _texts(batch, 1):
                tokens, known, base, total = model.log10(h, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(np.full(j - i, model.vocabulary.tokens)), pa.array(base), pa.array(total)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(as_long(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_fold(id_col: str, folds: int):
    """Whether crc32(id as text) mod `folds` is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_documents(docs: DataFrame, folds: int = 10, order: int = 2) -> DataFrame:
    """Scores all documents by a model of those that are not held out."""
    model = train(docs.where(~held_out_fold("doc_id", folds)), order=order)
    out = score(docs, model)
    return out.select("doc_id", held_out_fold("doc_id", folds).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
