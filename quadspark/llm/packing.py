"""Best-fit packing with exact complements: token pieces into sequences of a fixed length."""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, numbered

_ENCODERS: dict[tuple, object] = {}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file, by their strings: wherever a text holds one, it is that one token."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(path: str, pattern: str, added: dict[str, int] | None = None):
    """A byte-level BPE encoder from a file of ranks and the added tokens, kept by worker."""
    key = path, pattern, tuple(sorted((added or {}).items()))
    if key not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    return _ENCODERS[key]


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and end of the pieces of n tokens: all of the capacity but the first, which may be shorter."""
    head = n % capacity or min(n, capacity)
    if n:
        yield 0, head
    for at in range(head, n, capacity):
        yield at, at + capacity


def pieces(docs: DataFrame, ranks: str, pattern: str, added: dict[str, int] | None, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Token pieces of each document with an end token: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern, added)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            seen: dict[str, list] = {}  # copies within a batch are encoded once
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                if (rows := seen.get(text)) is None:
                    ids = np.append(enc.encode_to_numpy(text, allowed_special="all").astype("<u4"), np.uint32(end_id)).astype("<u4")
                    rows = seen[text] = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(cut(len(ids), capacity))]
                for row in rows:
                    for column, value in zip(out, (doc, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int, reserve: int = 2) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each, from the number of pieces of every length.

    Longest length first, a gap is filled exactly by one piece, else by a pair, else by a triple, whose sums are looked up
    under what is still available; as many sequences as the scarcest length allows are made at a time.  Pairs and triples
    leave `reserve` pieces of every length, without which too few short pieces are left to close the last gaps.  What has
    no exact combination left is packed best-fit decreasing, also many at a time.  The work depends on the capacity, not on
    the number of pieces.
    """
    c = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        c[length] += n
    spare = c > reserve  # lengths of which pairs and triples may still take
    made: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        n = min(max(0, int(c[x]) - (reserve if len(pattern) > 2 else 0)) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                c[x] -= n * k
                spare[x] = c[x] > reserve
            made.append((pattern, n))

    rest: dict[int, int] = {}
    if c[capacity]:
        take((capacity,))
    for first in range(capacity - 1, 0, -1):
        gap = capacity - first
        if c[first] and gap <= first:
            take((first, gap))
        if spare[first]:  # pairs, the larger piece first
            a = np.arange(gap - 1, (gap - 1) // 2, -1)
            for x in a[spare[a] & spare[gap - a]].tolist():
                if not spare[first]:
                    break
                take((first, x, gap - x))
        if spare[first] and gap >= 3:
            left = np.flatnonzero(spare[(gap - 1) // 3 + 1 : gap - 1])[::-1] + (gap - 1) // 3 + 1
            for x in left.tolist():
                if not spare[first]:
                    break
                b = np.arange(min(x, gap - x - 1), (gap - x - 1) // 2, -1)
                for y in b[spare[b] & spare[gap - x - b]].tolist():
                    if not spare[first] or not spare[x]:
                        break
                    take((first, x, y, gap - x - y))
        if c[first]:
            rest[first] = int(c[first])
            c[first] = 0
            spare[first] = False
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by gap
    gaps: list[int] = []  # those with open sequences, sorted

    def opened(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if not open_[gap]:
            insort(gaps, gap)
        open_[gap].append((pattern, n))

    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps) or gaps[at] >= capacity:
                each = capacity // length
                full, some = divmod(left, each)
                for k, n in ((each, full), (some, 1)):
                    if k and n:
                        opened(capacity - k * length, (length,) * k, n)
                left = 0
            else:
                gap = gaps[at]
                pattern, n = open_[gap].pop()
                k = min(n, left)
                if n > k:
                    open_[gap].append((pattern, n - k))
                if not open_[gap]:
                    del gaps[at]
                opened(gap - length, (*pattern, length), k)
                left -= k
    return made + [x for group in open_.values() for x in group]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: which piece of a length goes where."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in patterns:
        at = 0
        for length in pattern:
            rows.append((length, used[length], sequence, at))
            used[length] += n
            at += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, ranks: str, pattern: str, added: dict[str, int] | None = None, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into few sequences of at most `capacity` tokens.

    Ids are those of the ranks and the split `pattern`; a string of `added` is that token wherever it stands.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.  A null or empty text is
    its end token alone; repeated rows are packed each; an empty table gives no rows.  The driver holds the histogram of
    lengths (at most `capacity` rows) and the patterns made of it; pieces get their rank within their length, and so their
    place, without meeting in one task.
    """
    ws = Workspace(docs.sparkSession, "packing")
    cut_ = ws.table(pieces(docs, ranks, pattern, added, end_id, capacity, id_col, text_col), "pieces")
    counts = {r[0]: r[1] for r in cut_.groupBy("length").count().collect()}
    where = slots(plan(counts, capacity))
    buckets = min(4096, max(64, max(counts.values(), default=0) // 50_000))
    ranked = numbered(cut_, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", F.struct("doc_id", "piece", "ids_crc32"), buckets)
    shift = 1 << 42
    keys = where[:, 0] * shift + where[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            slot = where[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            more = [pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), *more], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
