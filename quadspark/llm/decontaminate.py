"""Benchmark decontamination: pigeonhole piece hits, verified with Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace
from .textops import lower_table, runs, string_buffers

_BITS = 20
_GRAM_BITS = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)


_PLAIN = {c: c + 32 for c in range(65, 91)} | dict.fromkeys(range(9, 14), " ")


def normal(text: str) -> str:
    """A-Z in lower case, runs of white space as one space, none at the ends."""
    return " ".join(w for w in text.translate(_PLAIN).split(" ") if w)


WORD = 10  # items of fewer characters count only where they stand as whole words


@dataclass
class Item:
    item_id: object
    text: str
    budget: int

    @cached_property
    def masks(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(self.text):
            out[c] = out.get(c, 0) | 1 << i
        return out

    @property
    def shortest(self) -> int:
        """Bytes of the shortest piece, which the index looks up; 8 at most."""
        return min(8, *(len(p) for p, _ in self.pieces()))

    def pieces(self) -> list[tuple[bytes, int]]:
        """The budget + 1 pieces and where they start, as even as they get; an item of no more characters is one piece a character."""
        n = min(self.budget + 1, len(self.text))
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return [(self.text[a:b].encode(), a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def whole(self, text: str, at: int) -> bool:
        """Whether the item stands at a place unchanged and as whole words."""
        end = at + len(self.text)
        return text.startswith(self.text, at) and not (at and text[at - 1].isalnum() and self.text[0].isalnum()) and not (end < len(text) and text[end].isalnum() and self.text[-1].isalnum())


def myers(masks: dict[str, int], m: int, text: str) -> list[int]:
    """Least edit distance of the whole pattern to a piece of the text that ends at each character, bit-parallel."""
    full = (1 << m) - 1
    pv, mv, score, top, out = full, 0, m, 1 << (m - 1), []
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        out.append(score)
    return out


def best_match(item: Item, text: str) -> tuple[int, int, int] | None:
    """Distance, start and end of the best piece of the text within the budget: least distance, then first end, then latest start."""
    m = len(item.text)
    at = myers(item.masks, m, text)
    if not at or (d := min(at)) > item.budget:
        return None
    end = at.index(d) + 1
    back: dict[str, int] = {}
    for i, c in enumerate(reversed(item.text)):
        back[c] = back.get(c, 0) | 1 << i
    rev = myers(back, m, text[max(0, end - m - d) : end][::-1])
    return d, end - (rev.index(min(rev)) + 1), end


class Index:
    """The pieces of a block of items: each item in budget + 1 pieces, one of which any match within the budget holds unchanged."""

    def __init__(self, items: list[Item]):
        self.items = items
        rows = [(piece, k, a) for k, it in enumerate(items) for piece, a in it.pieces()]
        self.q = min(8, *(len(p) for p, _, _ in rows)) if rows else 8
        self.mask = np.uint64((1 << 8 * self.q) - 1)
        key = lambda b: int.from_bytes(b[:8].ljust(8, b"\0"), "little")
        rows.sort(key=lambda r: key(r[0][: self.q]))
        self.piece = [p for p, _, _ in rows]
        self.head = np.array([key(p[: self.q]) for p in self.piece], dtype=np.uint64)
        self.length = np.array([len(p) for p in self.piece], dtype=np.int64)
        self.start = np.array([key(p) for p in self.piece], dtype=np.uint64)
        self.tail = np.array([key(p[-8:]) for p in self.piece], dtype=np.uint64)
        self.item = np.array([r[1] for r in rows], dtype=np.int64)
        self.before = np.array([r[2] for r in rows], dtype=np.int64)
        self.before_bytes = np.array([len(items[r[1]].text[: r[2]].encode()) for r in rows], dtype=np.int64)
        self.slack = np.array([4 * it.budget for it in items], dtype=np.int64)
        self.size = np.array([len(it.text.encode()) for it in items], dtype=np.int64)
        # an edit takes away 3 of an item's byte 4-grams and one more for each byte of the character
        self.need = np.array([n - 3 - (3 + max(len(c.encode()) for c in set(it.text))) * it.budget for it, n in zip(items, self.size.tolist(), strict=True)], dtype=np.int64)
        self.grams = np.zeros(1 << _GRAM_BITS, dtype=bool)
        for k, it in enumerate(items):
            b = np.frombuffer(it.text.encode(), dtype=np.uint8).astype(np.uint64)
            self.grams[self._gram(b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24), k)] = True
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        with np.errstate(over="ignore"):
            self.bitmap[(self.head * _MULT) >> np.uint64(64 - _BITS)] = True

    @staticmethod
    def _gram(gram: np.ndarray, item) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((gram + (np.asarray(item).astype(np.uint64) << np.uint64(32))) * _MULT) >> np.uint64(64 - _GRAM_BITS)

    def alike(self, b4: np.ndarray, off: np.ndarray, doc: np.ndarray, pos: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Hits around which enough of the item's 4-grams stand for a match within the budget; collisions only let more pass."""
        item = self.item[piece]
        at = pos - self.before_bytes[piece]
        a = np.maximum(off[doc], at - self.slack[item])
        n = np.maximum(np.minimum(off[doc + 1], at + self.size[item] + self.slack[item]) - 3 - a, 0)
        ok = np.zeros(len(pos), dtype=bool)
        ends = np.cumsum(n)
        i = 0
        while i < len(pos):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), side="right")))
            m = n[i:j]
            total = np.concatenate(([0], np.cumsum(m)))
            idx = np.repeat(a[i:j] - total[:-1], m) + np.arange(total[-1])
            found = np.concatenate(([0], np.cumsum(self.grams[self._gram(b4[idx].astype(np.uint64), np.repeat(item[i:j], m))])))
            ok[i:j] = found[total[1:]] - found[total[:-1]] >= self.need[item[i:j]]
            i = j
        return ok

    def hits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, position and piece number of every exact piece hit in documents laid end to end."""
        none = np.zeros(0, dtype=np.int64)
        if len(data) < self.q or not len(self.head):
            return none, none, none
        d = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        b2 = d[:-1].astype(np.uint16) | d[1:].astype(np.uint16) << 8
        b4 = b2[:-2].astype(np.uint32) | b2[2:].astype(np.uint32) << 16
        b8 = b4[:-4].astype(np.uint64) | b4[4:].astype(np.uint64) << np.uint64(32)
        with np.errstate(over="ignore"):
            pos = np.flatnonzero(self.bitmap[((b8 & self.mask) * _MULT) >> np.uint64(64 - _BITS)])
        keys = b8[pos] & self.mask
        lo, hi = np.searchsorted(self.head, keys, "left"), np.searchsorted(self.head, keys, "right")
        n = hi - lo
        pos, piece = np.repeat(pos, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.searchsorted(off, pos, side="right") - 1
        size = self.length[piece]
        ok = pos + size <= off[doc + 1]
        long = ok & (size >= 8)
        ok[long] = b8[(pos + size - 8)[long]] == self.tail[piece[long]]
        short = np.minimum(size, 8).astype(np.uint64)
        ok &= (b8[pos] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))) == self.start[piece]
        # two windows of 8 bytes cover pieces of up to 16; longer ones are compared whole
        for i in np.flatnonzero(ok & (size > 16)):
            ok[i] = data[pos[i] : pos[i] + size[i]].tobytes() == self.piece[piece[i]]
        doc, pos, piece = doc[ok], pos[ok], piece[ok]
        ok = self.alike(b4, off, doc, pos, piece)
        return doc[ok], pos[ok], piece[ok]

    def matches(self, column) -> Iterator[tuple[int, int, int, int, int]]:
        """Row, item number, distance, and start and end in code points of the row's text, of the best match of each pair."""
        raw, offsets = string_buffers(column)
        for i, j in runs(offsets):
            data, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            data = lower_table()[data]
            data = np.where((data >= 9) & (data <= 13), np.uint8(32), data)
            first = np.zeros(len(data) + 1, dtype=bool)
            first[off] = True
            keep = np.ones(len(data), dtype=bool)
            keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
            keep[(data == 32) & first[:-1]] = False
            source = np.flatnonzero(keep)
            flat, foff = data[keep], np.searchsorted(source, off)
            doc, pos, piece = self.hits(flat, foff)
            if not len(doc):
                continue
            item = self.item[piece]
            order = np.lexsort((pos, item, doc))
            doc, pos, piece, item = doc[order], pos[order], piece[order], item[order]
            cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
            text, chars, at = "", np.zeros(0), -1
            for g in np.split(np.arange(len(doc)), cuts):
                d, it = int(doc[g[0]]), self.items[int(item[g[0]])]
                if d != at:
                    own = flat[foff[d] : foff[d + 1]]
                    text, chars, at = own.tobytes().decode("utf-8", "replace"), np.cumsum((own & 0xC0) != 0x80), d
                m, k = len(it.text), it.budget
                start = chars[pos[g] - foff[d]] - 1 - self.before[piece[g]]
                best, lo, hi = None, -1, -1
                spans = []
                if m < WORD and not k:
                    best, lo, hi = next(((0, s, s + m) for s in np.unique(start).tolist() if it.whole(text, s)), (None, -1, -1))
                    start = start[:0]
                for s in np.unique(start).tolist():
                    a, b = max(0, s - k), min(len(text), s + m + k)
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                for a, b in spans:
                    # a window never needs to be cut: overlapping ones are one scan
                    if (got := best_match(it, text[a:b])) and (best is None or got[0] < best):
                        best, lo, hi = got[0], a + got[1], a + got[2]
                if best is not None:
                    byte = np.flatnonzero((flat[foff[d] : foff[d + 1]] & 0xC0) != 0x80)
                    src = source[foff[d] : foff[d + 1]]
                    b0, b1 = src[byte[lo]] if lo < len(byte) else off[d + 1], src[byte[hi - 1]] if hi else off[d]
                    before = int(((data[off[d] : b0] & 0xC0) != 0x80).sum())
                    yield i + d, int(item[g[0]]), best, before, before + int(((data[b0 : b1 + 1] & 0xC0) != 0x80).sum())


def _indexes(items: list[Item]) -> list[Index]:
    """Items whose shortest pieces are of one length share an index: a short item does not shorten the keys of the others."""
    by: dict[int, list[Item]] = {}
    for it in items:
        by.setdefault(it.shortest, []).append(it)
    return [Index(x) for _, x in sorted(by.items())]


def _blocks(benchmark: DataFrame, ratio: float, block_chars: int) -> Iterator[list[Item]]:
    """Items in blocks of about `block_chars` characters, which bounds what the driver and each worker hold."""
    held: list[Item] = []
    size = 0
    for r in benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if text := normal(r.text):
            held.append(Item(r.item_id, text, int(ratio * len(text))))
            size += len(text)
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """Benchmark items found in documents within an edit distance of `ratio` of the item's length.

    Both sides are compared with A-Z in lower case and white space runs as one space.  Each pair of a row and an item that
    match has one row: doc_id, item_id (both of the tables' own types), distance, budget, match_start and match_end (code
    points of the document's text, of the best match).  Items of every length are searched; those without an error to
    spare have one piece, and those of fewer than 10 characters must also stand as whole words.  Null and blank items
    match nothing; items that repeat an id with another text match each on its own; null and empty documents match
    nothing; repeated rows match each.  The items go to the workers in blocks of bounded size, and every block is held
    against all documents; with more than one block each block's rows are written before the next is sent.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), *(T.StructField(k, T.LongType()) for k in ("distance", "budget", "match_start", "match_end"))])
    item_type = to_arrow_type(schema["item_id"].dataType)
    out, last, ws = spark.createDataFrame([], schema), None, None
    for block in _blocks(benchmark, ratio, block_chars):
        if last is not None:
            ws = ws or Workspace(spark, "leaks")
            out = out.union(ws.table(last[0], "found"))
            last[1].unpersist()
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = _indexes(shared.value)
            for batch in batches:
                for index in indexes:
                    rows = list(index.matches(batch.column(1)))
                    ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                    item = [index.items[r[1]] for r in rows]
                    more = [[x.budget for x in item] if k < 0 else [r[k] for r in rows] for k in (2, -1, 3, 4)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x.item_id for x in item], item_type), *(pa.array(x, pa.int64()) for x in more)], ["doc_id", "item_id", "distance", "budget", "match_start", "match_end"])

        last = docs.select("doc_id", "text").mapInArrow(run, schema), shared
    return out if last is None else last[0] if ws is None else out.union(ws.table(last[0], "found"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """The documents in which `find_leaks` finds nothing, with all their columns and without a shuffle.  With more than one
    block of items what each block leaves is written before the next is sent, so a worker holds one block."""
    at, last, ws = docs.columns.index("text"), None, None
    for block in _blocks(benchmark, ratio, block_chars):
        if last is not None:
            ws = ws or Workspace(docs.sparkSession, "leaks")
            docs = ws.table(docs, "left")
            last.unpersist()
        last = shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = _indexes(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for index in indexes:
                    keep[[r[0] for r in index.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
