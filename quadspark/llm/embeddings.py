"""Embedding near-dedup: sorted projections, counts of query-centred window collisions, and exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, as_long, components, groups_of
from .textops import mix64, seeded

CHUNK = 1024  # rows of a block of a cell
STEPS = 24  # steps of 1 in which a projection on a line is kept, as a byte


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


@dataclass(frozen=True)
class Tables:
    """Parameters of the projections for a least cosine.

    Two unit vectors at distance r differ by a normal variate of deviation r along a Gaussian direction.  A table sorts the
    vectors along one of `lines` projections, within cells of width `width` of `k` further ones; a pair meets in it if it
    shares the cell and each lies in the other's window of half width `window` in the sorted order.  `tables` is how many
    keep the chance that a pair at the least cosine meets in none of them under `miss`; a pair that meets is verified if it
    falls into each other's window on `count` of all the lines, which such a pair reaches but for a chance of `miss`.
    """

    cosine: float
    k: int
    miss: float = 1e-5
    lines: int = 24
    seed: int = 17

    @property
    def radius(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def width(self) -> float:
        return 8 * self.radius

    @property
    def hit(self) -> float:
        """Chance that a pair at the least cosine falls into each other's window on a line."""
        return 2 * _normal(2.5) - 1

    @property
    def tables(self) -> int:
        meet = self.same_cell(self.radius) ** self.k * self.hit
        return max(1, math.ceil(math.log(self.miss) / math.log(1 - meet)))

    def same_cell(self, r: float) -> float:
        """Chance that points at distance r share a cell of a randomly shifted grid along one direction."""
        c = self.width / r
        return 1 - 2 * _normal(-c) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))

    @property
    def window(self) -> int:
        """Half width in steps, one more for rounding."""
        return math.floor(2.5 * self.radius * STEPS) + 1

    @property
    def count(self) -> int:
        tail = 0.0
        for x in range(self.lines + 1):
            tail += math.comb(self.lines, x) * self.hit**x * (1 - self.hit) ** (self.lines - x)
            if tail > self.miss:
                return x
        return self.lines

    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, dim])
        return rng.standard_normal((dim, self.tables * self.k)), rng.uniform(0, self.width, self.tables * self.k), rng.standard_normal((dim, self.lines))

    def project(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors: the hash of the cell in each table, and the places on the lines in steps."""
        a, shift, lines = self.directions(u.shape[1])
        cells = np.floor((u @ a + shift) / self.width).astype(np.int64).reshape(len(u), self.tables, self.k)
        with np.errstate(over="ignore"):
            key = mix64((mix64(cells.view(np.uint64) ^ seeded(19, self.k)) * seeded(23, self.k)).sum(axis=2, dtype=np.uint64) ^ seeded(29 + u.shape[1], self.tables))
        return key, np.clip(np.rint(u @ lines * STEPS), -127, 127).astype(np.int16)

    def met(self, tab: int, places: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of two lists of rows that share a cell: those in each other's window of the table's sorted line with
        collisions on enough lines.  With one list given twice each pair comes once."""
        q, w, own = places, self.window, tab % self.lines
        same = one is two
        two = two[np.argsort(q[two, own], kind="stable")]
        one = two if same else one
        line = q[two, own]
        lo = np.arange(1, len(two) + 1) if same else np.searchsorted(line, q[one, own] - w)
        n = np.maximum(np.searchsorted(line, q[one, own] + w, side="right") - lo, 0)
        i = np.repeat(one, n)
        j = two[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)]
        apart, most = np.zeros(len(i), dtype=np.int8), self.lines - self.count
        for x in range(self.lines):
            if x != own:
                apart += np.abs(q[i, x] - q[j, x]) > w
                if x % 3 == 2:
                    keep = apart <= most
                    i, j, apart = i[keep], j[keep], apart[keep]
        keep = apart <= most
        return i[keep], j[keep]

    @staticmethod
    def for_rows(rows: int, cosine: float, cell: int = 2048) -> Tables:
        """As many projections a key as leave about `cell` of `rows` unrelated vectors in a cell, two at least."""
        one = Tables(cosine, 1)
        far = one.same_cell(math.sqrt(2))
        return Tables(cosine, max(2, math.ceil(math.log(max(rows, 1) / cell) / math.log(1 / far))))


def _rows(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(dtype))
            first = np.concatenate(([0], np.cumsum(size)))
            per_row = lambda x, first=first: (y := np.concatenate(([0], np.cumsum(x))))[first[1:]] - y[first[:-1]]
            ok = (size > 0) & (per_row(~np.isfinite(flat)) == 0) & (per_row(flat != 0) > 0)
            at = np.arange(len(flat)) - np.repeat(first[:-1], size)
            bits = flat.view("<u4" if dtype == "<f4" else "<u8").astype(np.uint64)
            salt = [seeded(s, int(size.max(initial=0)) + 1) for s in (31, 37)]
            with np.errstate(over="ignore"):  # a vector's digest: two sums of differently mixed components (128 bits)
                d = [(per_row(mix64(mix64(bits + s[at]) ^ s[at])) + s[size]).view(np.int64) for s in salt]
            width = np.dtype(dtype).itemsize
            raw = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.ascontiguousarray(first * width)), pa.py_buffer(flat)]).cast(pa.binary())
            raw = pc.if_else(pa.array(ok), raw, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(d[0]), pa.array(d[1]), raw], ["vec_id", "label", "d1", "d2", "vec"])

    return run


def _unit(raw: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and scaled to length 1 (by their largest component first, against overflow)."""
    v = np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1).astype(np.float64)
    u = v / np.abs(v).max(axis=1, keepdims=True)
    return v, u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def _by_size(raw: list[bytes]) -> Iterator[np.ndarray]:
    size = np.array([len(x) for x in raw])
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def _keyed(key: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Keys of a table's cells: vectors of different labels never share one."""
    return mix64(key ^ mix64(label.astype(np.int64).view(np.uint64))[:, None]).view(np.int64)


def _places(t: Tables, dtype: str):
    """For each class and table the cell's key and the class's places on the lines: what is sorted and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            for rows in _by_size(raw):
                _, u = _unit([raw[i] for i in rows], dtype)
                key, q = t.project(u)
                pick = pa.array(np.repeat(rows, t.tables))
                key = _keyed(key, batch.column(2).to_numpy()[rows])
                line = [x.tobytes() for x in q.astype(np.int8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(np.tile(np.arange(t.tables, dtype=np.int32), len(rows))), pa.array(key.reshape(-1)), pa.array(line, pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), t.tables)))],
                    ["cid", "d1", "tab", "key", "places"],
                )

    return run, "cid long, d1 long, tab int, key long, places binary"


BLOCK = ["key", "left", "right"]


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block's two chunks (0: left, 1: right, 2: of a chunk against itself)."""
    one = np.flatnonzero(side != 1)
    return one, one if (side == 2).any() else np.flatnonzero(side != 0)


def _candidates(t: Tables):
    """Of each block the rows that have a candidate in it: ids, no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, BLOCK):
            q = np.frombuffer(b"".join(g["places"]), dtype=np.int8).reshape(len(g["cid"]), -1).astype(np.int16)
            one, two = _sides(g["side"])
            if not len(one) or not len(two):
                continue
            own = np.unique(np.concatenate(t.met(int(g["tab"][0]), q, one, two)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(g[k][own]) for k in (*BLOCK, "side", "tab", "cid", "d1")], [*BLOCK, "side", "tab", "cid", "d1"])

    return run, "key long, left int, right int, side int, tab int, cid long, d1 long"


def _verified(t: Tables, dtype: str):
    """Links of each block by exact cosines: of each class the number of rows it is linked with, and the least id reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, BLOCK):
            tab = int(g["tab"][0])
            for rows in _by_size(g["vec"]):
                v, u = _unit([g["vec"][i] for i in rows], dtype)
                key, q = t.project(u)
                label, cid, d1, w = (g[k][rows] for k in ("label", "cid", "d1", "weight"))
                here = _keyed(key, label)[:, tab] == g["key"][rows]  # not so where only an id clashes
                one, two = _sides(g["side"][rows])
                same = one is two
                one = one[here[one]]
                two = one if same else two[here[two]]
                if not len(one) or not len(two):
                    continue
                i, j = t.met(tab, q, one, two)
                keep = (label[i] == label[j]) & ((cid[i] != cid[j]) | (d1[i] != d1[j]))
                for x in range(tab):  # a pair counts in the first table that it meets in
                    keep &= (key[i, x] != key[j, x]) | (np.abs(q[i, x % t.lines] - q[j, x % t.lines]) > t.window)
                i, j = i[keep], j[keep]
                ok = np.zeros(len(i), dtype=bool)
                for at in range(0, len(i), 1 << 15):
                    part = slice(at, at + (1 << 15))
                    a, b = v[i[part]], v[j[part]]
                    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
                    ok[part] = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)) >= t.cosine
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                links = np.bincount(i, w[j], len(rows)).astype(np.int64) + np.bincount(j, w[i], len(rows)).astype(np.int64)
                root = cid.copy()
                while True:
                    old = root.copy()
                    np.minimum.at(root, i, root[j])
                    np.minimum.at(root, j, root[i])
                    if (root == old).all():
                        break
                own = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (cid, d1, label, links, root)], ["cid", "d1", "label", "links", "root"])

    return run, "cid long, d1 long, label long, links long, root long"


def near_duplicate_vectors(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of vectors with equal labels and a cosine of at least `cosine`, and the components they make.

    Returns vec_id, n_links (other rows linked directly), component_id (least id that links reach, itself included) and kept
    for each row.  Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link
    with nothing, nor do vectors of different dimensions; a row with a null id has no links, a null component and is kept.  Rows
    that repeat a vector are other rows, linked with each other; an id that repeats with other vectors is one node of the
    components, each of its vectors with links of its own.  Ids are cast to long (those that can't be are null).

    1. Equal vectors of a label become one class with a weight.
    2. Each table sorts the classes along a projection, within cells of a few more.  What is dealt out is an id and a byte
       for each line; in blocks of at most two chunks of a cell, the collisions of query-centred windows are counted for
       each pair, and the ids that have a pair with enough of them go on.
    3. Their vectors are fetched into the same blocks, pairs that met in an earlier table are left to it, and exact cosines
       decide.  Counts and roots, not pairs, leave a block.
    """
    ws = Workspace(rows.sparkSession, "vectors")
    dtype = "<f4" if isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    vector = F.col(vector_col) if dtype == "<f4" else F.col(vector_col).cast("array<double>")
    base = rows.select(as_long(rows, id_col).alias("vec_id"), F.xxhash64(label_col).alias("hash"), F.col(label_col).cast("string").alias("named"), vector.alias("v"))
    # labels of any type: their number is the hash of a label that is not null
    base = base.select("vec_id", F.when(F.col("named").isNotNull(), F.col("hash")).alias("label"), "v")
    base = ws.table(base.mapInArrow(_rows(dtype), "vec_id long, label long, d1 long, d2 long, vec binary"), "rows")
    able = base.where("vec_id is not null and label is not null and vec is not null")
    classes = able.groupBy("label", "d1", "d2").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"))
    classes = ws.table(classes, "classes")
    t = Tables.for_rows(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0, cosine)
    keyed = ws.table(classes.select("cid", "d1", "label", "vec").mapInArrow(*_places(t, dtype)), "places")
    cells = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = ws.table(cells.select(F.col("key").alias("k"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "cells")
    met = keyed.join(cells, F.col("key") == F.col("k"))
    own = F.pmod(F.xxhash64("cid", "d1"), "chunks").cast("int")
    cell = lambda a, b, s: F.struct(a.cast("int").alias("left"), b.cast("int").alias("right"), s.cast("int").alias("side"))
    upto = F.sequence(F.lit(0), F.col("chunks") - 1)
    at = F.transform(upto, lambda i: F.when(i < own, cell(i, own, F.lit(1))).otherwise(cell(own, i, F.when(i == own, 2).otherwise(0))))
    met = met.withColumn("at", F.explode(at)).select("cid", "d1", "tab", "key", "places", "at.*")
    met = met.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    some = ws.table(met.mapInArrow(*_candidates(t)), "candidates")
    full = some.join(classes.select("cid", "d1", "label", "weight", "vec"), ["cid", "d1"])
    full = full.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    found = ws.table(full.mapInArrow(*_verified(t, dtype)), "links")
    comp = components(ws, found.select("cid", "root").distinct(), "cid", "root")
    links = found.groupBy(F.col("cid").alias("i"), F.col("d1").alias("e"), F.col("label").alias("m")).agg(F.sum("links").alias("links"))
    c = classes.select("cid", "weight", F.col("label").alias("l"), F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    per_class = c.join(links, (F.col("cid") == F.col("i")) & (F.col("e1") == F.col("e")) & (F.col("l") == F.col("m")), "left").join(comp, F.col("cid") == F.col("id"), "left")
    per_class = ws.table(per_class.select("l", "e1", "e2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "cid").alias("component_id")), "results")
    ws.clear("rows", "results")
    usable = F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
    same = (F.col("label") == F.col("l")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    out = base.select("vec_id", "label", "d1", "d2", usable.alias("ok")).join(per_class, same & F.col("ok"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
