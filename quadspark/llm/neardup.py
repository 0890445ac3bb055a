"""MinHash near-dedup: fast similarity sketches, banding, and exact verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, as_long, components, groups_of, parallelism
from .sketch import bands, sketch
from .textops import mix64, runs, shingles, string_buffers, words

ROWS = 4  # bins of a band
BANDS = 40  # at a similarity of 0.75 all bands differ with probability (1 - 0.75**4)**40 = 3e-7
COUNTS = 512  # cells over which the shingles of a set are counted
CHUNK = 1024  # rows of a block of a bucket
HOT = 2048  # classes of a bucket beyond which its classes are joined by their rarest shingles instead


def _digests(v: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """128 bits for each set of hashes: two sums of differently mixed ones."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(v ^ np.uint64(x))))) for x in (1, 2)]
        return [(x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums]


def _counts(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of bytes for each set of hashes: its size, and how many of its hashes fall into each cell, modulo 256."""
    size, n = np.diff(first), len(first) - 1
    cell = np.repeat(np.arange(n, dtype=np.int64) * COUNTS, size) + (v % np.uint64(COUNTS)).astype(np.int64)
    count = np.bincount(cell, minlength=n * COUNTS).astype(np.uint8).reshape(n, COUNTS)
    return np.concatenate((size.astype("<i8")[:, None].view(np.uint8), count), axis=1)


def _sizes_and_counts(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    return np.ascontiguousarray(x[:, :8]).view("<i8")[:, 0], x[:, 8:]


def _most(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The largest similarity that sets of these sizes and counts can have.

    Elements of one set alone are at least as many as the counts differ by, so no pair's similarity is above it."""
    apart = np.abs((x - y).view(np.int8)).view(np.uint8).sum(axis=1, dtype=np.int64)
    apart = np.maximum(apart, np.abs(n - m))
    return (n + m - apart) / (n + m + apart)


def _rows(width: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j in runs(off):
                h, _, _, first = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                v, f = shingles(h, first, width)
                keys = bands(sketch(v, f, n_bands * ROWS), ROWS)
                d = _digests(v, f)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(f)), pa.array(d[0]), pa.array(d[1]), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([k.tobytes() for k in _counts(v, f)], pa.binary())],
                    ["doc_id", "text_key", "n", "d1", "d2", "bands", "counts"],
                )

    return run, "doc_id long, text_key long, n long, d1 long, d2 long, bands binary, counts binary"


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = string_buffers(batch.column(1))
            for i, j in runs(off):
                h, _, _, first = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                v, f = shingles(h, first, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, _digests(v, f)), pa.array([v[f[k] : f[k + 1]].tobytes() for k in range(j - i)], pa.binary())], ["id", "d1", "d2", "set"])

    return run, "id long, d1 long, d2 long, set binary"


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.frombuffer(k, dtype=np.int64) for k in batch.column(1).to_pylist()]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), len(keys[0]))), pa.array(np.concatenate(keys))], ["cid", "key"])


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cid, d1, n, key), one for each shingle of sets (id, d1, d2, set)."""
    for batch in batches:
        sets = batch.column(3).to_pylist()
        size = np.array([len(x) // 8 for x in sets], dtype=np.int64)
        for i, j in runs(np.concatenate((np.zeros(1, np.int64), np.cumsum(8 * size)))):
            of = [np.repeat(c[i:j], size[i:j]) for c in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), size)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, of), pa.array(np.frombuffer(b"".join(sets[i:j]), dtype=np.int64))], ["cid", "d1", "n", "key"])


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))  # no copy of a batch's sets
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(den * same >= num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run, "a long, b long"


def _agree(sure: float):
    """Of pairs with their counts, those that can be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                some = batch.slice(k, CHUNK)
                ok = pa.array(_most(*_sizes_and_counts(some.column(2).to_pylist()), *_sizes_and_counts(some.column(3).to_pylist())) >= sure)
                yield pa.RecordBatch.from_arrays([c.filter(ok) for c in some.columns[:2]], ["a", "b"])

    return run, "a long, b long"


def _by_counts(sure: float):
    """Members of a bucket that can be similar enough; its least document was its hub and has met them all."""

    def prepare(g: dict):
        (n, x), met = _sizes_and_counts(g["counts"]), g["cid"] == g["hub"]

        def may(i: int, j: np.ndarray) -> np.ndarray:
            j = j[~met[j] & ~met[i]]
            j = j[np.minimum(n[j], n[i]) / np.maximum(n[j], n[i]) >= sure]
            return j[_most(n[j], x[j], n[i], x[i]) >= sure]

        return may

    return prepare


def _by_rest(num: int, den: int):
    """Members of a shingle whose sets can have enough in common from that shingle on, which is true of a link's first one."""

    def prepare(g: dict):
        n, rest = g["n"], g["rest"]
        return lambda i, j: j[(num + den) * np.minimum(rest[j], rest[i]) >= num * (n[j] + n[i])]

    return prepare


def _blocks(prepare):
    """Pairs of a block in different components that `prepare` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, ["key", "left", "right"]):
            side, cid, comp, may = g["side"], g["cid"], g["comp"], prepare(g)
            one = np.flatnonzero(side != 1)  # side 0: left, 1: right, 2: both
            two = np.flatnonzero(side != 0)
            a, b = [], []
            for i in one:
                j = two[comp[two] != comp[i]]
                j = j[cid[j] > cid[i]] if side[i] == 2 else j
                j = may(i, j) if len(j) else j
                a.append(np.full(len(j), cid[i]))
                b.append(cid[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run, "a long, b long"


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text", sure: float = 1.0, hot: int = HOT, text_key: bool = False) -> DataFrame:
    """Connected components of documents whose sets of `width`-word shingles have den * |A and B| >= num * |A or B|.

    Returns doc_id, n_shingles, component_id (the least doc_id that links reach, itself included) and kept for each row.
    Null texts and texts without words have no shingles and link with nothing.  A null id links with nothing: its component
    is null and it is kept.  Rows that repeat an id are each judged by their own text; sets with the same least id are one node.
    Ids are cast to long; those that can't be count as null.

    1. Equal sets become one class (a partial aggregation by digest).
    2. In each bucket of each band every class is paired with the bucket's least class, its hub.  Pairs are verified on full
       sets but for those that sizes and counts of shingles by cells rule out; links collapse groups of copies in time
       proportional to their size.
    3. What is left in a bucket in different components is compared in blocks of bounded size: the bucket's largest component
       against the rest, and the rest among itself.  No pair leaves a block that counts rule out; the others are verified in
       the same way, and the components are taken over all links.
    4. Classes of a bucket of more than `hot` in different components are joined exactly instead, without bands: shingles are
       put in one order, rare ones first, and the first shingle that two sets share leaves each of them enough to be a link.
       So each class goes to its rarest shingles only, where pairs in different components meet in blocks as in 3, one of
       them at least with enough left for a link of sets of its own size.

    So every pair that shares a band is verified, joined by other links, or proved to be no link.  Pairs are ruled out where
    the counts keep their similarity below `sure`, or below num / den if that is less, so no `sure` loses a link; with 0 none
    is ruled out by counts.  With `text_key` the xxhash64 of a row's text goes along, which tells rows that repeat an id apart.
    """
    sure = min(sure, num / den)
    spark = docs.sparkSession
    ws = Workspace(spark, "neardup")
    texts = docs.select(as_long(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = ws.table(texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(*_rows(width, BANDS)), "rows")
    named = rows.where("n > 0 and doc_id is not null")
    reps = ws.table(named.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"), F.first("counts").alias("counts")), "classes")
    c = reps.select("cid", F.col("d1").alias("e1"), F.col("d2").alias("e2"))

    every = reps.select("cid", "bands").mapInArrow(_explode_bands, "cid long, key long")
    hubs = every.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("top")).where("hub < top").select(F.col("key").alias("of"), "hub")
    hubs = ws.table(hubs, "hubs")
    shared, shared_path = ws.write(every.join(hubs, F.col("key") == F.col("of")).select("cid", "key", "hub"), "shared")
    seen = reps.select(F.col("cid").alias("i"), "counts")

    def agree(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that counts do not rule out."""
        half = pairs.join(seen, F.col("a") == F.col("i")).select("a", "b", F.col("counts").alias("x"))
        return half.join(seen, F.col("b") == F.col("i")).select("a", "b", "x", F.col("counts").alias("y")).mapInArrow(*_agree(sure))

    def sets_of(ids: DataFrame, name: str) -> tuple[DataFrame, str]:
        sets = texts.join(ids, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(*_sets(width))
        # rows that repeat an id and a text are one set
        return ws.write(sets.repartition(parallelism(spark), "id").dropDuplicates(["id", "d1", "d2"]), f"{name}-sets")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that full sets confirm."""
        pairs = ws.table(pairs, f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        sets, path = sets_of(ids, name)
        both = pairs.join(sets.select(F.col("id").alias("i"), F.col("set").alias("x")), F.col("a") == F.col("i"))
        both = both.select("a", "b", "x").join(sets.select(F.col("id").alias("i"), F.col("set").alias("y")), F.col("b") == F.col("i")).select("a", "b", "x", "y")
        out = ws.table(both.mapInArrow(*_verify(num, den)), f"{name}-links")
        ws.drop(path)
        return out

    first = linked(agree(shared.where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()), "star")
    comp = components(ws, first)

    member = shared.join(comp, F.col("cid") == F.col("id"), "left").select("key", "hub", "cid", F.coalesce("component_id", "cid").alias("comp"))
    member, member_path = ws.write(member, "members")
    ws.drop(shared_path)

    def mixed(m: DataFrame, name: str, strong: Column) -> DataFrame:
        """Keys with more than one component and a strong member: the largest component, its members and all, of both the strong ones."""
        n = m.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.count_if(strong).alias("s"))
        of_main = [F.max_by(c, F.struct("m", "comp")).alias(name) for c, name in (("comp", "main"), ("m", "in_main"), ("s", "strong_main"))]
        n = n.groupBy("key").agg(*of_main, F.sum("m").alias("all"), F.sum("s").alias("strong_all"))
        return ws.table(n.where("all > in_main and strong_all > 0").withColumnRenamed("key", "of"), name)

    def placed(m: DataFrame, sizes: DataFrame, strong: Column) -> DataFrame:
        """Members of these keys, once for each block that they are in: of two chunks, one at least strong and not both of the largest component."""
        counts = {"rs": "strong_all - strong_main", "rw": "all - in_main - strong_all + strong_main", "ms": "strong_main", "mw": "in_main - strong_main"}
        sizes = sizes.select("of", "main", *[F.expr(f"cast(ceil(({n}) / {CHUNK}) as int)").alias(k) for k, n in counts.items()])
        # chunks have one number after the other: strong and weak ones of the rest, strong and weak ones of the largest component
        split = m.join(sizes, F.col("key") == F.col("of")).withColumns({"in_main": F.col("comp") == F.col("main"), "strong": strong})
        kind = lambda rs, rw, ms, mw: F.when(F.col("in_main"), F.when(F.col("strong"), ms).otherwise(mw)).otherwise(F.when(F.col("strong"), rs).otherwise(rw))
        of_rest = F.col("rs") + F.col("rw")
        first_of = kind(F.lit(0), F.col("rs"), of_rest, of_rest + F.col("ms"))
        split = split.withColumn("chunk", (first_of + F.pmod(F.xxhash64("cid"), kind(*map(F.col, counts)))).cast("int"))
        own = F.col("chunk")
        other = F.sequence(F.lit(0), of_rest + F.col("ms") + F.col("mw") - 1)
        other = F.filter(other, lambda i: ~(F.col("in_main") & (i >= of_rest)) & (F.col("strong") | (i < F.col("rs")) | ((i >= of_rest) & (i < of_rest + F.col("ms")))))
        side = lambda i: F.when(own < i, 0).when(own > i, 1).otherwise(2)
        at = F.transform(other, lambda i: F.struct(F.least(i, own).alias("left"), F.greatest(i, own).alias("right"), side(i).alias("side")))
        # parts of one component are never compared with each other, so only rows of different ones meet in a block
        return split.withColumn("at", F.explode(at)).select(*m.columns, "at.*")

    def met(blocks: DataFrame, prepare) -> DataFrame:
        blocks = blocks.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
        return blocks.mapInArrow(*_blocks(prepare)).distinct()

    sizes = mixed(member, "sizes", F.lit(True))
    cool = ws.table(placed(member, sizes.where(F.col("all") <= hot), F.lit(True)), "placed")
    late = met(cool.join(seen, F.col("cid") == F.col("i")).drop("i"), _by_counts(sure))
    large = sizes.where(F.col("all") > hot).select("of")
    if not large.isEmpty():
        nodes = ws.table(member.join(large, F.col("key") == F.col("of"), "left_semi").select(F.col("cid").alias("id"), "comp").distinct(), "hot")
        sets, sets_path = sets_of(nodes.select("id"), "hot")
        tokens = sets.mapInArrow(_explode_sets, "cid long, d1 long, n long, key long")
        # a shingle of one set alone is in no pair; `rest` counts a set's shingles from this one on, rare ones first
        often = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1").withColumnRenamed("key", "of")
        rest = F.row_number().over(Window.partitionBy("cid", "d1").orderBy(F.desc("f"), "key")).cast("long")
        rare = tokens.join(often, F.col("key") == F.col("of")).withColumn("rest", rest).where(den * F.col("rest") >= num * F.col("n"))
        rare = rare.join(nodes, F.col("cid") == F.col("id")).select("key", "cid", "comp", "n", "rest")
        rare, rare_path = ws.write(rare, "rare")
        ws.drop(sets_path)
        # of a link the smaller set has at least this much left
        strong = (num + den) * F.col("rest") >= 2 * num * F.col("n")
        pairs = ws.table(met(placed(rare, mixed(rare, "rare-sizes", strong), strong), _by_rest(num, den)), "rare-pairs")
        ws.drop(rare_path)
        late = late.union(agree(pairs)).distinct()
    late = linked(late, "rest")
    ws.drop(member_path)
    comp = components(ws, first.union(late))

    same = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    out = rows.select("doc_id", "n", "d1", "d2", "text_key").join(c.withColumnRenamed("cid", "k"), same & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    out = ws.table(out.select("doc_id", "n", "text_key", F.coalesce("k", "doc_id").alias("cid")), "named")
    ws.clear("named", "step")
    out = out.join(comp, F.col("cid") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "cid").alias("component_id"), *(["text_key"] if text_key else []))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
