"""What several corpus operators share: the shared folder, checked inputs, gapless numbering and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from `spark.checkpoint.dir`; where none is named a temporary folder is set once, in local mode only: on a cluster
    no other machine would see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quadspark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def as_long(df: DataFrame, name: str) -> Column:
    """An id column as long: integers by their value, of other types what a lenient cast gives (null where there is none)."""
    return F.expr(f"try_cast(`{name}` as bigint)") if not isinstance(df.schema[name].dataType, T.LongType) else F.col(f"`{name}`")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Workspace:
    """Tables of one operator call in the shared folder.  Written tables cut lineage and survive lost executors; those that
    the result does not read are deleted by `clear`, the rest when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.tables: list[tuple[str, str]] = []

    def new(self, name: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n:02d}-{name}"

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = self.new(name)
        df.write.parquet(path)
        if not self.tables:
            self._on_path(self.path, "deleteOnExit")
        self.tables.append((name, path))
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self.write(df, name)[0]

    def _on_path(self, path: str, method: str, *more) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        getattr(p.getFileSystem(self.spark._jsc.hadoopConfiguration()), method)(p, *more)

    def drop(self, path: str) -> None:
        """Deletes a table that no later step reads."""
        self._on_path(path, "delete", True)

    def clear(self, *keep: str) -> None:
        """Deletes all tables but those of the names that the result reads."""
        for name, path in self.tables:
            if name not in keep:
                self.drop(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, group: list[Column | str], order: list[str], out: str, key: Column, buckets: int) -> DataFrame:
    """Adds `out`: a gapless number from 0 in each group, without bringing a group into one task.

    Rows are dealt into `buckets` by the hash of `key`; they are numbered within (group, bucket), and the running totals of
    the much smaller table of (group, bucket) counts shift each bucket to its place.
    """
    group = [F.col(g) if isinstance(g, str) else g for g in group]
    names = [f"__g{i}" for i in range(len(group))]
    df = df.withColumns({n: g for n, g in zip(names, group, strict=True)} | {"__b": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
    counts = df.groupBy(*names, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    shift = shift.select(*[F.col(n).alias(f"{n}s") for n in names], F.col("__b").alias("__bs"), "__before")
    local = df.withColumn("__r", F.row_number().over(Window.partitionBy(*names, "__b").orderBy(*order)) - 1)
    on = F.col("__b") == F.col("__bs")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}s"))
    return local.join(shift, on).withColumn(out, (F.col("__before") + F.col("__r")).cast("long")).drop(*names, *[f"{n}s" for n in names], "__b", "__bs", "__r", "__before")


def _small_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (u, v) with a part, v < u, sorted by u, part and v: u's least neighbour of each part, and an edge of each other
    neighbour of the part to that one."""
    last, least, before = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v, part = (batch.column(k).to_numpy() for k in range(3))
        new = np.ones(len(u), dtype=bool)
        new[1:] = (u[1:] != u[:-1]) | (part[1:] != part[:-1])
        new[0] = last is None or (u[0], part[0]) != last
        at = np.maximum.accumulate(np.where(new, np.arange(len(u)), -1))
        low = np.where(at >= 0, v[np.maximum(at, 0)], least)
        again = np.zeros(len(u), dtype=bool)
        again[1:] = ~new[1:] & (v[1:] == v[:-1])
        again[0] = not new[0] and v[0] == before
        other = ~new & ~again & (v != low)
        last, least, before = (u[-1], part[-1]), low[-1], v[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((u[new], v[other]))), pa.array(np.concatenate((v[new], low[other]))), pa.array(np.concatenate((np.ones(new.sum(), bool), np.zeros(other.sum(), bool))))], ["u", "v", "own"])


PARTS = 16  # tasks over which the edges of one end are dealt at first


def components(ws: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id of the connected component of every id that has an edge to another: columns id, component_id.

    Each round sorts the edges by their larger end, ties every id to its least neighbour and its other neighbours to that
    one, and then moves every edge on to the least neighbour of its smaller end, which halves the way to the root.  It ends
    when nothing is left to tie or to move; the number of rounds grows with the logarithm of a component's diameter.  An id
    with many edges is tied in parts first, each in a task of its own, then by the parts' least.  The edges of a round are
    tables, so both sides of its join have plain exchanges, which adaptive execution splits at a hub.
    """
    spark = ws.spark
    e, path = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v"), None
    schema = "u long, v long, own boolean"

    def tied(df: DataFrame, part: Column) -> DataFrame:
        return df.select("u", "v", part.cast("long").alias("part")).repartition(parallelism(spark), "u", "part").sortWithinPartitions("u", "part", "v").mapInArrow(_small_star, schema)

    while True:
        ties, moves = Observation(), Observation()
        star, star_path = ws.write(tied(tied(e, F.pmod(F.xxhash64("v"), F.lit(PARTS))), F.lit(0)).observe(ties, F.count_if(~F.col("own")).alias("n")), "star")
        up = star.where("own").select(F.col("u").alias("k"), F.col("v").alias("p"))
        step = star.select("u", "v").join(up, F.col("v") == F.col("k"), "left").select("u", F.coalesce("p", "v").alias("v"), F.col("p").isNotNull().alias("moved"))
        e, new_path = ws.write(step.observe(moves, F.count_if("moved").alias("n")), "step")
        for old in (path, star_path):
            if old:
                ws.drop(old)
        path = new_path
        # one edge for every id, to one that has none: no parts' ties are left either
        if not ties.get.get("n") and not moves.get.get("n"):
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))


def groups_of(batches: Iterator, keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of consecutive rows with equal integer keys, from Arrow batches of rows sorted by them.

    A group may go on in the next batch; numeric columns come as numpy arrays, others as lists.  One group is held at a time.
    """
    held: list[pa.RecordBatch] = []

    def give(parts: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(parts)
        return {k: t[k].to_numpy() if pa.types.is_integer(t.schema.field(k).type) or pa.types.is_floating(t.schema.field(k).type) else t[k].to_pylist() for k in t.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held:
            last = held[-1]
            same = all(last.column(last.schema.get_field_index(k))[last.num_rows - 1].as_py() == c[0] for k, c in zip(keys, cols, strict=True))
            if not same:
                yield give(held)
                held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield give(held)
                held = []
    if held:
        yield give(held)
