"""Tile sets: covering tiles, subtrees, containment, overlap with datasets and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid, children

LIMIT = 1_000_000_000  # tiles of one bounds and zoom


def covering_tiles(bounds: DataFrame, grid: Grid, zooms: tuple[int, int], keep: tuple[str, ...] = (), deal: bool = False) -> DataFrame:
    """All tiles of the zooms (both included) that cover each row's xmin, ymin, xmax and ymax; `keep` columns stay.

    `deal` spreads the tile rows of few large bounds over many tasks before their tiles are listed.  More than a thousand million tiles for one row and zoom is an error.
    """
    z = bounds.select("*", F.explode(F.sequence(F.lit(zooms[0]), F.lit(zooms[1]))).alias("zoom"))
    x0, y0, x1, y1 = grid.covering(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("zoom"))
    r = z.select(*keep, "zoom", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    few = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) <= LIMIT
    r = r.withColumn("x1", F.when(few, F.col("x1")).otherwise(F.raise_error(F.lit("too many tiles"))))
    r = r.select(*keep, "zoom", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y"))
    r = r.repartition("zoom", "y") if deal else r
    return r.select(*keep, "zoom", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def subtree(spark: SparkSession, zoom: int, x: int, y: int, target: int) -> DataFrame:
    """A tile and all tiles below it down to the target zoom."""
    out = spark.range(zoom, target + 1).select(F.col("id").cast("int").alias("zoom"), F.expr(f"1L << (id - {zoom})").alias("n"))
    out = out.select("zoom", "n", F.explode(F.sequence(F.lit(y) * F.col("n"), F.lit(y + 1) * F.col("n") - 1)).alias("y"))
    out = out.repartition("zoom", "y")  # the rows of a level, the root of its tiles in number, are expanded by many tasks
    return out.select("zoom", F.explode(F.sequence(F.lit(x) * F.col("n"), F.lit(x + 1) * F.col("n") - 1)).alias("x"), "y")


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two bounds share more than an edge."""
    return (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"]) & (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"])


def child_tiles(tiles: DataFrame, grid: Grid, bounds: dict[str, Column] | None = None) -> DataFrame:
    """The children of each tile, those alone that overlap the bounds if any are given."""
    c = tiles.select(F.explode(children(F.col("zoom"), F.col("x"), F.col("y"))).alias("c")).select("c.*")
    return c.where(overlaps(grid.bounds(F.col("zoom"), F.col("x"), F.col("y")), bounds)) if bounds else c


def encompassing_tile(bounds: DataFrame, grid: Grid, max_zoom: int = 23) -> DataFrame:
    """Adds zoom, x and y of the smallest tile that contains each row's bounds; null if no tile does.

    The tiles of two corners are compared on all zooms at once; an upper bound on a tile's edge still belongs to it.
    """

    def at(z: Column) -> Column:
        x0, y0, x1, y1 = grid.covering(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), z)
        return F.struct(z.cast("int").alias("zoom"), x0.alias("x"), y0.alias("y"), F.coalesce((x0 == x1) & (y0 == y1), F.lit(False)).alias("one"))

    each = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_zoom)), at), lambda s: s["one"])
    return bounds.withColumn("t", F.try_element_at(each, F.lit(-1))).select("*", "t.zoom", "t.x", "t.y").drop("t")


def largest_contained_tile(bounds: DataFrame, grid: Grid, max_zoom: int = 23) -> DataFrame:
    """Adds zoom, x and y of the largest tile that lies within each row's bounds (of several, the most south-western row first).

    On each zoom the first whole tile in each direction is known in closed form; no tiles are listed.
    """

    def at(z: Column) -> Column:
        size = grid.resolution(z) * grid.pixels
        x = F.ceil((F.col("xmin") + grid.half_width) / size - 1e-9).cast("long")
        y = F.ceil((F.col("ymin") + grid.half_height) / size - 1e-9).cast("long")
        fits = ((x + 1) * size - grid.half_width <= F.col("xmax") + size * 1e-9) & ((y + 1) * size - grid.half_height <= F.col("ymax") + size * 1e-9)
        return F.struct(z.cast("int").alias("zoom"), x.alias("x"), y.alias("y"), fits.alias("fits"))

    each = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_zoom)), at), lambda s: s["fits"])
    return bounds.withColumn("t", F.try_element_at(each, F.lit(1))).select("*", "t.zoom", "t.x", "t.y").drop("t")


def tiles_of_datasets(datasets: DataFrame, tiles: DataFrame, grid: Grid, zoom: int) -> DataFrame:
    """Pairs of datasets (with bounds) and tiles that overlap.

    Both sides are keyed by the covering tiles of one zoom, so the join is an equi-join; tiles of finer zooms have one key
    (their ancestor), coarser ones are listed down to it.  The exact test follows and repeated pairs are dropped.
    """
    d = covering_tiles(datasets, grid, (zoom, zoom), keep=tuple(datasets.columns)).select(*datasets.columns, F.col("x").alias("kx"), F.col("y").alias("ky"))
    up = F.greatest(F.col("zoom") - zoom, F.lit(0))
    down = F.greatest(F.lit(zoom) - F.col("zoom"), F.lit(0))
    n = F.pow(F.lit(2), down).cast("long")
    base = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), up)).cast("long") * n
    t = tiles.select("*", F.explode(F.sequence(base("x"), base("x") + n - 1)).alias("kx"))
    t = t.select("*", F.explode(F.sequence(base("y"), base("y") + n - 1)).alias("ky"))
    own = grid.bounds(F.col("zoom"), F.col("x"), F.col("y"))
    both = d.join(t, ["kx", "ky"]).where(overlaps(own, {k: F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")}))
    return both.drop("kx", "ky").dropDuplicates()


def missing_outputs(work: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Tiles of a work list without an output yet, or all of them by force."""
    return work if force else work.join(existing.select("zoom", "x", "y").distinct(), ["zoom", "x", "y"], "left_anti")
