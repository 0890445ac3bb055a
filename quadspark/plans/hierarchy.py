"""Work lists and bottom-up builds of a hierarchy of tile meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid, parent, slippy_y, tile_url
from ..operators import local, mesh, raster, tiles


def build_list(spark: SparkSession, root: tuple[int, int, int], target: int, existing: DataFrame | None = None, intermediate: bool = False, force: bool = False) -> DataFrame:
    """Tiles to build below a root: those of the target zoom, or of all zooms, that have no output yet."""
    work = tiles.subtree(spark, *root, target)
    work = work if intermediate else work.where(F.col("zoom") == target)
    return work if existing is None else tiles.missing_outputs(work, existing, force)


def merge_list(existing: DataFrame, root: tuple[int, int, int], max_zoom: int, force: bool = False) -> DataFrame:
    """Merges to do, finest first: a parent (zoom, x, y) with the children that exist or will, and its tolerated error.

    A parent that exists is left out unless forced; its level is `zoom`, so all merges of one level can run at once.
    """
    from ..functions.grid import target_error

    z0, x0, y0 = root
    under = lambda c, v: F.floor(F.col(c) / F.pow(F.lit(2), F.col("zoom") - z0)) == v
    own = mesh.written(existing.select("zoom", "x", "y").where(F.col("zoom").between(z0, max_zoom)).where(under("x", x0) & under("y", y0)).distinct(), "tiles")
    out, below = None, own.where(F.col("zoom") == max_zoom)
    for z in range(max_zoom - 1, z0 - 1, -1):
        up = below.groupBy(F.lit(z).alias("zoom"), parent(F.col("x")).alias("x"), parent(F.col("y")).alias("y")).agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("children"))
        here = own.where(F.col("zoom") == z)
        todo = up if force else up.join(here, ["zoom", "x", "y"], "left_anti")
        out = todo if out is None else out.unionByName(todo)
        below = up.select("zoom", "x", "y").unionByName(here).distinct()
    if out is None:
        out = own.select("zoom", "x", "y", F.array().cast("array<struct<y:bigint,x:bigint>>").alias("children")).limit(0)
    return out.withColumn("max_error", target_error(F.col("zoom")))


def download_list(spark: SparkSession, roots: DataFrame, max_zoom: int, template: str, existing: DataFrame | None = None, ext: str = ".jpeg") -> DataFrame:
    """zoom, x, y (from the north), url and path of all tiles of the roots (zoom, x, y from the south) down to a zoom that do
    not exist yet.  Fetching is left to a tool with a network: `write_files` takes what it gives."""
    k = F.explode(F.sequence(F.lit(0), F.lit(max_zoom) - F.col("zoom"))).alias("k")
    t = roots.select("*", k).withColumn("n", F.pow(F.lit(2), F.col("k")).cast("long"))
    t = t.select((F.col("zoom") + F.col("k")).cast("int").alias("zoom"), "n", "x", F.explode(F.sequence(F.col("y") * F.col("n"), (F.col("y") + 1) * F.col("n") - 1)).alias("ty"))
    t = t.select("zoom", F.explode(F.sequence(F.col("x") * F.col("n"), (F.col("x") + 1) * F.col("n") - 1)).alias("x"), F.col("ty").alias("y")).distinct()
    if existing is not None:
        t = tiles.missing_outputs(t, existing)
    y = slippy_y(F.col("zoom"), F.col("y"))
    path = F.concat(F.col("zoom").cast("string"), F.lit("/"), y.cast("string"), F.lit("/"), F.col("x").cast("string"), F.lit(ext))
    return t.select("zoom", "x", y.alias("y"), tile_url(template, F.col("zoom"), F.col("x"), y, ext).alias("url"), path.alias("path"))


def convert_list(sources: DataFrame, existing: DataFrame, suffix: str = ".glb") -> DataFrame:
    """Files (name, path) that have no converted file of the same name yet, with its path."""
    return sources.join(existing.select("name").distinct(), "name", "left_anti").withColumn("target", F.concat("name", F.lit(suffix)))


def leaf_meshes(pixels: DataFrame, zoom: int, tile_size: int) -> tuple[DataFrame, DataFrame]:
    """Full-resolution meshes of square tiles of one raster (row, col, z, row 0 north), one shared pixel row and column beyond
    the tile so that neighbours meet.  mesh_id is y * 2**zoom + x with y from the north; tiles of no whole quad are absent."""
    n = 1 << zoom
    # a pixel on a border goes to each tile that has it
    side = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / tile_size), F.floor((F.col(c) - 1) / tile_size)))
    p = pixels.where("z is not null").select("row", "col", "z", F.explode(side("row")).alias("ty")).select("*", F.explode(side("col")).alias("tx"))
    p = p.where(F.col("tx").between(0, n - 1) & F.col("ty").between(0, n - 1)).select((F.col("ty") * n + F.col("tx")).cast("long").alias("raster_id"), "row", "col", "z")
    q = raster.quads(p)
    w = n * tile_size + 1
    at = F.col("row").cast("long") * w + F.col("col")
    two = F.array(F.struct((at * 2).alias("fid"), at.alias("a"), (at + w).alias("b"), (at + 1).alias("c")), F.struct((at * 2 + 1).alias("fid"), (at + 1).alias("a"), (at + w).alias("b"), (at + w + 1).alias("c")))
    faces = q.select(F.col("raster_id").alias("mesh_id"), F.explode(two).alias("f")).select("mesh_id", "f.*")
    vertices = p.select(F.col("raster_id").alias("mesh_id"), at.alias("vid"), F.col("col").cast("double").alias("x"), (-F.col("row")).cast("double").alias("y"), "z")
    return mesh.renumber(vertices, faces)


def parent_meshes(vertices: DataFrame, faces: DataFrame, zoom: int, ratio: float | None = 0.25, max_error: float | None = None, **conditions: float) -> tuple[DataFrame, DataFrame]:
    """Meshes of the parents of tiles of a zoom: children welded where positions are equal, then simplified with the border kept
    under the conditions of `local.simplify`.

    All parents of the level are merged in one job: the exact weld is a grouping by parent and position."""
    n = 1 << zoom
    tx, ty = F.col("mesh_id") % n, F.floor(F.col("mesh_id") / n)
    up = (F.floor(ty / 2) * (n // 2) + F.floor(tx / 2)).cast("long")
    v = mesh.written(vertices.select(up.alias("p"), "mesh_id", "vid", "x", "y", "z"), "children")
    key = F.struct("mesh_id", "vid")
    first = v.groupBy("p", "x", "y").agg(F.max_by("z", key).alias("z"), F.min(F.col("mesh_id") * F.lit(1 << 32) + F.col("vid")).alias("at"))
    merged = mesh.written(mesh.numbered(first.withColumnRenamed("p", "mesh_id"), "mesh_id", "at", "new", bits=32).select("mesh_id", F.col("new").alias("vid"), "x", "y", "z"), "merged")
    to = v.join(merged.select(F.col("mesh_id").alias("p"), "x", "y", F.col("vid").alias("new")), ["p", "x", "y"]).select("p", "mesh_id", "vid", "new")
    f = faces
    for k in "abc":
        f = f.join(to.select("mesh_id", F.col("vid").alias(k), F.col("new").alias(f"n{k}"), F.col("p").alias(f"p{k}")), ["mesh_id", k])
    f = f.select(F.col("pa").alias("mesh_id"), (F.col("mesh_id") * F.lit(1 << 32) + F.col("fid")).alias("order"), F.col("na").alias("a"), F.col("nb").alias("b"), F.col("nc").alias("c")).where("a <> b and b <> c and a <> c")
    f = mesh.numbered(f, "mesh_id", "order", "fid", bits=32).select("mesh_id", "fid", "a", "b", "c")
    rows = mesh.written(local.simplify_meshes(merged, f, ratio, max_error, **conditions), "simplified")
    v, f = local.split(rows)
    return v.drop("u", "v"), f


def build_hierarchy(pixels: DataFrame, zoom: int, tile_size: int, ratio: float | None = 0.25, errors: dict[int, float] | None = None) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Meshes of every zoom from the leaves to the root; each level is a table in the shared folder.

    `errors` (zoom: distance in the units of the pixels, as `merge_list` gives them in metres) bounds how far a merged surface
    may be from the one it simplifies."""
    v, f = leaf_meshes(pixels, zoom, tile_size)
    out = {zoom: (mesh.written(v, "leaf-v"), mesh.written(f, "leaf-f"))}
    for z in range(zoom, 0, -1):
        within = {} if errors is None or z - 1 not in errors else {"distance": errors[z - 1]}
        out[z - 1] = parent_meshes(*out[z], z, ratio, **within)
    return out


def build_tile(pixels: DataFrame, gt: tuple[float, float, float, float], width: int, grid: Grid, tile: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Reference mesh of one grid tile from a raster in the grid's system."""
    z, x, y = (F.lit(v) for v in tile)
    b = pixels.sparkSession.range(1).select(*[c.alias(k) for k, c in grid.bounds(z, x, y).items()]).first()
    return mesh.reference_mesh(pixels, gt, width, (b.xmin, b.ymin, b.xmax, b.ymax))
