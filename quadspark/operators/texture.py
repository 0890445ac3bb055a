"""Textures from tiles of images: choice of tiles, regions, painting and resizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid, children
from .mesh import written
from .tiles import overlaps


def tiles_to_paint(available: DataFrame, grid: Grid, bounds: tuple[float, float, float, float], root: tuple[int, int, int], max_zoom: int) -> DataFrame:
    """Which available tiles (zoom, x, y) to paint, coarse before fine, for a texture of bounds below a root tile.

    A tile counts as covered if it lies outside the bounds, has an image, or all its children are covered; a tile is painted
    if it has an image and not all its children are covered, or if it lies below such a tile or one without an image.
    Levels go from the finest to the root, each a single aggregation by parent.
    """
    b = dict(zip(("xmin", "ymin", "xmax", "ymax"), map(F.lit, bounds), strict=True))
    inside = overlaps(grid.bounds(F.col("zoom"), F.col("x"), F.col("y")), b)
    z0, x0, y0 = root
    below = (F.col("zoom") >= z0) & (F.col("zoom") <= max_zoom)
    under = lambda c, v: F.floor(F.col(c) / F.pow(F.lit(2), F.col("zoom") - z0)) == v
    have = written(available.select(F.col("zoom").cast("int").alias("zoom"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).where(below & inside & under("x", x0) & under("y", y0)).distinct(), "images")
    full = None  # tiles of the level below whose whole area inside the bounds is covered
    painted = None
    for z in range(max_zoom, z0 - 1, -1):
        level = have.where(F.col("zoom") == z)
        if full is None:
            covered, paint = level.select("zoom", "x", "y"), level
        else:
            parents = full.select(F.lit(z).alias("zoom"), F.floor(F.col("x") / 2).cast("long").alias("x"), F.floor(F.col("y") / 2).cast("long").alias("y"))
            n = parents.groupBy("zoom", "x", "y").agg(F.count(F.lit(1)).alias("n"))
            kids = F.size(F.filter(children(F.col("zoom"), F.col("x"), F.col("y")), lambda c: overlaps(grid.bounds(c["zoom"], c["x"], c["y"]), b)))
            whole = n.where(F.col("n") == kids).select("zoom", "x", "y")
            paint = level.join(whole, ["zoom", "x", "y"], "left_anti")
            covered = written(level.select("zoom", "x", "y").unionByName(whole).distinct(), "covered")
        painted = paint.select("zoom", "x", "y") if painted is None else painted.unionByName(paint.select("zoom", "x", "y"))
        full = covered
    return painted.orderBy("zoom", "y", "x")


def region(grid: Grid, zoom: Column, x: Column, y: Column, bounds: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Pixels of a texture of bounds that a tile fills: left, top, right and bottom, rows counted from the north; may
    reach beyond the texture."""
    t = grid.bounds(zoom, x, y)
    sx, sy = width / (bounds["xmax"] - bounds["xmin"]), height / (bounds["ymax"] - bounds["ymin"])
    return {
        "left": F.rint((t["xmin"] - bounds["xmin"]) * sx).cast("int"),
        "top": F.rint((bounds["ymax"] - t["ymax"]) * sy).cast("int"),
        "right": F.rint((t["xmax"] - bounds["xmin"]) * sx).cast("int"),
        "bottom": F.rint((bounds["ymax"] - t["ymin"]) * sy).cast("int"),
    }


def _weighed(t: DataFrame, keep: list[str], rows: tuple[str, str, str, str], cols: tuple[str, str, str, str]) -> DataFrame:
    """The source pixels (row, col) and weights k of target pixels, bilinear with pixel centres aligned.

    rows and cols name the target's position, the first and end of the target range that the source fills, and the source's
    size; beyond the outer centres the edge's value holds."""
    at = lambda c, lo, hi, n: F.least(F.greatest((F.col(c) - F.col(lo) + 0.5) * F.col(n) / (F.col(hi) - F.col(lo)) - 0.5, F.lit(0.0)), F.col(n) - F.lit(1.0))
    t = t.withColumns({"pv": at(*rows), "pu": at(*cols)})
    fr, fc = F.col("pv") - F.floor("pv"), F.col("pu") - F.floor("pu")
    one = lambda i, j: F.struct((F.floor("pv") + i).cast("int").alias("row"), (F.floor("pu") + j).cast("int").alias("col"), ((fr if i else F.lit(1.0) - fr) * (fc if j else F.lit(1.0) - fc)).alias("k"))
    asks = F.array(*[one(i, j) for i in (0, 1) for j in (0, 1)])
    return t.select(*keep, F.explode(asks).alias("a")).select(*keep, "a.*").where("k > 0")


def paint(regions: DataFrame, pixels: DataFrame, width: int, height: int, bilinear: bool = False) -> DataFrame:
    """Texture pixels (row, col, value) painted by tiles, by the nearest pixel or bilinear between the centres of a tile's own
    pixels; finer tiles over coarser ones.  Bilinear values are of the tiles that win, missing pixels of a tile left out.

    regions: zoom, x, y, left, top, right, bottom, and w and h (the tile image's size); pixels: zoom, x, y, row, col, value.
    """
    r = regions.where((F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")))
    rows = F.sequence(F.greatest("top", F.lit(0)), F.least("bottom", F.lit(height)) - 1)
    cols = F.sequence(F.greatest("left", F.lit(0)), F.least("right", F.lit(width)) - 1)
    seen = (F.least("bottom", F.lit(height)) > F.greatest("top", F.lit(0))) & (F.least("right", F.lit(width)) > F.greatest("left", F.lit(0)))
    t = r.where(seen).select("*", F.explode(rows).alias("tr")).select("*", F.explode(cols).alias("tc"))
    if bilinear:
        top = F.max(F.struct("zoom", "y", "x", "top", "bottom", "left", "right", "w", "h"))
        t = t.join(pixels.select("zoom", "x", "y").distinct(), ["zoom", "x", "y"], "left_semi").groupBy("tr", "tc").agg(top.alias("t")).select("tr", "tc", "t.*")
        each = _weighed(t, ["zoom", "x", "y", "tr", "tc"], ("tr", "top", "bottom", "h"), ("tc", "left", "right", "w")).join(pixels, ["zoom", "x", "y", "row", "col"])
        return each.groupBy(F.col("tr").alias("row"), F.col("tc").alias("col")).agg((F.sum(F.col("value") * F.col("k")) / F.sum("k")).alias("value"))
    near = lambda at, lo, hi, n: F.least(F.floor((F.col(at) - F.col(lo) + 0.5) * F.col(n) / (F.col(hi) - F.col(lo))).cast("int"), F.col(n) - 1)
    t = t.select("zoom", "x", "y", "tr", "tc", near("tr", "top", "bottom", "h").alias("row"), near("tc", "left", "right", "w").alias("col"))
    got = t.join(pixels, ["zoom", "x", "y", "row", "col"])
    return got.groupBy(F.col("tr").alias("row"), F.col("tc").alias("col")).agg(F.max_by("value", F.struct("zoom", "y", "x")).alias("value"))


def _reached(c: str, n: int, m: int) -> Column:
    """The targets t of m pixels of an axis that pixel c of n has a share in, and their weights k, bilinear with pixel centres
    aligned: what `_weighed` says of an axis, from the source's side."""
    at = F.col(c)
    first = F.when(at > 0, F.greatest(F.floor((at - 0.5) * m / n - 0.5), F.lit(0))).otherwise(0).cast("int")
    last = F.when(at < n - 1, F.least(F.ceil((at + 1.5) * m / n - 0.5), F.lit(m - 1))).otherwise(m - 1).cast("int")

    def one(t: Column) -> Column:
        p = F.least(F.greatest((t + 0.5) * n / m - 0.5, F.lit(0.0)), F.lit(n - 1.0))
        part = p - F.floor(p)
        return F.struct(t.alias("t"), F.when(F.floor(p) == at, F.lit(1.0) - part).when(F.floor(p) + 1 == at, part).otherwise(0.0).alias("k"))

    return F.filter(F.transform(F.sequence(first, last), one), lambda s: s["k"] > 0)


def resize(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int], key: str = "image_id") -> DataFrame:
    """Bilinear resize of images (key, row, col, value) of one size (height, width), pixel centres aligned.

    Each pixel is sent to the targets that it has a share in, and one aggregation gathers them: no join, so nothing is broadcast."""
    (h, w), (th, tw) = size, target
    p = pixels.where(F.col("row").between(0, h - 1) & F.col("col").between(0, w - 1))
    p = p.select(key, "col", "value", F.explode(_reached("row", h, th)).alias("r")).select(key, "value", "r", F.explode(_reached("col", w, tw)).alias("c"))
    return p.groupBy(key, F.col("r.t").alias("row"), F.col("c.t").alias("col")).agg(F.sum(F.col("value") * (F.col("r.k") * F.col("c.k"))).alias("value"))


def texture(pixels: DataFrame, grid: Grid, bounds: tuple[float, float, float, float], root: tuple[int, int, int], max_zoom: int, tile: tuple[int, int], size: tuple[int, int], bilinear: bool = False) -> DataFrame:
    """Texture of bounds from tile images (zoom, x, y, row, col, value) of one size: choice, regions and painting."""
    tiles = tiles_to_paint(pixels.select("zoom", "x", "y").distinct(), grid, bounds, root, max_zoom)
    b = dict(zip(("xmin", "ymin", "xmax", "ymax"), map(F.lit, bounds), strict=True))
    at = region(grid, F.col("zoom"), F.col("x"), F.col("y"), b, F.lit(size[1]), F.lit(size[0]))
    r = tiles.select("zoom", "x", "y", *[c.alias(k) for k, c in at.items()], F.lit(tile[1]).alias("w"), F.lit(tile[0]).alias("h"))
    return paint(r, pixels, size[1], size[0], bilinear)
