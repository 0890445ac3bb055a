"""Rasters as rows (raster_id, row, col, z): row 0 is the northern edge, null is no data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import srs

ID = "raster_id"


def valid_heights(df: DataFrame, z: str = "z", limit: float = 20000.0) -> DataFrame:
    """Rows with a height that is a number within the limit."""
    return df.where(F.col(z).isNotNull() & ~F.isnan(z) & F.col(z).between(-limit, limit))


def no_data_to_null(df: DataFrame, no_data: float | None, z: str = "z") -> DataFrame:
    gone = F.isnan(z) if no_data is None else F.isnan(z) | (F.col(z) == no_data)
    return df.withColumn(z, F.when(~gone, F.col(z)))


def blank(rasters: DataFrame, value: float | None = None) -> DataFrame:
    """All pixels of rasters (raster_id, width, height), filled with one value."""
    r = rasters.select(ID, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    return r.select(ID, "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"), F.lit(value).cast("double").alias("z"))


def crop(df: DataFrame, row0: int, col0: int, rows: int, cols: int) -> DataFrame:
    """A window counted from the upper left corner, clamped to the raster, with its own row and column numbers."""
    inside = F.col("row").between(max(row0, 0), row0 + rows - 1) & F.col("col").between(max(col0, 0), col0 + cols - 1)
    return df.where(inside).withColumns({"row": F.col("row") - max(row0, 0), "col": F.col("col") - max(col0, 0)})


def crop_lower_left(df: DataFrame, height: int, y0: int, x0: int, rows: int, cols: int) -> DataFrame:
    """The same counted from the lower left corner of a raster of the given height."""
    top = height - (y0 + rows)
    return crop(df, top, x0, rows, cols)


def window(df: DataFrame, col0: int, row0: int, col1: int, row1: int) -> DataFrame:
    """Pixels of a half-open pixel window, unshifted; the comparisons reach the scan."""
    return df.where((F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))


def flip(df: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Mirrors columns (given the width) and rows (given the height)."""
    out = df
    if width is not None:
        out = out.withColumn("col", F.lit(width - 1) - F.col("col"))
    if height is not None:
        out = out.withColumn("row", F.lit(height - 1) - F.col("row"))
    return out


def to_points(df: DataFrame, x0: float, y0: float, cell: float, height: int, skip_missing: bool = True) -> DataFrame:
    """Pixels as points; (x0, y0) is the lower left pixel."""
    out = df.where(F.col("z").isNotNull()) if skip_missing else df
    return out.select(ID, (F.lit(x0) + F.col("col") * F.lit(cell)).alias("x"), (F.lit(y0) + (F.lit(height - 1) - F.col("row")) * F.lit(cell)).alias("y"), "z")


def map_pixels(df: DataFrame, f) -> DataFrame:
    return df.withColumn("z", f(F.col("z")))


def downsample(df: DataFrame, factor_rows: int, factor_cols: int, height: int, width: int, compat: bool = False) -> DataFrame:
    """Mean of whole blocks, missing pixels left out; blocks at the far edges that are not whole are cut off.

    `compat`: a block whose sum is not positive counts as missing."""
    whole = (F.col("row") < height // factor_rows * factor_rows) & (F.col("col") < width // factor_cols * factor_cols)
    key = [F.floor(F.col(c) / f).cast("int").alias(c) for c, f in (("row", factor_rows), ("col", factor_cols))]
    z = F.when(F.sum("z") > 0, F.avg("z")) if compat else F.avg("z")
    return df.where(whole).groupBy(ID, *key).agg(z.alias("z"))


def mean_pyramid(df: DataFrame, levels: int) -> DataFrame:
    """Levels 0 to `levels` of 2 x 2 means over what is not missing; a level is made of the one before, which it reads once."""
    out = df.select(F.lit(0).alias("level"), ID, "row", "col", "z")
    level = out
    for k in range(1, levels + 1):
        level = level.groupBy(ID, F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.avg("z").alias("z"))
        level = level.select(F.lit(k).alias("level"), ID, "row", "col", "z")
        out = out.unionByName(level)
    return out


def extent(df: DataFrame) -> DataFrame:
    """Rows, columns and heights that valid pixels span."""
    v = df.where(F.col("z").isNotNull())
    return v.groupBy(ID).agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col", "z") for n, f in (("min", F.min), ("max", F.max))])


def value_count(df: DataFrame, value: float) -> DataFrame:
    return df.groupBy(ID).agg(F.count_if(F.col("z") == value).alias("n"))


def compare(a: DataFrame, b: DataFrame, height: int, width: int, frame: int = 2) -> DataFrame:
    """Pixel by pixel difference of two rasters without a frame at the edges; null where either is missing."""
    inner = F.col("row").between(frame, height - 1 - frame) & F.col("col").between(frame, width - 1 - frame)
    x, y = a.where(inner), b.where(inner).select(ID, "row", "col", F.col("z").alias("z2"))
    return x.join(y, [ID, "row", "col"]).select(ID, "row", "col", (F.col("z") - F.col("z2")).alias("d"))


def error_statistics(difference: DataFrame) -> DataFrame:
    """Count, mean, population deviation, root mean square, mean square and largest absolute value of a difference."""
    d = F.col("d")
    return difference.groupBy(ID).agg(F.count("d").alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.sqrt(F.avg(d * d)).alias("rms"), F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("max_abs"))


def rms_error(difference: DataFrame) -> DataFrame:
    """Root mean square and largest error, where a missing pixel counts as no error."""
    d = F.coalesce("d", F.lit(0.0))
    return difference.groupBy(ID).agg(F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("max_abs"))


def smallest_step(points: DataFrame, axis: str) -> DataFrame:
    """Least, greatest and smallest positive step of the distinct coordinates of an axis.

    Coordinates are first dealt into 1024 equal slices of the axis; steps inside slices and those between the ends of
    neighbouring non-empty slices are all the steps there are, so no task sorts the whole axis.
    """
    v = points.select(F.col(axis).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    slice_ = F.floor((F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * 1024)
    cut = v.distinct().crossJoin(F.broadcast(ends)).withColumn("s", slice_)  # the other side is one row
    inside = cut.withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy("s").orderBy("v")))
    parts = inside.groupBy("s").agg(F.min("d").alias("d"), F.min("v").alias("a"), F.max("v").alias("b"))  # 1025 rows at most
    parts = parts.withColumn("e", F.col("a") - F.lag("b").over(Window.orderBy("s")))
    return parts.agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.min(F.least("d", "e")).alias("step"))


def points_to_raster(points: DataFrame, raster_id: int = 0) -> DataFrame:
    """Raster of points on a regular lattice: the pixel size is the smallest step of each axis; of points in one pixel, the
    last by (x, y, z) stays."""
    sx = smallest_step(points, "x").select(F.col("lo").alias("x0"), F.coalesce("step", F.lit(1.0)).alias("dx"))
    sy = smallest_step(points, "y").select(F.col("hi").alias("y1"), F.coalesce("step", F.lit(1.0)).alias("dy"))
    p = points.crossJoin(F.broadcast(sx)).crossJoin(F.broadcast(sy))  # one row each
    at = p.select(((F.col("y1") - F.col("y")) / F.col("dy") + 1e-9).cast("int").alias("row"), ((F.col("x") - F.col("x0")) / F.col("dx") + 1e-9).cast("int").alias("col"), "x", "y", "z")
    return at.groupBy("row", "col").agg(F.max_by("z", F.struct("x", "y", "z")).alias("z")).select(F.lit(raster_id).alias(ID), "row", "col", "z")


def _ranks(points: DataFrame, axis: str, name: str, down: bool = False) -> DataFrame:
    """The distinct coordinates of an axis and their ranks from 0: ranked inside 1024 slices of the axis, and the slices'
    counts (1025 rows at most) added up, so no task sorts the whole axis."""
    v = points.select(axis).where(F.col(axis).isNotNull()).distinct()
    ends = v.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    part = F.floor((F.col(axis) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * 1024)
    cut = v.crossJoin(F.broadcast(ends)).select(axis, (-part if down else part).alias("s"))  # the other side is one row
    n = cut.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("s", F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("s").orderBy(F.desc(axis) if down else F.asc(axis))) - 1
    return cut.withColumn("own", own).join(F.broadcast(before), "s").select(axis, (F.col("before") + F.col("own")).cast("int").alias(name))


def points_to_rank_raster(points: DataFrame, raster_id: int = 0) -> DataFrame:
    """Raster whose columns and rows are the ranks of the distinct coordinates; the steps need not be regular."""
    p = points.join(_ranks(points, "x", "col"), "x").join(_ranks(points, "y", "row", down=True), "y")
    return p.groupBy("row", "col").agg(F.max("z").alias("z")).select(F.lit(raster_id).alias(ID), "row", "col", "z")


def col_to_x(col: Column, x0: Column, cell: Column) -> Column:
    """Position of a column; (x0, y0) is the lower left pixel."""
    return x0 + col * cell


def row_to_y(row: Column, y0: Column, cell: Column, height: Column) -> Column:
    return y0 + (height - 1 - row) * cell


def x_to_col(x: Column, x0: Column, cell: Column) -> Column:
    """The nearest column."""
    return F.floor((x - x0) / cell + 0.5).cast("int")


def y_to_row(y: Column, y0: Column, cell: Column, height: Column) -> Column:
    return (height - 1 - F.floor((y - y0) / cell + 0.5)).cast("int")


def row_from_below(row: Column, height: Column) -> Column:
    """Row counted from the southern edge; its own inverse."""
    return height - 1 - row


def neighbours(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Adds for each offset the pixel there (n0, n1, ...), null beyond the edges or where missing.

    Each pixel sends its value to the pixels that look at it and one aggregation gathers them: a single shuffle by pixel,
    however many neighbours, and no window over a whole row of a raster."""
    to = F.array(*[F.struct((F.col("row") - r).alias("r"), (F.col("col") - c).alias("c"), F.lit(i).alias("i")) for i, (r, c) in enumerate([(0, 0), *offsets])])
    sent = df.select(ID, "z", F.explode(to).alias("t"))
    got = sent.groupBy(ID, F.col("t.r").alias("row"), F.col("t.c").alias("col")).agg(
        F.bool_or(F.col("t.i") == 0).alias("here"), *[F.max(F.when(F.col("t.i") == i, F.col("z"))).alias("z" if i == 0 else f"n{i - 1}") for i in range(len(offsets) + 1)]
    )
    return got.where("here").drop("here")


CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]
DIAGONAL = [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def _mean(columns: list[Column]) -> Column:
    n = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


def smooth(df: DataFrame) -> DataFrame:
    """Weighted mean of the pixel (3), the mean of its cross (2) and the mean of its diagonals (1), each left out if missing."""
    n = neighbours(df, CROSS + DIAGONAL)
    parts = [(F.col("z"), 3.0), (_mean([F.col(f"n{i}") for i in range(4)]), 2.0), (_mean([F.col(f"n{i}") for i in range(4, 8)]), 1.0)]
    w = sum((F.when(v.isNotNull(), k).otherwise(0.0) for v, k in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    s = sum((F.coalesce(v * k, F.lit(0.0)) for v, k in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    return n.select(ID, "row", "col", "z", F.when(w > 0, s / w).alias("smooth"))


def fill_missing(df: DataFrame, samples: int = 1, max_radius: int = 64) -> DataFrame:
    """Missing pixels as the mean of the smoothed values on the nearest circles that hold `samples` of them; others stay.

    Circles are rings of pixels whose rounded distance is the radius, from 1 on, and the mean covers all rings up to the first
    that reaches the count.  A value goes to the blocks of pixels within the radius, twice or so, and a block looks its missing
    pixels up by itself; the radius doubles for those that are not filled yet, so near gaps never pay for far ones.
    """
    from .mesh import written  # mesh builds on this module

    values = smooth(df).where("smooth is not null").select(ID, F.col("row").alias("r"), F.col("col").alias("c"), "smooth")
    todo = df.where("z is null").select(ID, "row", "col")
    out = df.where("z is not null").select(ID, "row", "col", "z")
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in todo.schema) + ", z double, found boolean"
    radius = 0
    while radius < max_radius:
        radius = min(max_radius, max(4, 2 * radius))
        side = max(32, 4 * radius)
        block = lambda c, by=0: F.floor((F.col(c) + by) / side)
        span = lambda c, by: F.explode(F.sequence(block(c, -by), block(c, by)))
        gaps = todo.withColumns({"i": block("row"), "j": block("col")})
        sent = values.withColumn("i", span("r", radius)).withColumn("j", span("c", radius))
        sent = sent.join(gaps.select(ID, "i", "j").distinct().hint("merge"), [ID, "i", "j"], "left_semi")
        of = [F.col(ID).alias("of"), "i", "j"]  # a name of its own: both sides come from one table
        left, right = sent.select(*of, "r", "c", "smooth"), gaps.select(*of, ID, "row", "col")
        filled = left.groupBy("of", "i", "j").cogroup(right.groupBy("of", "i", "j")).applyInPandas(_filler(samples, radius), schema)
        filled = written(filled, "filled")
        out = out.unionByName(filled.where("found").drop("found"))
        todo = filled.where("not found").select(ID, "row", "col")
        if todo.isEmpty():
            break
    return out.unionByName(todo.withColumn("z", F.lit(None).cast("double")))


def _filler(samples: int, radius: int):
    """The function that fills the missing pixels of a block from the values within the radius (r, c, smooth)."""

    def run(near: pd.DataFrame, gaps: pd.DataFrame) -> pd.DataFrame:
        row, col = gaps.row.to_numpy(np.int64), gaps.col.to_numpy(np.int64)
        z, n, open_ = np.full(len(gaps), np.nan), np.zeros(len(gaps), np.int64), np.arange(len(gaps))
        s, found = np.zeros(len(gaps)), np.zeros(len(gaps), bool)
        if len(gaps) and len(near):
            top, left = row.min() - radius, col.min() - radius
            value, there = (np.zeros((row.max() + radius + 1 - top, col.max() + radius + 1 - left), t) for t in (float, np.int64))
            r, c = near.r.to_numpy(np.int64) - top, near.c.to_numpy(np.int64) - left
            seen = (r >= 0) & (r < value.shape[0]) & (c >= 0) & (c < value.shape[1])
            np.add.at(value, (r[seen], c[seen]), near.smooth.to_numpy(float)[seen])
            np.add.at(there, (r[seen], c[seen]), 1)
            dr, dc = (x.ravel() for x in np.mgrid[-radius : radius + 1, -radius : radius + 1])
            ring = np.rint(np.sqrt(dr * dr + dc * dc)).astype(int)
            for k in range(1, radius + 1):
                for a, b in zip(dr[ring == k], dc[ring == k], strict=True):
                    at = row[open_] - top + a, col[open_] - left + b
                    s[open_] += value[at]
                    n[open_] += there[at]
                full = open_[n[open_] >= max(samples, 1)]
                z[full], found[full] = s[full] / n[full], True
                open_ = open_[~found[open_]]
                if not len(open_):
                    break
        return gaps[[ID, "row", "col"]].assign(z=z, found=found)

    return run


def dilate(mask: DataFrame, top: int = 0, right: int = 0, bottom: int = 0, left: int = 0) -> DataFrame:
    """Grows a mask (inside boolean) by pixels on each side."""
    offsets = [(r, c) for r in range(-bottom, top + 1) for c in range(-right, left + 1) if (r, c) != (0, 0)]
    asked = mask.withColumn("z", F.col("inside").cast("int"))
    if not offsets:
        return mask.select(ID, "row", "col", "inside")
    n = neighbours(asked, offsets)
    return n.select(ID, "row", "col", (F.greatest("z", *[F.coalesce(f"n{i}", F.lit(0)) for i in range(len(offsets))]) > 0).alias("inside"))


def quads(df: DataFrame) -> DataFrame:
    """Blocks of 2 x 2 valid pixels, by their upper left pixel: z00, z01, z10, z11."""
    n = neighbours(df, [(0, 1), (1, 0), (1, 1)]).toDF(ID, "row", "col", "z00", "z01", "z10", "z11")
    return n.where("z00 is not null and z01 is not null and z10 is not null and z11 is not null")


def grey(df: DataFrame) -> DataFrame:
    """Heights stretched to 0..255; a flat raster is 0."""
    e = df.groupBy(ID).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    out = df.join(e, ID)  # one row a raster
    v = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("z") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")))).otherwise(0)
    return out.select(ID, "row", "col", v.cast("int").alias("grey"))


def cubic_weights(t: Column) -> list[Column]:
    """Weights of the four pixels around a fraction t (Keys' kernel with a = -0.5)."""
    a = -0.5
    near = lambda d: (a + 2) * d * d * d - (a + 3) * d * d + 1.0
    far = lambda d: a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return [far(t + 1), near(t), near(F.lit(1.0) - t), far(F.lit(2.0) - t)]


def resample(targets: DataFrame, pixels: DataFrame) -> DataFrame:
    """Cubic interpolation of rasters at targets (target columns, raster_id, u, v in pixels from the upper left pixel's centre).

    Sixteen neighbours are asked for by an equi-join and weighed; missing ones are left out and the weights made to sum to
    one.  Targets with less than half of the weight at hand are null.
    """
    keep = [c for c in targets.columns if c not in (ID, "u", "v")]
    t = targets.select("*", F.floor("u").alias("c0"), F.floor("v").alias("r0"))
    wu, wv = cubic_weights(F.col("u") - F.col("c0")), cubic_weights(F.col("v") - F.col("r0"))
    asks = F.array(*[F.struct((F.col("r0") + j - 1).cast("int").alias("row"), (F.col("c0") + i - 1).cast("int").alias("col"), (wu[i] * wv[j]).alias("w")) for j in range(4) for i in range(4)])
    each = t.select(*keep, ID, "u", "v", F.explode(asks).alias("a")).select(*keep, ID, "u", "v", "a.*")
    got = each.join(pixels.select(ID, "row", "col", "z"), [ID, "row", "col"], "left")
    s = got.groupBy(*keep, ID, "u", "v").agg(F.sum(F.col("w") * F.col("z")).alias("s"), F.sum(F.when(F.col("z").isNotNull(), F.col("w"))).alias("w"))
    return s.select(*keep, ID, "u", "v", F.when(F.col("w") >= 0.5, F.col("s") / F.col("w")).alias("z"))


def warp(pixels: DataFrame, gt: tuple[float, ...], source: int, bounds: tuple[float, float, float, float], target: int, width: int, height: int) -> DataFrame:
    """Cubic read of rasters of one geotransform into a grid of `width` x `height` pixels of bounds in another system.

    The middle of each target pixel is carried into the raster's system; z is null where less than half of the weight is at
    hand."""
    xmin, ymin, xmax, ymax = bounds
    rows = pixels.select(ID).distinct().withColumn("tr", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))) if height > 0 and width > 0 else pixels.select(ID, "row").limit(0).withColumnRenamed("row", "tr")
    t = rows.withColumn("tc", F.explode(F.sequence(F.lit(0), F.lit(max(width, 1) - 1))))
    x = F.lit(xmin) + (F.col("tc") + 0.5) * ((xmax - xmin) / max(width, 1))
    y = F.lit(ymax) - (F.col("tr") + 0.5) * ((ymax - ymin) / max(height, 1))
    sx, sy, _ = srs.transform(target, source, x, y)
    u, v = srs.crs_to_pixel([F.lit(float(k)) for k in gt], sx, sy)
    t = t.select(ID, "tr", "tc", (u - 0.5).alias("u"), (v - 0.5).alias("v"))
    return resample(t, pixels).select(ID, F.col("tr").alias("row"), F.col("tc").alias("col"), "z")


def level_for(ratio: float, levels: int) -> int:
    """Coarsest pyramid level that still has at least a pixel for each pixel asked for (ratio: source pixels a target pixel)."""
    k = 0
    while k < levels and ratio >= 2 ** (k + 1):
        k += 1
    return k


def tile_rasters(points: DataFrame, grid, zoom: int) -> DataFrame:
    """Pixels of tiles: mean height of the points in each pixel of the grid, keyed by tile and row and column in it."""
    z = F.lit(zoom)
    px, py = grid.crs_to_pixels(F.col("x"), F.col("y"), z)
    p = points.select(px.alias("px"), py.alias("py"), "z").where("px is not null").groupBy("px", "py").agg(F.avg("z").alias("z"))
    tx, ty = grid.pixels_to_tile(F.col("px"), F.col("py"))
    g = grid.pixels
    return p.select(z.alias("zoom"), tx.alias("x"), ty.alias("y"), (F.lit(g - 1) - F.col("py") % g).cast("int").alias("row"), (F.col("px") % g).cast("int").alias("col"), "z")
