"""Tile grids as Column expressions.

Tiles are (zoom, x, y) with y growing northwards (TMS); `slippy_y` gives the other convention.  Every function takes and
returns Columns, so keys, bounds and filters stay inside one generated stage and reach the scan where they can.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A global quadtree grid: extent, root tiles side by side, and pixels of a tile."""

    name: str
    epsg: int
    half_width: float
    half_height: float
    roots: int
    pixels: int = 256

    @property
    def base_resolution(self) -> float:
        return 2 * self.half_width / self.roots / self.pixels

    def resolution(self, zoom: Column) -> Column:
        """Units of a pixel."""
        return F.lit(self.base_resolution) / F.pow(F.lit(2.0), zoom)

    def zoom_for_resolution(self, resolution: Column) -> Column:
        """The least zoom whose pixels are no larger; null for a resolution that is not positive."""
        return F.when(resolution > 0, F.ceil(F.log2(F.lit(self.base_resolution)) - F.log2(resolution))).cast("int")

    def pixel(self, v: Column, half: float, zoom: Column) -> Column:
        return F.floor((v + F.lit(half)) / self.resolution(zoom)).cast("long")

    def crs_to_pixels(self, x: Column, y: Column, zoom: Column) -> tuple[Column, Column]:
        """Pixel column and row from the south-west corner; null outside the extent."""
        inside = x.between(-self.half_width, self.half_width) & y.between(-self.half_height, self.half_height)
        return F.when(inside, self.pixel(x, self.half_width, zoom)), F.when(inside, self.pixel(y, self.half_height, zoom))

    def pixels_to_crs(self, px: Column, py: Column, zoom: Column) -> tuple[Column, Column]:
        r = self.resolution(zoom)
        return px * r - F.lit(self.half_width), py * r - F.lit(self.half_height)

    def pixels_to_tile(self, px: Column, py: Column) -> tuple[Column, Column]:
        return F.floor(px / self.pixels).cast("long"), F.floor(py / self.pixels).cast("long")

    def crs_to_tile(self, x: Column, y: Column, zoom: Column) -> tuple[Column, Column]:
        return self.pixels_to_tile(*self.crs_to_pixels(x, y, zoom))

    def bounds(self, zoom: Column, x: Column, y: Column, border: int = 0) -> dict[str, Column]:
        """Bounds of a tile; `border` pixels are added on the eastern and northern sides."""
        r, b = self.resolution(zoom), F.lit(float(border))
        g = F.lit(float(self.pixels))
        return {
            "xmin": x * g * r - F.lit(self.half_width),
            "ymin": y * g * r - F.lit(self.half_height),
            "xmax": ((x + 1) * g + b) * r - F.lit(self.half_width),
            "ymax": ((y + 1) * g + b) * r - F.lit(self.half_height),
        }

    def descriptor(self, zoom: Column, x: Column, y: Column, border: bool = False) -> Column:
        """A tile as a struct: id, bounds, epsg, grid_size and tile_size (one more with a border)."""
        b = self.bounds(zoom, x, y, int(border))
        return F.struct(zoom.cast("int").alias("zoom"), x.alias("x"), y.alias("y"), *[v.alias(k) for k, v in b.items()], F.lit(self.epsg).alias("epsg"), F.lit(self.pixels).alias("grid_size"), F.lit(self.pixels + int(border)).alias("tile_size"))

    def covering(self, xmin: Column, ymin: Column, xmax: Column, ymax: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
        """First and last tile columns and rows that cover bounds; a bound on an edge (to a hundredth of a pixel) does not reach
        the next tile."""
        e = self.resolution(zoom) / 100
        x0, y0 = self.crs_to_tile(xmin, ymin, zoom)
        x1, y1 = self.crs_to_tile(xmax - e, ymax - e, zoom)
        return x0, y0, x1, y1


def mercator(pixels: int = 256) -> Grid:
    """Web Mercator, one root tile."""
    half = math.pi * 6378137.0
    return Grid("mercator", 3857, half, half, 1, pixels)


def geodetic(pixels: int = 256) -> Grid:
    """Longitude and latitude, two root tiles."""
    return Grid("geodetic", 4326, 180.0, 90.0, 2, pixels)


def slippy_y(zoom: Column, y: Column) -> Column:
    """Row counted from the north; its own inverse."""
    return F.expr("1L") * F.pow(F.lit(2), zoom).cast("long") - 1 - y


def parent(x: Column) -> Column:
    return F.floor(x / 2).cast("long")


def children(zoom: Column, x: Column, y: Column) -> Column:
    """The four children in the order south-west, south-east, north-west, north-east."""
    one = lambda i: F.struct((zoom + 1).cast("int").alias("zoom"), (x * 2 + i % 2).cast("long").alias("x"), (y * 2 + i // 2).cast("long").alias("y"))
    return F.array(*[one(i) for i in range(4)])


def estimate_zoom(zoom: Column, tile_width: Column, tile_height: Column, width: Column, height: Column) -> Column:
    """Zoom at which tiles have about the size of the given bounds, from a tile of known zoom and size."""
    ratio = (tile_width / width + tile_height / height) / 2
    return (zoom + F.rint(F.log2(ratio))).cast("int")


#: Metres of a pixel by zoom, 0 to 20.
METRES_PER_PIXEL = [
    156543.0, 78272.0, 39136.0, 19568.0, 9784.0, 4892.0, 2446.0, 1223.0, 611.496, 305.748, 152.874, 76.437,
    38.219, 19.109, 9.555, 4.777, 2.389, 1.194, 0.597, 0.299, 0.149,
]


def target_error(zoom: Column) -> Column:
    """Tolerated simplification error of a zoom in metres; null where the table has none."""
    return F.try_element_at(F.array(*map(F.lit, METRES_PER_PIXEL)), (zoom + 1).cast("int"))


def tile_url(template: str, zoom: Column, x: Column, y: Column, ext: str = "") -> Column:
    """The template with {zoom}, {x}, {y} and {ext} filled in."""
    out = F.lit(template)
    for name, v in (("{zoom}", zoom.cast("string")), ("{x}", x.cast("string")), ("{y}", y.cast("string")), ("{ext}", F.lit(ext))):
        out = F.replace(out, F.lit(name), v)
    return out
