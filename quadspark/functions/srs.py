"""Coordinate systems as Column expressions: closed forms between EPSG 4326, 3857 and 4978, and geotransforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0  # WGS 84
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
MERCATOR_LIMIT = 85.05112877980659


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(A) * F.radians(lon), F.lit(A) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / F.lit(A)), F.degrees(F.atan(F.exp(y / F.lit(A))) * 2 - F.lit(math.pi / 2))


def to_ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of longitude, latitude (degrees) and ellipsoidal height."""
    lam, phi = F.radians(lon), F.radians(lat)
    s = F.sin(phi)
    n = F.lit(A) / F.sqrt(F.lit(1.0) - F.lit(E2) * s * s)
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * F.lit(1 - E2) + height) * s


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height by Bowring's formula and one more step; good to well under a millimetre on Earth."""
    p = F.sqrt(x * x + y * y)
    b = A * (1 - FLATTENING)
    theta = F.atan2(z * F.lit(A), p * F.lit(b))
    ep2 = (A * A - b * b) / (b * b)
    phi = F.atan2(z + F.lit(ep2 * b) * F.pow(F.sin(theta), F.lit(3)), p - F.lit(E2 * A) * F.pow(F.cos(theta), F.lit(3)))
    theta = F.atan2(F.lit(1 - FLATTENING) * F.sin(phi), F.cos(phi))
    phi = F.atan2(z + F.lit(ep2 * b) * F.pow(F.sin(theta), F.lit(3)), p - F.lit(E2 * A) * F.pow(F.cos(theta), F.lit(3)))
    s = F.sin(phi)
    n = F.lit(A) / F.sqrt(F.lit(1.0) - F.lit(E2) * s * s)
    height = p * F.cos(phi) + z * s - F.lit(A) * F.sqrt(F.lit(1.0) - F.lit(E2) * s * s)
    return F.degrees(F.atan2(y, x)), F.degrees(phi), F.when(n.isNotNull(), height)


def transform(source: int, target: int, x: Column, y: Column, z: Column | None = None) -> tuple[Column, Column, Column]:
    """Point from one of the supported systems to another.  Heights pass through between 4326 and 3857."""
    known = (4326, 3857, 4978)
    if source not in known or target not in known:
        raise ValueError(f"only EPSG {known} are supported, not {source} to {target}")
    z = F.lit(0.0) if z is None else z
    if source == target:
        return x, y, z
    if source == 3857:
        x, y = from_mercator(x, y)
    elif source == 4978:
        x, y, z = from_ecef(x, y, z)
    if target == 3857:
        x, y = to_mercator(x, y)
    elif target == 4978:
        return to_ecef(x, y, z)
    return x, y, z


def edge_points(xmin: Column, ymin: Column, xmax: Column, ymax: Column, steps: int) -> Column:
    """Points along the four edges of bounds, `steps` intervals each, as an array of structs (x, y)."""
    w, h = xmax - xmin, ymax - ymin

    def at(i: Column) -> Column:
        t = i.cast("double") / F.lit(float(steps))
        p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
        return F.array(p(xmin + w * t, ymin), p(xmin + w * t, ymax), p(xmin, ymin + h * t), p(xmax, ymin + h * t))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(steps)), at))


def transform_bounds(source: int, target: int, xmin: Column, ymin: Column, xmax: Column, ymax: Column, steps: int = 20) -> dict[str, Column]:
    """Bounds in the target system of all points along the edges (`steps` 1: of the corners alone).

    Select them inside a struct: named like the inputs beside each other, an earlier one would hide an input from a later one."""
    pts = F.transform(edge_points(xmin, ymin, xmax, ymax, steps), lambda p: F.struct(*[c.alias(k) for c, k in zip(transform(source, target, p["x"], p["y"])[:2], "xy", strict=True)]))
    xs, ys = pts["x"], pts["y"]  # the field of every point
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def ecef_bounds(xmin: Column, ymin: Column, xmax: Column, ymax: Column, zmin: Column, zmax: Column, steps: int = 100) -> dict[str, Column]:
    """Earth-centred box of a longitude-latitude-height box, from its corners and points along its edges."""
    flat = edge_points(xmin, ymin, xmax, ymax, steps)
    at = lambda z: F.transform(flat, lambda p: F.struct(*[c.alias(k) for c, k in zip(to_ecef(p["x"], p["y"], z), "xyz", strict=True)]))
    pts = F.concat(at(zmin), at(zmax))
    out = {}
    for k in "xyz":
        v = pts[k]  # the field of every point
        out |= {f"{k}min": F.array_min(v), f"{k}max": F.array_max(v)}
    return out


def pixel_to_crs(gt: list[Column], col: Column, row: Column) -> tuple[Column, Column]:
    """Upper left corner of a pixel under a geotransform without rotation (gt 0, 1, 3 and 5)."""
    return gt[0] + col * gt[1], gt[3] + row * gt[5]


def crs_to_pixel(gt: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return (x - gt[0]) / gt[1], (y - gt[3]) / gt[5]


def pixel_window(gt: list[Column], xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> dict[str, Column]:
    """Whole pixels that contain bounds: first column and row inclusive, last exclusive."""
    a, b = crs_to_pixel(gt, xmin, ymin), crs_to_pixel(gt, xmax, ymax)
    lo = lambda i: F.floor(F.least(a[i], b[i])).cast("long")
    hi = lambda i: F.ceil(F.greatest(a[i], b[i])).cast("long")
    return {"col0": lo(0), "row0": lo(1), "col1": hi(0), "row1": hi(1)}


def pixel_size(b: dict[str, Column], width: Column, height: Column) -> tuple[Column, Column]:
    """Units of a pixel along each axis of a raster of the given bounds; null for one without pixels."""
    over = lambda lo, hi, n: (b[hi] - b[lo]) / F.when(n > 0, n.cast("double"))
    return over("xmin", "xmax", width), over("ymin", "ymax", height)


def size_in_pixels(b: dict[str, Column], pixel_width: Column, pixel_height: Column) -> tuple[Column, Column]:
    """How many pixels of a size bounds are wide and high (not rounded)."""
    return (b["xmax"] - b["xmin"]) / pixel_width, (b["ymax"] - b["ymin"]) / pixel_height
