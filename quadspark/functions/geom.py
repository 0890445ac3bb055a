"""Plane and solid geometry as Column expressions.

Points are tuples of Columns.  Undefined results are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, ...]
COLLINEAR = 1e-16


def area2(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area of a triangle; positive if counter-clockwise."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def winding(a: Point, b: Point, c: Point) -> Column:
    """1 counter-clockwise, -1 clockwise, 0 collinear."""
    v = area2(a, b, c)
    return F.when(F.abs(v) < COLLINEAR, 0).otherwise(F.signum(v).cast("int"))


def _edge_rule(p: Point, a: Point, b: Point) -> Column:
    """p left of the directed edge, or on it if it is a left edge (going down) or a top edge (level, going left)."""
    w = winding(a, b, p)
    top_left = (b[1] < a[1]) | ((b[1] == a[1]) & (b[0] < a[0]))
    return (w > 0) | ((w == 0) & top_left)


def in_triangle(p: Point, a: Point, b: Point, c: Point) -> Column:
    """Inside a counter-clockwise triangle by the top-left rule: of two triangles that share an edge exactly one has its points."""
    return _edge_rule(p, a, b) & _edge_rule(p, b, c) & _edge_rule(p, c, a)


def facing_up(a: Point, b: Point, c: Point) -> Column:
    return area2(a, b, c) > 0


def front_facing(a: Column, b: Column, c: Column, up: Column) -> Column:
    """Corners in counter-clockwise order: the last two swap where the face does not look up."""
    return F.when(up, F.array(a, b, c)).otherwise(F.array(a, c, b))


def plane(a: Point, b: Point, c: Point) -> tuple[Column, Column, Column]:
    """Coefficients of z = p x + q y + r through three points; null if they are collinear in the plane."""
    d = F.nullif(area2(a, b, c), F.lit(0.0))
    p = ((b[2] - a[2]) * (c[1] - a[1]) - (c[2] - a[2]) * (b[1] - a[1])) / d
    q = ((b[0] - a[0]) * (c[2] - a[2]) - (c[0] - a[0]) * (b[2] - a[2])) / d
    return p, q, a[2] - p * a[0] - q * a[1]


def barycentric(p: Point, a: Point, b: Point, c: Point) -> tuple[Column, Column, Column]:
    d = F.nullif(area2(a, b, c), F.lit(0.0))
    u, v = area2(b, c, p) / d, area2(c, a, p) / d
    return u, v, F.lit(1.0) - u - v


def interpolate(p: Point, a: Point, b: Point, c: Point) -> Column:
    """Height at p of the triangle, null outside; its boundary counts as inside.

    Inside is told by the signs of three areas, so a point on an edge that two triangles share is never lost to rounding."""
    u, v, w = barycentric(p, a, b, c)
    d = F.nullif(area2(a, b, c), F.lit(0.0))
    inside = (u >= 0) & (v >= 0) & (area2(a, b, p) / d >= 0)
    return F.when(inside, u * a[2] + v * b[2] + w * c[2])


def distance2(a: Point, b: Point) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + (x - y) * (x - y)
    return out


def compare_length(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Sign of the length of ab less that of cd."""
    return F.signum(distance2(a, b) - distance2(c, d)).cast("int")


def circumcentre(a: Point, b: Point, c: Point) -> tuple[Column, Column]:
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = F.nullif((bx * cy - by * cx) * 2, F.lit(0.0))
    bl, cl = bx * bx + by * by, cx * cx + cy * cy
    return a[0] + (cy * bl - by * cl) / d, a[1] + (bx * cl - cx * bl) / d


def circumradius2(a: Point, b: Point, c: Point) -> Column:
    x, y = circumcentre(a, b, c)
    return distance2((x, y), a[:2])


def in_circle(a: Point, b: Point, c: Point, p: Point) -> Column:
    """p strictly inside the circle through a counter-clockwise triangle."""
    rows = [(q[0] - p[0], q[1] - p[1]) for q in (a, b, c)]
    sq = [x * x + y * y for x, y in rows]
    det = rows[0][0] * (rows[1][1] * sq[2] - rows[2][1] * sq[1]) - rows[0][1] * (rows[1][0] * sq[2] - rows[2][0] * sq[1]) + sq[0] * (rows[1][0] * rows[2][1] - rows[2][0] * rows[1][1])
    return det > 0


def line_side(p: Point, a: Point, b: Point, eps: float = 1e-12) -> Column:
    """Side of the line ab that p lies on: 1 left, -1 right, 0 on it."""
    v = area2(a, b, p)
    return F.when(F.abs(v) < eps, 0).otherwise(F.signum(v).cast("int"))


def intersect(a: Point, b: Point, c: Point, d: Point) -> tuple[Column, Column, Column, Column]:
    """Where the line ab meets the line cd: parameters along each, and the point; null if they are parallel."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    den = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    qx, qy = c[0] - a[0], c[1] - a[1]
    t, u = (qx * sy - qy * sx) / den, (qx * ry - qy * rx) / den
    return t, u, a[0] + rx * t, a[1] + ry * t


def segments_cross(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Whether two segments share a point that is inner to both."""
    t, u, _, _ = intersect(a, b, c, d)
    return F.coalesce((t > 0) & (t < 1) & (u > 0) & (u < 1), F.lit(False))


def box(*points: Point) -> dict[str, Column]:
    out = {}
    for k, v in zip("xyz", zip(*points, strict=True), strict=False):
        out |= {f"{k}min": F.least(*v), f"{k}max": F.greatest(*v)}
    return out


def boxes_overlap(a: dict[str, Column], b: dict[str, Column], eps: float = 0.0) -> Column:
    """Whether boxes, both grown by eps, share a point."""
    out = F.lit(True)
    for k in "xyz":
        if f"{k}min" in a and f"{k}min" in b:
            out = out & (a[f"{k}min"] - 2 * eps <= b[f"{k}max"]) & (b[f"{k}min"] - 2 * eps <= a[f"{k}max"])
    return out


def box_contains(a: dict[str, Column], p: Point) -> Column:
    out = F.lit(True)
    for k, v in zip("xyz", p, strict=False):
        out = out & v.between(a[f"{k}min"], a[f"{k}max"])
    return out


def on_border(a: dict[str, Column], p: Point, eps: float = 0.0) -> Column:
    near = lambda v, e: F.abs(v - e) <= eps
    return box_contains({k: v - eps if "min" in k else v + eps for k, v in a.items()}, p) & (near(p[0], a["xmin"]) | near(p[0], a["xmax"]) | near(p[1], a["ymin"]) | near(p[1], a["ymax"]))


def canonical(a: Column, b: Column, c: Column) -> Column:
    """A triangle's corners with the least first, in the same orientation: equal for rotations of one triangle."""
    return F.when((a <= b) & (a <= c), F.array(a, b, c)).when((b <= a) & (b <= c), F.array(b, c, a)).otherwise(F.array(c, a, b))


def unoriented(a: Column, b: Column, c: Column) -> Column:
    return F.array_sort(F.array(a, b, c))


def occlusion_magnitude(x: Column, y: Column, z: Column, cx: Column, cy: Column, cz: Column, semi: tuple[float, float, float] = (6378137.0, 6378137.0, 6356752.3142451793)) -> Column:
    """How far along the direction of the centre the horizon occlusion point of a position lies, in ellipsoid-scaled space; its
    maximum over a tile's positions is the tile's."""
    sx, sy, sz = x / semi[0], y / semi[1], z / semi[2]
    dx, dy, dz = cx / semi[0], cy / semi[1], cz / semi[2]
    dl = F.sqrt(dx * dx + dy * dy + dz * dz)
    dx, dy, dz = dx / dl, dy / dl, dz / dl
    m2 = sx * sx + sy * sy + sz * sz
    m = F.sqrt(m2)
    ux, uy, uz = sx / m, sy / m, sz / m
    m2 = F.greatest(m2, F.lit(1.0))
    m = F.greatest(m, F.lit(1.0))
    cos_a = ux * dx + uy * dy + uz * dz
    kx, ky, kz = uy * dz - uz * dy, uz * dx - ux * dz, ux * dy - uy * dx
    sin_a = F.sqrt(kx * kx + ky * ky + kz * kz)
    cos_b = F.lit(1.0) / m
    sin_b = F.sqrt(m2 - 1) * cos_b
    return F.lit(1.0) / (cos_a * cos_b - sin_a * sin_b)


def clip_half_plane(triangles: Column, axis: str, keep_above: bool, at: float) -> Column:
    """Triangles (arrays of three structs x, y, z) cut by x or y = at; what is kept is cut into one or two triangles.

    A cut of one corner leaves a quadrilateral, which is split along its shorter diagonal."""
    sign = 1.0 if keep_above else -1.0
    d = lambda p: (p[axis] - F.lit(at)) * F.lit(sign)

    def meet(p: Column, q: Column) -> Column:
        t = d(p) / (d(p) - d(q))
        return F.struct(*[(p[k] + (q[k] - p[k]) * t).alias(k) for k in "xyz"])

    length2 = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) + (p["z"] - q["z"]) * (p["z"] - q["z"])
    tri = lambda *p: F.array(*p)

    def one_in(p: Column, q: Column, r: Column) -> Column:  # only p stays
        return F.array(tri(p, meet(p, q), meet(p, r)))

    def two_in(p: Column, q: Column, r: Column) -> Column:  # r goes
        s, t = meet(q, r), meet(p, r)
        return F.when(length2(p, s) <= length2(q, t), F.array(tri(p, q, s), tri(p, s, t))).otherwise(F.array(tri(p, q, t), tri(q, s, t)))

    def cut(t: Column) -> Column:
        a, b, c = t[0], t[1], t[2]
        ia, ib, ic = d(a) >= 0, d(b) >= 0, d(c) >= 0
        none = F.filter(F.array(t), lambda _: F.lit(False))
        return (
            F.when(ia & ib & ic, F.array(t))
            .when(ia & ib, two_in(a, b, c)).when(ib & ic, two_in(b, c, a)).when(ia & ic, two_in(c, a, b))
            .when(ia, one_in(a, b, c)).when(ib, one_in(b, c, a)).when(ic, one_in(c, a, b))
            .otherwise(none)
        )

    return F.flatten(F.transform(triangles, cut))


def clip_to_unit_square(a: Column, b: Column, c: Column) -> Column:
    """A triangle of structs (x, y, z) cut to 0 <= x, y <= 1: an array of triangles without those of no area."""
    out = F.array(F.array(a, b, c))
    for axis in "xy":
        out = clip_half_plane(clip_half_plane(out, axis, True, 0.0), axis, False, 1.0)
    area = lambda t: (t[1]["x"] - t[0]["x"]) * (t[2]["y"] - t[0]["y"]) - (t[1]["y"] - t[0]["y"]) * (t[2]["x"] - t[0]["x"])
    return F.filter(out, lambda t: F.abs(area(t)) > 0)
