"""Quantised mesh streams: quantisation, zig-zag differences, high-watermark indices, edge lists and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geom, srs
from .mesh import M

TOP = 32767


def zigzag(v: Column) -> Column:
    """Signed 16-bit numbers as unsigned ones, small ones first."""
    return (F.shiftleft(v.cast("int"), 1).bitwiseXOR(F.shiftright(v.cast("int"), 31))).bitwiseAND(65535)


def unzigzag(v: Column) -> Column:
    return F.shiftright(v.cast("int"), 1).bitwiseXOR(-(v.cast("int").bitwiseAND(1)))


def quantize(v: Column, lo: Column, hi: Column) -> Column:
    """0 to 32767 over a range; 0 if the range is a point."""
    return F.when(hi > lo, F.floor((v - lo) / (hi - lo) * TOP + 0.5)).otherwise(0).cast("int")


def dequantize(q: Column, lo: Column, hi: Column) -> Column:
    return lo + (hi - lo) * q / TOP


def deltas(streams: DataFrame, columns: list[str], order: str = "ord", group: str = M) -> DataFrame:
    """Zig-zag coded differences to the previous vertex of the mesh (its first differs from 0).

    The window is over one mesh, which is a tile's and of bounded size."""
    w = Window.partitionBy(group).orderBy(order)
    return streams.select(group, order, *[zigzag(F.col(c) - F.lag(c, 1, 0).over(w)).alias(c) for c in columns])


def undeltas(streams: DataFrame, columns: list[str], order: str = "ord", group: str = M) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return streams.select(group, order, *[F.sum(unzigzag(F.col(c))).over(w).cast("int").alias(c) for c in columns])


def first_use(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices numbered in the order in which the faces' corners first name them: the mapping (mesh_id, vid, ord) and the
    corner stream (mesh_id, pos, idx)."""
    s = faces.select(M, "fid", F.posexplode(F.array("a", "b", "c")).alias("k", "vid"))
    s = s.select(M, (F.row_number().over(Window.partitionBy(M).orderBy("fid", "k")) - 1).alias("pos"), "vid")
    at = s.groupBy(M, "vid").agg(F.min("pos").alias("at"))
    order = at.select(M, "vid", (F.row_number().over(Window.partitionBy(M).orderBy("at")) - 1).alias("ord"))
    return order, s.join(order, [M, "vid"]).select(M, "pos", F.col("ord").alias("idx"))


def watermark(stream: DataFrame, group: str = M) -> DataFrame:
    """High-watermark codes: how far an index lies below the next unused one; 0 names a new vertex."""
    before = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return stream.select(group, "pos", (F.coalesce(F.max(F.col("idx") + 1).over(before), F.lit(0)) - F.col("idx")).cast("int").alias("code"))


def unwatermark(stream: DataFrame, group: str = M) -> DataFrame:
    before = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return stream.select(group, "pos", (F.coalesce(F.count_if(F.col("code") == 0).over(before), F.lit(0)) - F.col("code")).cast("int").alias("idx"))


def edge_lists(vertices: DataFrame) -> DataFrame:
    """Numbers of the vertices on the western, southern, eastern and northern edge of quantised meshes (mesh_id, ord, u, v)."""
    sides = {"west": F.col("u") == 0, "south": F.col("v") == 0, "east": F.col("u") == TOP, "north": F.col("v") == TOP}
    return vertices.groupBy(M).agg(*[F.array_sort(F.collect_list(F.when(c, F.col("ord")))).alias(k) for k, c in sides.items()])


def header(vertices: DataFrame) -> DataFrame:
    """Header of meshes with positions in longitude, latitude and height (mesh_id, x, y, z): the earth-centred centre of the box,
    least and greatest height, bounding sphere and horizon occlusion point."""
    e = [c.alias(k) for k, c in zip(("ex", "ey", "ez"), srs.to_ecef(F.col("x"), F.col("y"), F.col("z")), strict=True)]
    p = vertices.select(M, "z", *e)
    b = p.groupBy(M).agg(F.min("z").alias("min_h"), F.max("z").alias("max_h"), *[((F.min(k) + F.max(k)) / 2).alias(f"c{k[1]}") for k in ("ex", "ey", "ez")])
    j = p.drop("z").join(b, M)
    far = geom.distance2(tuple(F.col(k) for k in ("ex", "ey", "ez")), tuple(F.col(k) for k in ("cx", "cy", "cz")))
    mag = geom.occlusion_magnitude(*[F.col(k) for k in ("ex", "ey", "ez", "cx", "cy", "cz")])
    g = j.groupBy(M, "min_h", "max_h", "cx", "cy", "cz").agg(F.sqrt(F.max(far)).alias("radius"), F.max(mag).alias("mag"))
    semi = (6378137.0, 6378137.0, 6356752.3142451793)
    s = [F.col(f"c{k}") / a for k, a in zip("xyz", semi, strict=True)]
    length = F.sqrt(s[0] * s[0] + s[1] * s[1] + s[2] * s[2])
    return g.select(M, "cx", "cy", "cz", "min_h", "max_h", "radius", *[(v / length * F.col("mag")).alias(f"o{k}") for k, v in zip("xyz", s, strict=True)])


def height_to_rgb(h: Column) -> tuple[Column, Column, Column]:
    """A height from -32768 m in steps of 1/256 m as three bytes, most significant first; an encoding of this library."""
    v = F.floor((h + 32768.0) * 256.0 + 0.5).cast("long")
    return tuple(F.shiftright(v, s).bitwiseAND(255).cast("int") for s in (16, 8, 0))


def rgb_to_height(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b) / 256.0 - 32768.0


def data_uri(mime: Column, content: Column) -> Column:
    """In one line: Spark breaks base64 after 76 characters."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def mime_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").otherwise("application/octet-stream")


def aligned(n: Column, to: int = 4) -> Column:
    return ((n + to - 1) / to).cast("long") * to


def tokens(text: Column, delimiters: str = " \n\r\t") -> Column:
    """Words between delimiters, none of them empty; null for a null text."""
    cls = "".join({"\n": r"\n", "\r": r"\r", "\t": r"\t"}.get(c, "\\" + c if c in r"\]^-" else c) for c in delimiters)
    return F.filter(F.split(text, f"[{cls}]+"), lambda w: w != "")


def parse_bool(v: Column) -> Column:
    low = F.lower(F.trim(v))
    return F.when(low.isin("true", "yes", "on", "1"), True).when(low.isin("false", "no", "off", "0"), False)


def parse_uint(v: Column) -> Column:
    return F.when(F.trim(v).rlike("^[0-9]{1,18}$"), F.trim(v).cast("long"))


def key_values(v: Column) -> Column:
    """`a=1&b=2` as a map."""
    return F.str_to_map(v, F.lit("&"), F.lit("="))


def stem(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")
