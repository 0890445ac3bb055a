"""Meshes as two tables: vertices (mesh_id, vid, x, y, z and, if textured, u, v) and faces (mesh_id, fid, a, b, c)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geom
from .raster import ID, blank, fill_missing, quads

M = "mesh_id"
XYZ = ("x", "y", "z")


def shared(spark: SparkSession, name: str) -> str:
    """A folder for tables that cut lineage between rounds, in the folder that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quadspark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with their corners' coordinates (ax .. cz); a face with an index that has no vertex is dropped."""
    out = faces
    for k in "abc":
        v = vertices.select(M, F.col("vid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in XYZ])
        out = out.join(v, [M, k])
    return out.select(M, "fid", "a", "b", "c", *[f"{k}{c}" for k in "abc" for c in XYZ])


def corner(k: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{k}{c}") for c in XYZ)


def decompose(soup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of triangles (mesh_id, fid, ax .. cz): equal corners become one vertex, in order of first use."""
    parts = F.array(*[F.struct(F.lit(i).alias("k"), *[F.col(f"{k}{c}").alias(c) for c in XYZ]) for i, k in enumerate("abc")])
    each = soup.select(M, "fid", F.explode(parts).alias("p")).select(M, "fid", "p.*")
    first = each.groupBy(M, *XYZ).agg(F.min(F.col("fid") * 3 + F.col("k")).alias("at"))
    vertices = numbered(first, M, "at", "vid").select(M, "vid", *XYZ)
    ids = each.join(vertices, [M, *XYZ]).groupBy(M, "fid").agg(*[F.max(F.when(F.col("k") == i, F.col("vid"))).alias(n) for i, n in enumerate("abc")])
    return vertices, ids


def numbered(df: DataFrame, group: str, order: str, out: str, bits: int = 16) -> DataFrame:
    """Numbers rows of each group from 0 by an integer order without gaps.

    Runs of 2**bits order values are numbered in parallel; the totals of the runs before shift them."""
    d = df.withColumn("__run", F.shiftright(F.col(order).cast("long"), bits))
    n = d.groupBy(group, "__run").agg(F.count(F.lit(1)).alias("__n"))
    n = n.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__run").orderBy(order)) - 1)
    return d.join(n, [group, "__run"]).withColumn(out, (F.col("__before") + F.col("__r")).cast("long")).drop("__run", "__before", "__r")


def renumber(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops vertices that no face uses and closes the gaps, order kept."""
    used = corners(faces).select(M, F.col("v").alias("vid")).distinct()
    kept = numbered(vertices.join(used, [M, "vid"], "left_semi"), M, "vid", "new")
    f = faces
    for k in "abc":
        f = f.join(kept.select(M, F.col("vid").alias(k), F.col("new").alias(f"n{k}")), [M, k])
    f = f.select(M, "fid", *[F.col(f"n{k}").alias(k) for k in "abc"], *[c for c in faces.columns if c not in (M, "fid", "a", "b", "c")])
    return kept.drop("vid").withColumnRenamed("new", "vid").select(vertices.columns), f


def corners(faces: DataFrame) -> DataFrame:
    return faces.select(M, "fid", F.posexplode(F.array("a", "b", "c")).alias("k", "v"))


def edges(faces: DataFrame) -> DataFrame:
    """The three undirected edges of each face, a <= b."""
    e = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    return faces.select(M, "fid", F.explode(F.array(e("a", "b"), e("b", "c"), e("c", "a"))).alias("e")).select(M, "fid", "e.a", "e.b")


def edge_faces(faces: DataFrame) -> DataFrame:
    """Number of faces at each edge."""
    return edges(faces).groupBy(M, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def border_edges(faces: DataFrame) -> DataFrame:
    return edge_faces(faces).where("n = 1").select(M, "a", "b")


def border_vertices(faces: DataFrame) -> DataFrame:
    return border_edges(faces).select(M, F.explode(F.array("a", "b")).alias("vid")).distinct()


def non_manifold_edges(faces: DataFrame) -> DataFrame:
    return edge_faces(faces).where("n > 2")


def valence(faces: DataFrame) -> DataFrame:
    """Number of faces at each vertex that has any."""
    return corners(faces).groupBy(M, F.col("v").alias("vid")).agg(F.countDistinct("fid").alias("n"))


def isolated_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return vertices.join(corners(faces).select(M, F.col("v").alias("vid")), [M, "vid"], "left_anti")


def flaps(faces: DataFrame) -> DataFrame:
    """Faces at a non-manifold edge with a corner of their own, i.e. one that no other face has."""
    bad = non_manifold_edges(faces).select(M, "a", "b")
    at = edges(faces).join(bad, [M, "a", "b"]).select(M, "fid").distinct()
    alone = corners(faces).join(valence(faces).where("n <= 1").select(M, F.col("vid").alias("v")), [M, "v"], "left_semi").select(M, "fid").distinct()
    return at.join(alone, [M, "fid"])


def without(faces: DataFrame, gone: DataFrame) -> DataFrame:
    return faces.join(gone.select(M, "fid").distinct(), [M, "fid"], "left_anti").select(faces.columns)


def normalized(faces: DataFrame) -> DataFrame:
    """Faces turned so that the least index comes first."""
    t = geom.canonical(F.col("a"), F.col("b"), F.col("c"))
    return faces.select(M, "fid", *[t[i].alias(k) for i, k in enumerate("abc")])


def duplicate_faces(faces: DataFrame, oriented: bool = True) -> DataFrame:
    """Faces that repeat one with a smaller fid."""
    key = (geom.canonical if oriented else geom.unoriented)(F.col("a"), F.col("b"), F.col("c"))
    first = faces.groupBy(M, key.alias("key")).agg(F.min("fid").alias("first"))
    return faces.withColumn("key", key).join(first, [M, "key"]).where("fid > first").select(M, "fid")


def degenerate(faces: DataFrame) -> DataFrame:
    return faces.where("a = b or b = c or a = c")


def negligible(vertices: DataFrame, faces: DataFrame, share: float = 0.001) -> DataFrame:
    """Faces whose area in the plane is below a share of their mesh's mean."""
    a = triangles(vertices, faces).select(M, "fid", (F.abs(geom.area2(corner("a"), corner("b"), corner("c"))) / 2).alias("area"))
    mean = a.groupBy(M).agg(F.avg("area").alias("mean"))
    return a.join(mean, M).where(F.col("area") < F.lit(share) * F.col("mean")).select(M, "fid")


def edge_lengths(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Lengths of the distinct edges."""
    e = edges(faces).select(M, "a", "b").distinct()
    for k in "ab":
        e = e.join(vertices.select(M, F.col("vid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in XYZ]), [M, k])
    return e.select(M, "a", "b", F.sqrt(geom.distance2(corner("a"), corner("b"))).alias("length"))


def min_edge_length(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return edge_lengths(vertices, faces).groupBy(M).agg(F.min("length").alias("length"))


def bounding_box(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy(M).agg(*[f(c).alias(f"{c}{n}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))])


def centred(vertices: DataFrame) -> DataFrame:
    """Vertices less their mesh's mean position, which goes along (cx, cy, cz)."""
    c = vertices.groupBy(M).agg(*[F.avg(k).alias(f"c{k}") for k in XYZ])
    v = vertices.join(c, M)
    return v.withColumns({k: F.col(k) - F.col(f"c{k}") for k in XYZ})


def areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Total and mean face area in the plane, and the area of the bounding box and whether they agree (no holes)."""
    t = triangles(vertices, faces).select(M, (F.abs(geom.area2(corner("a"), corner("b"), corner("c"))) / 2).alias("area"))
    t = t.groupBy(M).agg(F.sum("area").alias("area"), F.avg("area").alias("mean_area"))
    b = bounding_box(vertices).select(M, (F.col("xmax") - F.col("xmin")).alias("dx"), (F.col("ymax") - F.col("ymin")).alias("dy"))
    full = F.col("dx") * F.col("dy")
    return t.join(b, M).select(M, "area", "mean_area", full.alias("box_area"), (F.abs(F.col("area") - full) <= (F.col("dx") + F.col("dy")) / 20000).alias("filled"))


def is_square(vertices: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Whether a mesh has a vertex at each corner of its box."""
    v = vertices.join(bounding_box(vertices).select(M, "xmin", "xmax", "ymin", "ymax"), M)
    side = lambda c: F.when(F.abs(F.col(c) - F.col(f"{c}min")) <= eps, 0).when(F.abs(F.col(c) - F.col(f"{c}max")) <= eps, 1)
    return v.groupBy(M).agg((F.countDistinct(side("x"), side("y")) == 4).alias("square"))


def mesh_report(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Violations of a valid mesh: kind, and how many; no row means none."""
    one = lambda df, kind: df.groupBy(M).agg(F.count(F.lit(1)).alias("n")).select(M, F.lit(kind).alias("kind"), "n")
    known = vertices.select(M, F.col("vid").alias("v"))
    parts = [
        one(corners(faces).join(known, [M, "v"], "left_anti"), "index"),
        one(degenerate(faces), "degenerate"),
        one(duplicate_faces(faces), "duplicate"),
        one(isolated_vertices(vertices, faces), "isolated"),
        one(non_manifold_edges(faces), "non-manifold"),
    ]
    if "u" in vertices.columns:
        parts.append(one(vertices.where("u < 0 or u > 1 or v < 0 or v > 1"), "uv"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def crossing_edges(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Pairs of distinct edges of a mesh that cross at inner points.

    Edges meet in the grid cells that their boxes touch: an equi-join, then the exact test.  A mesh has about as many cells
    as edges, so the edges of a cell stay few however large the mesh is.
    """
    e = edges(faces).select(M, "a", "b").distinct()
    n = e.groupBy(M).agg(F.greatest(F.sqrt(F.count(F.lit(1)).cast("double")), F.lit(1.0)).alias("cells"))
    for k in "ab":
        e = e.join(vertices.select(M, F.col("vid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in XYZ]), [M, k])
    e = e.join(bounding_box(vertices).select(M, "xmin", "xmax", "ymin", "ymax").join(n, M), M)
    at = lambda v, c: F.floor((v - F.col(f"{c}min")) / F.greatest(F.col(f"{c}max") - F.col(f"{c}min"), F.lit(1e-300)) * F.col("cells")).cast("int")
    span = lambda c: F.sequence(at(F.least(f"a{c}", f"b{c}"), c), at(F.greatest(f"a{c}", f"b{c}"), c))
    e = e.select("*", F.explode(span("x")).alias("i")).select("*", F.explode(span("y")).alias("j"))
    o = e.select(M, "i", "j", *[F.col(c).alias(f"o_{c}") for c in ("a", "b", "ax", "ay", "bx", "by")])
    both = e.join(o, [M, "i", "j"]).where("a < o_a or (a = o_a and b < o_b)").where("a <> o_a and a <> o_b and b <> o_a and b <> o_b")
    hit = geom.segments_cross((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), (F.col("o_ax"), F.col("o_ay")), (F.col("o_bx"), F.col("o_by")))
    return both.where(hit).select(M, "a", "b", "o_a", "o_b").distinct()


def tin_report(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Violations of a triangulated surface: those of a mesh, and faces that look down or are collapsed, vertices at one place,
    crossing edges and holes."""
    one = lambda df, kind: df.groupBy(M).agg(F.count(F.lit(1)).alias("n")).select(M, F.lit(kind).alias("kind"), "n")
    t = triangles(vertices, faces)
    down = t.where(geom.area2(corner("a"), corner("b"), corner("c")) <= 0)
    same = vertices.groupBy(M, "x", "y").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    parts = [one(down, "down"), one(same, "same place"), one(crossing_edges(vertices, faces), "crossing"), one(areas(vertices, faces).where("not filled"), "hole")]
    out = mesh_report(vertices, faces)
    for p in parts:
        out = out.unionByName(p)
    return out


def different(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triangles of two soups that are not in the other as often: rows of both sides.  A triangle is equal to its rotations,
    not to its mirror image."""
    key = lambda df: df.select(geom.canonical(*[F.struct(*[F.col(f"{k}{c}").alias(c) for c in XYZ]) for k in "abc"]).alias("t"))
    x, y = key(a), key(b)
    return x.exceptAll(y).select("t", F.lit("left").alias("side")).unionAll(y.exceptAll(x).select("t", F.lit("right").alias("side")))


def close_pairs(vertices: DataFrame, eps: float, across: bool = True, dims: tuple[str, ...] = XYZ) -> DataFrame:
    """Pairs of vertices nearer than eps, of different meshes or (not `across`) of the same.

    A vertex is put into its cell of size eps and the join partner into all neighbouring cells, so the join is an equi-join."""
    cell = [F.floor(F.col(c) / eps).cast("long").alias(f"k{c}") for c in dims]
    left = vertices.select(F.col(M).alias("m1"), F.col("vid").alias("v1"), *[F.col(c).alias(f"l{c}") for c in dims], *cell)
    right = vertices.select(F.col(M).alias("m2"), F.col("vid").alias("v2"), *[F.col(c).alias(f"r{c}") for c in dims])
    for c in dims:
        k = F.floor(F.col(f"r{c}") / eps).cast("long")
        right = right.withColumn(f"k{c}", F.explode(F.array(k - 1, k, k + 1)))
    both = left.join(right, [f"k{c}" for c in dims])
    both = both.where("m1 < m2") if across else both.where("m1 = m2 and v1 < v2")
    d = geom.distance2(tuple(F.col(f"l{c}") for c in dims), tuple(F.col(f"r{c}") for c in dims))
    return both.select("m1", "v1", "m2", "v2", F.sqrt(d).alias("distance")).where(F.col("distance") < eps)


def close_boxes(vertices: DataFrame, eps: float) -> DataFrame:
    """Pairs of meshes whose boxes, each grown by eps, share a point: m1 < m2.

    Boxes meet in the cells they touch of a grid as wide as the largest box, so a box has a few keys at most."""
    b = bounding_box(vertices)
    w = b.agg(F.max(F.greatest(*[F.col(f"{c}max") - F.col(f"{c}min") for c in "xy"])).alias("w"))
    w = F.lit(float((w.first().w or 0.0) + 2 * eps) or 1.0)
    at = lambda c: F.floor(F.col(c) / w).cast("long")
    grown = b.select(M, *[(F.col(f"{c}{e}") + (eps if e == "max" else -eps)).alias(f"{c}{e}") for c in XYZ for e in ("min", "max")])
    keyed = grown.select("*", F.explode(F.sequence(at("xmin"), at("xmax"))).alias("i")).select("*", F.explode(F.sequence(at("ymin"), at("ymax"))).alias("j"))
    other = keyed.select("i", "j", F.col(M).alias("m2"), *[F.col(f"{c}{e}").alias(f"o{c}{e}") for c in XYZ for e in ("min", "max")])
    both = keyed.withColumnRenamed(M, "m1").join(other, ["i", "j"]).where("m1 < m2")
    for c in XYZ:
        both = both.where((F.col(f"{c}min") <= F.col(f"o{c}max")) & (F.col(f"o{c}min") <= F.col(f"{c}max")))
    return both.select("m1", "m2").distinct()


def components(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """Least id of the component of each id in pairs (a, b): rounds of the least neighbouring label and of pointer jumps,
    each written to the shared folder, until nothing changes."""
    both = written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "pairs")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("l")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("n"))
        step = label.join(near, "id").select("id", F.least("l", "n").alias("l"), F.col("l").alias("old"))
        jump = step.join(step.select(F.col("id").alias("l"), F.col("l").alias("ll")), "l", "left").select("id", F.least("l", F.coalesce("ll", "l")).alias("l"), "old")
        jump = written(jump, "labels")
        moved = jump.where("l <> old").limit(1).count()
        label = jump.select("id", "l")
        if not moved:
            return label


def pieces(faces: DataFrame) -> DataFrame:
    """Number of connected pieces of each mesh."""
    top = F.lit(1 << 32)
    code = lambda c: F.col(M).cast("long") * top + F.col(c).cast("long")
    pairs = faces.select(code("a").alias("a"), code("b").alias("b")).union(faces.select(code("b"), code("c")))
    comp = components(faces.sparkSession, pairs)
    return comp.groupBy(F.floor(F.col("id") / top).cast("int").alias(M)).agg(F.countDistinct("l").alias("pieces"))


def weld(vertices: DataFrame, eps: float) -> DataFrame:
    """Mapping (mesh_id, vid, merged_vid) that merges vertices of different meshes nearer than eps, and chains of them.

    Merged numbers follow the order of the least (mesh, vertex) of each group."""
    v = vertices.select(M, "vid")
    top = F.lit(1 << 32)
    code = lambda m, k: F.col(m).cast("long") * top + F.col(k).cast("long")
    pairs = close_pairs(vertices, eps).select(code("m1", "v1").alias("a"), code("m2", "v2").alias("b"))
    comp = components(vertices.sparkSession, pairs)
    own = v.withColumn("id", code(M, "vid")).join(comp, "id", "left").select(M, "vid", F.coalesce("l", "id").alias("group"))
    number = numbered(own.select("group").distinct().withColumn("all", F.lit(0)), "all", "group", "merged_vid").drop("all")
    return own.join(number, "group").select(M, "vid", "merged_vid")


def apply_mapping(vertices: DataFrame, faces: DataFrame, mapping: DataFrame, mesh_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Merged mesh: of vertices that became one, the last by (mesh, vertex) gives position and texture coordinates; faces
    that collapse are dropped."""
    values = [c for c in vertices.columns if c not in (M, "vid")]
    v = vertices.join(mapping, [M, "vid"]).groupBy(F.col("merged_vid").alias("vid")).agg(F.max_by(F.struct(*values), F.struct(M, "vid")).alias("s"))
    f = faces
    for k in "abc":
        f = f.join(mapping.select(M, F.col("vid").alias(k), F.col("merged_vid").alias(f"n{k}")), [M, k])
    f = f.select(F.col(M).alias("m0"), "fid", F.col("na").alias("a"), F.col("nb").alias("b"), F.col("nc").alias("c")).where("a <> b and b <> c and a <> c")
    f = numbered(f.withColumn("order", F.col("m0").cast("long") * F.lit(1 << 32) + F.col("fid")).withColumn(M, F.lit(mesh_id)), M, "order", "n")
    return v.select(F.lit(mesh_id).alias(M), "vid", "s.*"), f.select(M, F.col("n").alias("fid"), "a", "b", "c")


def all_connected(vertices: DataFrame, mapping: DataFrame) -> bool:
    """Whether shared merged vertices tie all meshes together (a graph of meshes, not of vertices)."""
    shared_ = mapping.groupBy("merged_vid").agg(F.min(M).alias("a"), F.max(M).alias("z"), F.collect_set(M).alias("all")).where("a < z")
    pairs = shared_.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    meshes = vertices.select(F.col(M).alias("id")).distinct()
    comp = components(vertices.sparkSession, pairs)
    return meshes.join(comp, "id", "left").select(F.coalesce("l", "id").alias("g")).distinct().count() <= 1


def merge_meshes(vertices: DataFrame, faces: DataFrame, eps: float | None = None, tries: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged vertices, faces and the mapping.

    Without an eps the thousandth part of the shortest edge is tried first and made ten times as large until all meshes are
    connected; at most `tries` times."""
    if eps is None:
        eps = min_edge_length(vertices, faces).agg(F.min("length")).first()[0] / 1000
        for _ in range(tries):
            mapping = written(weld(vertices, eps), "mapping")
            if all_connected(vertices, mapping):
                break
            eps *= 10
        else:
            raise ValueError("the meshes have no common border")
    else:
        mapping = written(weld(vertices, eps), "mapping")
    v, f = apply_mapping(vertices, faces, mapping)
    return v, f, mapping


def inverse_faces(merged: DataFrame, mapping: DataFrame) -> DataFrame:
    """For each merged face the first mesh that has all three corners, and their numbers there."""
    out = merged.select("fid", "a", "b", "c")
    for k in "abc":
        m = mapping.select(F.col("merged_vid").alias(k), F.col(M).alias(f"m{k}"), F.col("vid").alias(f"v{k}"))
        out = out.join(m, k) if k == "a" else out.join(m, k).where(f"m{k} = ma")
    return out.groupBy("fid").agg(F.min(F.struct(F.col("ma").alias(M), "va", "vb", "vc")).alias("s")).select("fid", "s.*")


def mapping_report(mapping: DataFrame) -> DataFrame:
    """Number of meshes, vertices and merged vertices, the greatest merged number, and vertices that map twice."""
    twice = mapping.groupBy(M, "vid").agg(F.countDistinct("merged_vid").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("ambiguous"))
    a = mapping.agg(F.countDistinct(M).alias("meshes"), F.count(F.lit(1)).alias("vertices"), F.countDistinct("merged_vid").alias("merged"), F.max("merged_vid").alias("last"))
    return a.crossJoin(twice)  # a row each


def min_separation(vertices: DataFrame, mapping: DataFrame, reach: float) -> DataFrame:
    """Least distance of vertices of different meshes that stayed apart, as far as they are nearer than `reach`."""
    p = close_pairs(vertices, reach)
    for i in "12":
        p = p.join(mapping.select(F.col(M).alias(f"m{i}"), F.col("vid").alias(f"v{i}"), F.col("merged_vid").alias(f"g{i}")), [f"m{i}", f"v{i}"])
    return p.where("g1 <> g2").agg(F.min("distance").alias("distance"))


def grid_faces(size: DataFrame, step: int = 1) -> tuple[DataFrame, DataFrame]:
    """Dense grid over rasters (raster_id, width, height): vertices (raster_id, vid, row, col) at every `step` pixels and in the
    last row and column, and two faces for each quad, looking up."""
    axis = lambda c: F.array_union(F.sequence(F.lit(0), F.col(c) - 1, F.lit(step)), F.array(F.col(c) - 1))
    s = size.select(ID, axis("height").alias("rows"), axis("width").alias("cols"))
    v = s.select(ID, F.size("cols").alias("n"), "cols", F.posexplode("rows").alias("i", "row"))
    v = v.select(ID, "n", "i", "row", F.posexplode("cols").alias("j", "col"))
    vertices = v.select(ID, (F.col("i") * F.col("n") + F.col("j")).alias("vid"), "row", "col")
    q = s.select(ID, F.size("cols").alias("n"), F.explode(F.sequence(F.lit(0), F.size("rows") - 1)).alias("i"), F.size("rows").alias("m")).where("i < m - 1")
    q = q.select(ID, "n", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j")).where("j < n - 1")
    at = F.col("i") * F.col("n") + F.col("j")
    quad = F.col("i") * (F.col("n") - 1) + F.col("j")
    # row 0 is north: upper left, lower left, upper right and upper right, lower left, lower right are counter-clockwise
    two = F.array(F.struct((quad * 2).alias("fid"), at.alias("a"), (at + F.col("n")).alias("b"), (at + 1).alias("c")), F.struct((quad * 2 + 1).alias("fid"), (at + 1).alias("a"), (at + F.col("n")).alias("b"), (at + F.col("n") + 1).alias("c")))
    return vertices, q.select(ID, F.explode(two).alias("f")).select(ID, "f.*")


def grid_mesh(raster: DataFrame, size: DataFrame, x0: float, y0: float, cell: float, step: int = 1, fill_radius: int = 64) -> tuple[DataFrame, DataFrame]:
    """Dense grid mesh of rasters: positions from the lower left pixel (x0, y0).

    Missing pixels (null, or without a row) take the height of the nearest valid ones within `fill_radius`; where there are
    none, the vertex goes with its faces, and the numbers close up."""
    v, f = grid_faces(size, step)
    v, f = v.withColumnRenamed(ID, M), f.withColumnRenamed(ID, M)
    full = blank(size).drop("z").join(raster.select(ID, "row", "col", "z"), [ID, "row", "col"], "left")
    full = full if full.where("z is null").isEmpty() else fill_missing(full, 1, fill_radius)
    z = full.where("z is not null").withColumnRenamed(ID, M)
    v = v.join(z, [M, "row", "col"]).join(size.select(F.col(ID).alias(M), "height"), M)
    y = F.lit(y0) + (F.col("height") - 1 - F.col("row")) * F.lit(cell)
    vertices = written(v.select(M, F.col("vid").cast("long").alias("vid"), (F.lit(x0) + F.col("col") * F.lit(cell)).alias("x"), y.alias("y"), "z"), "grid")
    for k in "abc":
        f = f.join(vertices.select(M, F.col("vid").alias(k)), [M, k], "left_semi")
    return renumber(vertices, f.select(M, "fid", "a", "b", "c"))


def steps_for_vertices(width: int, height: int, count: int) -> int:
    """Step of a dense grid that comes near a number of vertices along the longer side."""
    return max(1, (max(width, height) - 1) // max(1, count - 1))


def reference_mesh(pixels: DataFrame, gt: tuple[float, float, float, float], width: int, bounds: tuple[float, float, float, float], exclusive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Full-resolution mesh of the part of rasters within bounds, straight from pixels.

    gt: x of the left edge, pixel width, y of the upper edge and (negative) pixel height.  Vertices are pixel centres; a quad
    of four valid pixels counts if the corner they share lies within the bounds, or (exclusive) if all of them do.  Unused
    vertices are dropped; texture coordinates are the position in the used vertices' box.
    """
    x0, dx, y1, dy = gt
    xmin, ymin, xmax, ymax = bounds
    x = lambda c: F.lit(x0) + c * F.lit(dx)
    y = lambda r: F.lit(y1) + r * F.lit(dy)
    ok = pixels.where(F.col("z").between(-20000, 20000) & ~F.isnan("z"))
    q = quads(ok)
    inside = lambda px, py: px.between(xmin, xmax) & py.between(ymin, ymax)
    if exclusive:
        q = q.where(inside(x(F.col("col") + 0.5), y(F.col("row") + 0.5)) & inside(x(F.col("col") + 1.5), y(F.col("row") + 1.5)))
    else:
        q = q.where(inside(x(F.col("col") + 1.0), y(F.col("row") + 1.0)))
    at = F.col("row").cast("long") * width + F.col("col")
    two = F.array(F.struct((at * 2).alias("fid"), at.alias("a"), (at + width).alias("b"), (at + 1).alias("c")), F.struct((at * 2 + 1).alias("fid"), (at + 1).alias("a"), (at + width).alias("b"), (at + width + 1).alias("c")))
    faces = q.select(F.col(ID).alias(M), F.explode(two).alias("f")).select(M, "f.*")
    vertices = ok.select(F.col(ID).alias(M), at.alias("vid"), x(F.col("col") + 0.5).alias("x"), y(F.col("row") + 0.5).alias("y"), "z")
    vertices, faces = renumber(vertices, faces)
    b = bounding_box(vertices).select(M, "xmin", "xmax", "ymin", "ymax")
    part = lambda c: F.when(F.col(f"{c}max") > F.col(f"{c}min"), (F.col(c) - F.col(f"{c}min")) / (F.col(f"{c}max") - F.col(f"{c}min"))).otherwise(0.0)
    return vertices.join(b, M).select(M, "vid", "x", "y", "z", part("x").alias("u"), part("y").alias("v")), faces


def covered_pixels(tri: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Integer pixels (px, py) in each triangle with corners (ax .. cy) in pixel coordinates, by the top-left rule."""
    lo = lambda c: F.ceil(F.least(f"a{c}", f"b{c}", f"c{c}")).cast("int")
    hi = lambda c: F.floor(F.greatest(f"a{c}", f"b{c}", f"c{c}")).cast("int")
    t = tri.where((lo("x") <= hi("x")) & (lo("y") <= hi("y")))
    t = t.select("*", F.explode(F.sequence(lo("y"), hi("y"))).alias("py")).select("*", F.explode(F.sequence(lo("x"), hi("x"))).alias("px"))
    p, abc = (F.col("px").cast("double"), F.col("py").cast("double")), [(F.col(f"{k}x"), F.col(f"{k}y")) for k in "abc"]
    return t.where(geom.in_triangle(p, *abc)).select(*keep, "px", "py", *[f"{k}{c}" for k in "abc" for c in XYZ])


def rasterize(tri: DataFrame, raster: str = M) -> DataFrame:
    """Heights at the integer pixels that triangles cover, their boundary included; where several do, the last face's."""
    lo = lambda c: F.ceil(F.least(f"a{c}", f"b{c}", f"c{c}")).cast("int")
    hi = lambda c: F.floor(F.greatest(f"a{c}", f"b{c}", f"c{c}")).cast("int")
    t = tri.where((lo("x") <= hi("x")) & (lo("y") <= hi("y")))
    t = t.select("*", F.explode(F.sequence(lo("y"), hi("y"))).alias("py")).select("*", F.explode(F.sequence(lo("x"), hi("x"))).alias("px"))
    z = geom.interpolate((F.col("px").cast("double"), F.col("py").cast("double")), corner("a"), corner("b"), corner("c"))
    t = t.select(raster, "fid", "px", "py", z.alias("z")).where("z is not null")
    return t.groupBy(raster, "px", "py").agg(F.max_by("z", "fid").alias("z"))
