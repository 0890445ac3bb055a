"""Known facts of tile grids, coordinate systems, meshing, merging and textures."""

import math

import pytest
from pyspark.sql import functions as F

from quadspark.functions import geom, grid, srs
from quadspark.operators import encode, mesh, raster, texture, tiles
from quadspark.plans import hierarchy

AUSTRIA = (9.323270147, 46.077736128, 17.58967912, 49.222158096)


def austria(spark):
    x0, y0, x1, y1 = (F.lit(v) for v in AUSTRIA)
    a, b = srs.to_mercator(x0, y0), srs.to_mercator(x1, y1)
    return spark.range(1).select(a[0].alias("xmin"), a[1].alias("ymin"), b[0].alias("xmax"), b[1].alias("ymax"))


def test_grids(spark):
    m, g = grid.mercator(), grid.geodetic(64)
    assert (m.epsg, g.epsg, round(m.half_width)) == (3857, 4326, 20037508)
    row = spark.range(1).select(*[v.alias(k) for k, v in m.bounds(F.lit(0), F.lit(0), F.lit(0)).items()]).first()
    assert (row.xmin, row.xmax) == pytest.approx((-m.half_width, m.half_width))
    row = spark.range(1).select(g.descriptor(F.lit(0), F.lit(0), F.lit(0), border=True).alias("d")).first().d
    assert row.tile_size == 65 and row.xmax == pytest.approx(180 / 64) and row.ymax == pytest.approx(90 + 180 / 64)


def test_covering_tiles(spark):
    t = tiles.covering_tiles(austria(spark), grid.mercator(), (0, 7)).collect()
    by = {z: sorted((r.x, r.y) for r in t if r.zoom == z) for z in range(8)}
    assert [len(by[z]) for z in range(8)] == [1, 1, 1, 1, 1, 4, 6, 12] and len(t) == 27
    assert by[1] == [(1, 1)] and by[2] == [(2, 2)] and by[3] == [(4, 5)] and by[4] == [(8, 10)] and (16, 20) in by[5] and (70, 84) in by[7]
    assert by[6] == [(x, y) for x in (33, 34, 35) for y in (41, 42)]
    s = spark.createDataFrame([(1, 1), (2, 2)], "zoom int, y long").select(grid.slippy_y(F.col("zoom"), F.col("y")).alias("y"))
    assert [r.y for r in s.collect()] == [0, 1]
    h = grid.mercator().half_width
    world = spark.createDataFrame([(-h, -h, h, h)], "xmin double, ymin double, xmax double, ymax double")
    assert tiles.covering_tiles(world, grid.mercator(), (0, 2)).count() == 21
    # children of the root that overlap the bounds are the covering tiles of zoom 1
    root = spark.createDataFrame([(0, 0, 0)], "zoom int, x long, y long")
    b = {k: F.lit(v) for k, v in austria(spark).first().asDict().items()}
    assert [(r.x, r.y) for r in tiles.child_tiles(root, grid.mercator(), b).collect()] == [(1, 1)]
    assert [(r.x, r.y) for r in tiles.child_tiles(root, grid.mercator()).collect()] == [(0, 0), (1, 0), (0, 1), (1, 1)]


def test_ecef(spark):
    df = spark.createDataFrame([(16.372489, 48.208814, 171.28), (12.694504, 47.073913, 3798.0)], "lon double, lat double, h double")
    e = srs.to_ecef(*[F.col(c) for c in ("lon", "lat", "h")])
    got = [tuple(round(v) for v in r) for r in df.select(*[c.alias(k) for c, k in zip(e, "xyz", strict=True)]).collect()]
    assert got == [(4085862, 1200403, 4732509), (4247824, 956860, 4650146)]
    with pytest.raises(ValueError):
        srs.transform(31287, 4326, F.lit(0), F.lit(0))


def mesh_tables(spark, parts, uv=False):
    v = [(m, i, *map(float, p)) for m, (ps, _) in enumerate(parts) for i, p in enumerate(ps)]
    f = [(m, i, *t) for m, (_, ts) in enumerate(parts) for i, t in enumerate(ts)]
    return spark.createDataFrame(v, "mesh_id int, vid long, x double, y double, z double" + (", u double, v double" if uv else "")), spark.createDataFrame(f, "mesh_id int, fid long, a long, b long, c long")


@pytest.mark.parametrize("uv", [False, True])
def test_merge_two_triangles(spark, uv):
    more = (lambda p: (*p, p[0] / 2, p[1] / 2)) if uv else tuple
    a = [more(p) for p in ((0, 0, 0), (1, 0, 0), (0, 1, 0))]
    b = [more(p) for p in ((1, 0, 0), (1, 1, 0), (0, 1, 0))]
    v, f, m = mesh.merge_meshes(*mesh_tables(spark, [(a, [(0, 1, 2)]), (b, [(0, 1, 2)])], uv), eps=0.1)
    assert v.count() == 4 and [(r.a, r.b, r.c) for r in f.orderBy("fid").collect()] == [(0, 1, 2), (1, 3, 2)]
    assert mesh.all_connected(*mesh_tables(spark, [(a, []), (b, [])], uv)[:1], m)
    if uv:
        assert {(r.u, r.v) for r in v.collect()} == {(0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)}


def test_merge_quads(spark):
    q = lambda x0, x1, y: [(x0[0], 0, 0), (x1, 0, 0), (x1, 1, 0), (x0[1], 1, 0)]
    a, b = q((0, 0), 1, 0), q((0.91, 1.11), 2, 0)
    v, f, _ = mesh.merge_meshes(*mesh_tables(spark, [(a, [(0, 1, 2), (0, 2, 3)]), (b, [(0, 1, 2), (0, 2, 3)])]), eps=0.1)
    xs = sorted(r.x for r in v.collect())
    assert len(xs) == 7 and 0.91 in xs and 1.11 in xs and f.count() == 4
    # without an eps it grows until the meshes meet
    v, _, m = mesh.merge_meshes(*mesh_tables(spark, [(a, [(0, 1, 2), (0, 2, 3)]), (b, [(0, 1, 2), (0, 2, 3)])]))
    assert mesh.mapping_report(m).first().ambiguous == 0


def sine(spark, h=20, w=11):
    return spark.createDataFrame([(0, r, c, math.sin(c) * math.sin(r)) for r in range(h) for c in range(w)], "raster_id int, row int, col int, z double"), spark.createDataFrame([(0, w, h)], "raster_id int, width int, height int")


@pytest.mark.parametrize("step,faces", [(1, 380), (2, 100), (3, 56), (4, 30)])
def test_dense_grid(spark, step, faces):
    r, s = sine(spark)
    v, f = mesh.grid_mesh(r, s, 42.0, 23.0, 1.5, step)
    assert f.count() == faces
    b = mesh.bounding_box(v).first()
    assert (b.xmin, b.xmax, b.ymin, b.ymax) == (42.0, 42 + 10 * 1.5, 23.0, 23 + 19 * 1.5)
    assert mesh.tin_report(v, f).collect() == [] and mesh.is_square(v).first().square


def test_rasters(spark):
    p = spark.createDataFrame([(float(x), float(y), float(y * 4 + x)) for y in range(4) for x in range(4)], "x double, y double, z double")
    assert sorted(r.z for r in raster.points_to_raster(p).where("row = 0").collect()) == [12, 13, 14, 15]
    ones = spark.createDataFrame([(0, r, c, 1.0) for r in range(8) for c in range(10)], "raster_id int, row int, col int, z double")
    d = raster.downsample(ones, 2, 2, 8, 10).collect()
    assert len(d) == 20 and all(r.z == 1.0 for r in d)
    hole = spark.createDataFrame([(0, r, c, {(0, 0): 3.0, (0, 10): 6.0, (10, 0): 12.0, (10, 10): 24.0}.get((r, c))) for r in range(11) for c in range(11)], "raster_id int, row int, col int, z double")
    got = {(r.row, r.col): r.z for r in raster.fill_missing(hole, 3, 16).collect()}
    assert len(got) == 121 and got[5, 5] == pytest.approx(11.25) and got[0, 0] == 3.0
    assert {r.z for r in raster.fill_missing(hole, 5, 4).where("row = 5 and col = 5").collect()} == {None}


def test_broken_meshes_are_reported(spark):
    good = ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2), (0, 2, 3)])
    bad = {
        "down": (good[0], [(0, 1, 2), (0, 3, 2)]), "index": (good[0], [(0, 1, 2), (0, 2, 9)]), "degenerate": (good[0], [(0, 1, 2), (0, 2, 2)]),
        "duplicate": (good[0], [(0, 1, 2), (0, 2, 3), (1, 2, 0)]), "isolated": ([*good[0], (5, 5, 5)], good[1]), "hole": (good[0], [(0, 1, 2)]),
    }
    assert mesh.tin_report(*mesh_tables(spark, [good])).collect() == []
    for kind, m in bad.items():
        assert kind in {r.kind for r in mesh.tin_report(*mesh_tables(spark, [m])).collect()}, kind
    cross = ([(0, 0, 0), (4, 0, 0), (2, 3, 0), (2, -1, 0), (4, 2, 0), (0, 2, 0)], [(0, 1, 2), (3, 4, 5)])
    assert "crossing" in {r.kind for r in mesh.tin_report(*mesh_tables(spark, [cross])).collect()}


def test_texture(spark):
    m = grid.mercator()
    h = m.half_width
    t = lambda rows: spark.createDataFrame(rows, "zoom int, x long, y long")
    pick = lambda rows, z=4: [(r.zoom, r.x, r.y) for r in texture.tiles_to_paint(t(rows), m, (-h, -h, h, h), (0, 0, 0), z).collect()]
    kids = [(1, x, y) for x in (0, 1) for y in (0, 1)]
    assert pick([(0, 0, 0)]) == [(0, 0, 0)]
    assert sorted(pick([(0, 0, 0), *kids])) == sorted(kids)
    assert pick([(0, 0, 0), *kids], 0) == [(0, 0, 0)]
    assert pick([(0, 0, 0), *kids[:3]]) == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 0, 1)]
    assert pick([(9, 0, 0)]) == []
    px = spark.createDataFrame([(0, 0, 0, 0, 0, 1), (1, 0, 1, 0, 0, 3), (1, 0, 0, 0, 0, 2)], "zoom int, x long, y long, row int, col int, value int")
    got = {(r.row, r.col): r.value for r in texture.texture(px, m, (-h, -h, h, h), (0, 0, 0), 1, (1, 1), (2, 2)).collect()}
    assert got == {(0, 0): 3, (1, 0): 2, (0, 1): 1, (1, 1): 1}
    i = spark.createDataFrame([(0, r, c, float(r + c)) for r in range(4) for c in range(4)], "image_id int, row int, col int, value double")
    assert {(r.row, r.col): r.value for r in texture.resize(i, (4, 4), (2, 2)).collect()} == {(0, 0): 1.0, (0, 1): 3.0, (1, 0): 3.0, (1, 1): 5.0}


def test_encodings(spark):
    df = spark.createDataFrame([(v,) for v in (-32768, -1, 0, 1, 32767)], "v int")
    assert [tuple(r) for r in df.select(encode.zigzag(F.col("v")), encode.unzigzag(encode.zigzag(F.col("v")))).collect()] == [(65535, -32768), (1, -1), (0, 0), (2, 1), (65534, 32767)]
    row = spark.range(1).select(encode.parse_bool(F.lit(" Yes")).alias("a"), encode.parse_uint(F.lit("12x")).alias("b"), encode.key_values(F.lit("a=1&b=2")).alias("c"), encode.stem(F.lit("/x/y.z/name.tar.gz")).alias("d"), encode.data_uri(encode.mime_type(F.lit("a.PNG")), F.lit(b"hi")).alias("e"), encode.aligned(F.lit(5)).alias("f")).first()
    assert tuple(row) == (True, None, {"a": "1", "b": "2"}, "name.tar", "data:image/png;base64,aGk=", 8)
    h = spark.createDataFrame([(0.0,), (8848.5,), (-430.25,)], "h double")
    assert [r[0] for r in h.select(encode.rgb_to_height(*encode.height_to_rgb(F.col("h")))).collect()] == [0.0, 8848.5, -430.25]


def test_clip(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(1.0).alias("z"))
    out = spark.range(1).select(geom.clip_to_unit_square(p(-1, -1), p(3, -1), p(-1, 3)).alias("t")).first().t
    area = sum((t[1].x - t[0].x) * (t[2].y - t[0].y) - (t[1].y - t[0].y) * (t[2].x - t[0].x) for t in out) / 2
    assert area == pytest.approx(1.0) and all(0 <= q.x <= 1 and 0 <= q.y <= 1 and q.z == 1 for t in out for q in t)
    assert spark.range(1).select(geom.clip_to_unit_square(p(2, 2), p(3, 2), p(2, 3)).alias("t")).first().t == []


def test_work_lists(spark):
    done = spark.createDataFrame([(4, 0, 0), (4, 1, 1), (4, 3, 2), (3, 0, 0), (9, 9, 9)], "zoom int, x long, y long")
    assert hierarchy.build_list(spark, (3, 0, 0), 5, done, intermediate=True).count() == 1 + 4 + 16 - 3
    m = {(r.zoom, r.x, r.y): (len(r.children), r.max_error) for r in hierarchy.merge_list(done, (2, 0, 0), 4).collect()}
    assert m == {(3, 1, 1): (1, 19568.0), (2, 0, 0): (2, 39136.0)}
    d = hierarchy.download_list(spark, spark.createDataFrame([(1, 0, 1)], "zoom int, x long, y long"), 2, "https://t.example.org/{zoom}/{y}/{x}{ext}").orderBy("path").collect()
    assert len(d) == 5 and d[0].url == "https://t.example.org/1/0/0.jpeg" and d[0].path == "1/0/0.jpeg"
    assert hierarchy.convert_list(spark.createDataFrame([("a", "p"), ("b", "p")], "name string, path string"), spark.createDataFrame([("a",)], "name string")).first().target == "b.glb"


def test_hierarchy(spark):
    n = 4 * 8 + 1
    px = spark.createDataFrame([(r, c, math.sin(r * 0.2) + math.cos(c * 0.15)) for r in range(n) for c in range(n)], "row int, col int, z double")
    levels = hierarchy.build_hierarchy(px, 2, 8, 0.3)
    v2, f2 = levels[2]
    assert f2.count() == 16 * 128 and v2.select("mesh_id").distinct().count() == 16
    for z in (1, 0):
        v, f = levels[z]
        assert mesh.tin_report(v, f).collect() == []
        assert v.select("mesh_id").distinct().count() == 4**z
    assert levels[0][1].count() < levels[1][1].count() < levels[2][1].count()


def test_stream(spark, tmp_path):
    from quadspark.streaming import pyramid

    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", 10.0 + m / 100, 47.0, float(m)) for m in range(50)] + [("2024-01-02 00:00:00", 10.0, 47.0, 99.0)], "t string, x double, y double, z double")
    rows.selectExpr("cast(t as timestamp) ts", "x", "y", "z").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, x double, y double, z double").parquet(str(tmp_path / "in"))
    got = []
    q = pyramid.start(s, grid.geodetic(), 6, str(tmp_path / "ck"), lambda df, n: got.extend(df.collect()))
    q.processAllAvailable()
    q.stop()
    root = [r for r in got if r.zoom == 0]
    assert len(root) == 1 and (root[0].min_h, root[0].max_h, root[0].n) == (0.0, 49.0, 50)
