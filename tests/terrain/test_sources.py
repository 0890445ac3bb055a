"""Readers and writers: round trips."""

import numpy as np
import pytest

from quadspark.operators import encode, local, mesh
from quadspark.sources import binary, files, text

XYZ = np.array([(0, 0, np.pi), (1, 0, 2.5), (1, 1, -3), (0, 1, 4)], float)
FACES = np.array([(0, 1, 2), (0, 2, 3)])


def tables(spark, ids=(1, 2)):
    v = [(m, i, *map(float, x + m)) for m in ids for i, x in enumerate(XYZ)]
    f = [(m, i, *map(int, t)) for m in ids for i, t in enumerate(FACES)]
    return spark.createDataFrame(v, "mesh_id int, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id int, fid long, a long, b long, c long")


def test_png():
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (4, 3, 3), (3, 2, 4), (1, 1)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        assert (binary.read_png(binary.png(a)) == a).all()
    with pytest.raises(ValueError):
        binary.read_png(b"none")


def test_geotiff(spark, tmp_path):
    z = np.arange(12, dtype=np.float64).reshape(3, 4)
    z[1, 2] = np.nan
    for dtype in (np.float32, np.float64):
        content = binary.geotiff(np.where(np.isnan(z), -9999, z).astype(dtype), (10.0, 0.5, 50.0, -0.25), 4326, -9999)
        got, gt, epsg, none = binary.read_geotiff(content)
        assert np.array_equal(got, z, equal_nan=True) and gt == (10.0, 0.5, 50.0, -0.25) and (epsg, none) == (4326, -9999)
    (tmp_path / "a.tif").write_bytes(content)
    f = files.read_files(spark, str(tmp_path), ".tif")
    assert {(r.row, r.col): r.z for r in binary.read_rasters(f).collect()} == {(i, j): None if np.isnan(z[i, j]) else z[i, j] for i in range(3) for j in range(4)}
    assert binary.raster_headers(f).first().asDict() == {"raster_id": "a", "epsg": 4326, "width": 4, "height": 3, "gt": [10.0, 0.5, 50.0, -0.25], "nodata": -9999.0}


def test_glb(spark, tmp_path):
    big = XYZ + (4085862.25, 1200403.5, 4732509.125)
    p, f, uv, tex, extras = binary.read_glb(binary.glb(big, FACES, XYZ[:, :2], b"image", {"epsg": 4978}))
    assert np.abs(p - big).max() < 1e-6 and (f == FACES).all() and np.allclose(uv, XYZ[:, :2]) and tex == b"image" and extras == {"epsg": 4978}
    v, t = tables(spark)
    done = files.write_files(binary.glb_files(v, t), str(tmp_path)).collect()
    assert sorted(r.path for r in done) == ["1.glb", "2.glb"] and all(r.written for r in done)
    assert not any(r.written for r in files.write_files(binary.glb_files(v, t), str(tmp_path), skip_existing=True).collect())
    back, faces = local.split(binary.read_glb_files(files.read_files(spark, str(tmp_path), ".glb")))
    assert back.count() == 8 and faces.count() == 4
    assert mesh.different(mesh.triangles(v, t).selectExpr("*"), mesh.triangles(v, t)).count() == 0


def test_quantized_mesh(spark, tmp_path):
    rng = np.random.default_rng(3)
    u, v, h = (rng.integers(0, 32768, 50) for _ in range(3))
    u[:5] = 0
    f = local.delaunay(np.stack((u, v), axis=1).astype(float))
    head = {"centre": (1.0, 2.0, 3.0), "min_h": 4.0, "max_h": 5.0, "sphere": (1.0, 2.0, 3.0, 9.0), "occlusion": (0.5, 0.25, 0.125)}
    u2, v2, h2, f2, got = binary.read_quantized_mesh(binary.quantized_mesh(u, v, h, f, head))
    assert got == head
    assert [(u2[i], v2[i], h2[i]) for i in f2.ravel()] == [(u[i], v[i], h[i]) for i in f.ravel()]
    import gzip

    assert (binary.read_quantized_mesh(gzip.compress(binary.quantized_mesh(u, v, h, f, head)))[3] == f2).all()
    ve, t = tables(spark)
    geo = ve.selectExpr("mesh_id", "x", "y", "z")
    q = ve.selectExpr("mesh_id", "vid", "cast(x * 100 as int) u", "cast(y * 100 as int) v", "cast(z + 10 as int) h")
    rows = binary.quantized_mesh_files(q, t, encode.header(geo)).collect()
    assert sorted(r.path for r in rows) == ["1.terrain", "2.terrain"]
    assert all((binary.read_quantized_mesh(bytes(r.content))[3].shape == (2, 3)) for r in rows)


def test_text_meshes(spark, tmp_path):
    v, t = tables(spark)
    for name, make, read in (("obj", text.obj_files, text.read_obj), ("off", text.off_files, text.read_off)):
        d = tmp_path / name
        files.write_files(make(v, t), str(d)).collect()
        bv, bf = read(spark, str(d))
        same = lambda df: df.drop("mesh_id", "fid")
        assert mesh.different(same(mesh.triangles(bv, bf)), same(mesh.triangles(v, t))).collect() == []
    (tmp_path / "c.off").write_text("OFF # head\n\n3 1 0\n0 0 0 # first\n1 0 0\n0 1 0\n3 0 1 2\n")
    bv, bf = text.read_off(spark, str(tmp_path / "c.off"))
    assert bv.count() == 3 and [(r.a, r.b, r.c) for r in bf.collect()] == [(0, 1, 2)]
    import json

    for r in text.geojson_files(mesh.triangles(v, t), v).collect():
        assert len(json.loads(r.content)["features"]) == 6


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nxll 10.5\nyll 20\ncellsize 2\nnodata -9\n1 2.5 -9\n 4 5 6 \n")
    head, pix = text.read_ascii_grid(spark, str(tmp_path / "a.asc"))
    h = head.first()
    assert (h.width, h.height, h.x0, h.y0, h.cell, h.no_data) == (3, 2, 10.5, 20.0, 2.0, -9.0)
    want = {(0, 0): 1.0, (0, 1): 2.5, (0, 2): None, (1, 0): 4.0, (1, 1): 5.0, (1, 2): 6.0}
    assert {(r.row, r.col): r.z for r in pix.collect()} == want
    own = lambda df: df.withColumn("raster_id", df.raster_id.substr(-5, 1))
    files.write_files(text.ascii_grids(own(pix), own(head)), str(tmp_path / "out")).collect()
    _, again = text.read_ascii_grid(spark, str(tmp_path / "out"))
    assert {(r.row, r.col): r.z for r in again.collect()} == want
    (tmp_path / "bad.asc").write_text("ncols 3\nnrows 1\nx 0\ny 0\nc 1\nn -9\n1 2\n")
    with pytest.raises(Exception, match="not as many values"):
        text.read_ascii_grid(spark, str(tmp_path / "bad.asc"))[1].collect()


def test_xyz_and_images(spark, tmp_path):
    (tmp_path / "p.xyz").write_text("1 2 3\n4 5 nan\n7 8 20000\nx y z\n 1.5  2.5 -3.5 \n")
    assert sorted((r.x, r.y, r.z) for r in text.read_xyz(spark, str(tmp_path / "p.xyz")).collect()) == [(1.0, 2.0, 3.0), (1.5, 2.5, -3.5)]
    px = spark.createDataFrame([(7, r, c, r * 10 + c) for r in range(3) for c in range(4)], "image_id int, row int, col int, value int")
    from pyspark.sql import functions as F

    files.write_files(binary.png_files(px, lambda i: F.concat(F.lit("3/2/"), i.cast("string"), F.lit(".png"))), str(tmp_path / "t")).collect()
    assert [(r.zoom, r.x, r.y) for r in files.existing_tiles(spark, str(tmp_path / "t"), ".png").collect()] == [(3, 7, 2)]
    back = binary.png_pixels(files.read_files(spark, str(tmp_path / "t"), ".png"))
    assert {(r.row, r.col): r.value for r in back.collect()} == {(r, c): r * 10 + c for r in range(3) for c in range(4)}


def test_by_format(spark, tmp_path):
    from quadspark.sources.meshes import load_meshes, save_meshes

    v, t = tables(spark)
    for kind in ("obj", "off", "glb", "geojson", "parquet"):
        save_meshes(v, t, str(tmp_path / kind), kind).collect()
        if kind != "geojson":
            bv, bf = load_meshes(spark, str(tmp_path / kind), kind)
            assert (bv.count(), bf.count()) == (8, 4)
    with pytest.raises(ValueError):
        save_meshes(v, t, str(tmp_path), "stl")
    assert {r.pieces for r in mesh.pieces(t).collect()} == {1}


def test_atlas():
    a, b = np.full((4, 4, 3), 10.0), np.full((4, 4, 3), 20.0)
    half = np.array([[(0, 0), (1, 0), (1, 1)], [(0, 0), (1, 1), (0, 1)]], float)
    out = local.warp_textures([a, b], half, half, np.array([0, 1]), (9, 9))
    assert (out[:, :, 0] > 0).all() and out[8, 8, 0] in (10, 20) and out[7, 8, 0] == 10 and out[0, 1, 0] == 20
    ramp = np.broadcast_to(np.arange(5.0)[None, :, None], (5, 5, 1))
    same = local.warp_textures([ramp], half, half, np.array([0, 0]), (5, 5))
    assert np.allclose(same, ramp)
