"""Queries without SQL over every mesh of their tables."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadspark import queries, queries_files
from quadspark.operators import encode, mesh, raster, texture
from quadspark.sources import meshes


def test_every_mesh(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 64).tolist(), 0) for i in range(4 * 50 + 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    faces = {k: 49 * 63 * 2 for k in range(4)} | {4: 5 * 63 * 2}  # the last strip is short
    got = {r.mesh_id: (r.vertices, r.faces) for r in queries.uv_map(spark, str(tmp_path)).collect()}
    assert got == {k: ((50 if k < 4 else 6) * 64, n) for k, n in faces.items()}
    got = {r.mesh_id: r.faces for r in queries.simplified(spark, str(tmp_path)).collect()}
    assert set(got) == set(faces) and all(0 < n <= 0.55 * faces[k] for k, n in got.items())


def test_triangles_are_equal_to_their_rotations_only(spark):
    names = [f"{k}{c}" for k in "abc" for c in "xyz"]
    t = [0.0, 0, 0, 1, 0, 0, 0, 1, 0]
    turned, flipped = t[3:] + t[:3], t[3:6] + t[:3] + t[6:]
    frame = lambda *rows: spark.createDataFrame([list(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names))
    sides = lambda a, b: sorted(r.side for r in mesh.different(frame(*a), frame(*b)).collect())
    assert sides([t], [turned]) == [] and sides([t], [flipped]) == ["left", "right"]
    assert sides([t, t], [turned]) == ["left"] and sides([t], [turned, flipped, t]) == ["right", "right"]


def test_grid_mesh_fills_holes_or_drops_their_faces(spark):
    size = spark.createDataFrame([(0, 3, 3), (1, 4, 4)], "raster_id int, width int, height int")
    px = [(0, r, c, 5.0) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(1, r, c, float(r)) for r in range(4) for c in range(4) if c]
    v, f = mesh.grid_mesh(spark.createDataFrame(px, "raster_id int, row int, col int, z double"), size, 0.0, 0.0, 1.0)
    assert v.count() == 9 + 16 and f.count() == 8 + 18 and v.where("mesh_id = 0 and z <> 5").count() == 0
    assert mesh.mesh_report(v, f).count() == 0
    v, f = mesh.grid_mesh(spark.createDataFrame(px, "raster_id int, row int, col int, z double"), size, 0.0, 0.0, 1.0, fill_radius=0)
    assert mesh.mesh_report(v, f).count() == 0 and f.where("mesh_id = 0").count() == 2 and f.where("mesh_id = 1").count() == 12


def test_formats_by_extension(spark, tmp_path):
    assert meshes.kind_of("a/b.c/7.terrain.gz") == "terrain.gz" and meshes.kind_of("x.OBJ") == "obj"
    with pytest.raises(ValueError):
        meshes.kind_of("x.ply")


def test_queries_have_sql_and_names():
    assert set(queries.ORACLE) <= set(queries.QUERIES) and queries_files.query is queries.query
    assert all(k == f.__name__ for k, f in queries.QUERIES.items())


@pytest.fixture
def strips(spark, tmp_path):
    """A folder of embeddings that makes a strip of 50 rows and one of 6."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 64).tolist(), 0) for i in range(56)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["terrain_faces", "terrain_gz_faces"])
def test_faces_of_packed_files_are_not_broadcast(spark, strips, name):
    got = queries.QUERIES[name](spark, strips)
    assert "SortMergeJoin" in plan(got) and "Broadcast" not in plan(got)
    assert got.count() == (49 + 5) * 63 * 2 and got.select("mesh_id", "fid").distinct().count() == got.count()


def test_fill_sends_values_by_blocks(spark):
    """Values in numpy by hand; and what a round deals out is a few rows a pixel, not one for each pixel of every circle."""
    rng = np.random.default_rng(7)
    z = np.where(rng.random((70, 90)) < 0.6, np.nan, rng.normal(0, 1, (70, 90)))
    z[20:60, 30:80] = np.nan
    px = [(r - 7, c - 11, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(70) for c in range(90)]
    df = spark.createDataFrame(px, "row int, col int, z double").selectExpr("'a' as raster_id", "row", "col", "z")
    smooth = {(r.row, r.col): r.smooth for r in raster.smooth(df).where("smooth is not null").collect()}
    got = {(r.row, r.col): r.z for r in raster.fill_missing(df, 3, 10).collect()}
    assert len(got) == len(px) and any(v is None for v in got.values())
    for r, c, v in px:
        near: dict[int, list[float]] = {}
        for a in range(-10, 11):
            for b in range(-10, 11):
                if (r + a, c + b) in smooth and v is None:
                    near.setdefault(round((a * a + b * b) ** 0.5), []).append(smooth[r + a, c + b])
        held: list[float] = []
        for k in range(1, 11):
            if v is None and len(held) < 3:
                held += near.get(k, [])
        want = v if v is not None else sum(held) / len(held) if len(held) >= 3 else None
        assert (got[r, c] is None) == (want is None) and (want is None or abs(got[r, c] - want) < 1e-9)


def test_fill_does_not_broadcast(spark, strips, monkeypatch):
    """Neither the plan of the result nor those of its rounds."""
    plans = []
    write = mesh.written
    monkeypatch.setattr(mesh, "written", lambda df, name: plans.append(plan(df)) or write(df, name))
    got = queries.nearest_valid_fill(spark, strips)
    assert "Broadcast" not in "".join([*plans, plan(got)])
    assert got.count() == 56 * 64 and got.where("z is null").count() == 0


@pytest.mark.parametrize(("size", "target"), [((8, 8), (5, 12)), ((1, 7), (3, 2)), ((9, 1), (2, 4)), ((3, 5), (17, 5)), ((40, 3), (1, 1))])
def test_resize_without_a_join(spark, size, target):
    (h, w), (th, tw) = size, target
    z = np.random.default_rng(1).normal(0, 1, (h, w))
    df = spark.createDataFrame([(4, r, c, float(z[r, c])) for r in range(h) for c in range(w)], "image_id int, row int, col int, value double")
    out = texture.resize(df, size, target)
    assert "Join" not in plan(out)
    at = lambda n, m: np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    want = np.array([np.interp(at(h, th), np.arange(h), z[:, c]) for c in range(w)]).T
    want = np.array([np.interp(at(w, tw), np.arange(w), want[r]) for r in range(th)])
    got = {(r.row, r.col): r.value for r in out.collect()}
    assert len(got) == th * tw and all(abs(got[r, c] - want[r, c]) < 1e-9 for r in range(th) for c in range(tw))


def test_vertices_beyond_a_million_stay_apart(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4_000_000, 4_000_001, 4_000_002)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert not queries.all_connected(spark, str(tmp_path)).first().apart


def test_short_strip_has_no_southern_edge(spark, strips):
    got = {r.mesh_id: r for r in queries.edge_lists(spark, strips).collect()}
    assert got[0].south == list(range(49 * 64, 50 * 64)) and got[1].south is None and got[1].west == [64 * i for i in range(6)]


def listed(rows: int) -> list[tuple[int, ...]]:
    """Faces of a strip whose corner c is there, as SQL lists them."""
    at = [(r, c, k, r * 64 + c) for r in range(min(rows, 49)) for c in range(63) for k in (0, 1) if r + k < rows]
    return [((r * 63 + c) * 2 + k, i + k, i + 64, i + 1 + k * 64) for r, c, k, i in at]


@pytest.mark.parametrize("kind", ["glb", "obj", "off"])
def test_faces_of_a_short_strip_come_back(spark, strips, kind):
    got = sorted((r.mesh_id, r.fid, r.a, r.b, r.c) for r in queries.QUERIES[f"{kind}_faces"](spark, strips).collect())
    assert got == sorted((m, *f) for m, n in ((0, 50), (1, 6)) for f in listed(n))


def test_data_uris_have_no_line_breaks(spark):
    content = bytes(range(200))
    uri = spark.createDataFrame([(content,)], "c binary").select(encode.data_uri(F.lit("image/png"), F.col("c")).alias("u")).first().u
    assert uri == "data:image/png;base64," + base64.b64encode(content).decode()


def test_report_of_a_short_strip_has_the_kinds_of_sql(spark, strips):
    assert {(r.mesh_id, r.kind) for r in queries.mesh_report(spark, strips).collect()} == {(m, k) for m in (0, 1) for k in ("duplicate", "non-manifold")}
    assert mesh.mesh_report(queries.verts(spark, strips), queries.faces(spark, strips)).where("kind = 'index' and mesh_id = 1").count() == 1


def test_lines_of_obj_files_are_exact(spark, tmp_path):
    rows = [(i, [(i * 64 + c + 1) / 7 * 10.0 ** -(c % 12) for c in range(64)], 0) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    z = np.array([r[1] for r in rows], np.float32).astype(float)
    got = queries.QUERIES["obj_lines"](spark, str(tmp_path)).collect()
    assert {(r.p, -r.q): r.r for r in got if r.kind == "v"} == {(c, r): z[r, c] for r in range(6) for c in range(64)}
    assert sorted((r.p, r.q, r.r) for r in got if r.kind == "f") == sorted((a + 1, b + 1, c + 1) for _, a, b, c in listed(6))


def test_heads_of_off_files_count_the_faces_of_a_short_strip(spark, strips):
    got = {r.mesh_id: r.head for r in queries.QUERIES["off_heads"](spark, strips).collect()}
    edges = {n: len({tuple(sorted(e)) for _, a, b, c in listed(n) for e in ((a, b), (b, c), (c, a))}) for n in (50, 6)}
    assert got == {0: f"OFF\n3200 {len(listed(50))} {edges[50]}", 1: f"OFF\n384 {len(listed(6))} {edges[6]}"}
