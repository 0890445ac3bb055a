"""Delaunay, greedy meshes, simplification and parameterisation by their invariants."""

import numpy as np
import pytest

from quadspark.operators import local, mesh


def areas2(p, f):
    a, b, c = p[f[:, 0]], p[f[:, 1]], p[f[:, 2]]
    return (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])


def test_delaunay_small():
    assert len(local.delaunay(np.array([(0, 0), (1, 1), (1, 0)], float))) == 1
    assert len(local.delaunay(np.array([(0, 0), (100, 0), (100, 100), (0, 100)], float))) == 2
    grid = np.array([(x, y) for y in range(10) for x in range(20)], float)
    f = local.delaunay(grid * 1.5 + 42)
    assert len(f) == 342 and (areas2(grid, f) > 0).all()
    assert len(local.delaunay(np.zeros((0, 2)))) == 0 and len(local.delaunay(np.array([(0, 0), (1, 0), (2, 0)], float))) == 0


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(42).uniform(0, 100, (120, 2))
    f = local.delaunay(np.concatenate((p, p[:5])))
    assert (areas2(p, f) > 0).all() and f.max() < 120 and set(f.ravel()) == set(range(120))
    for a, b, c in p[f]:
        d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        bl, cl = ((b - a) ** 2).sum(), ((c - a) ** 2).sum()
        m = a + np.array([(c[1] - a[1]) * bl - (b[1] - a[1]) * cl, (b[0] - a[0]) * cl - (c[0] - a[0]) * bl]) / d
        assert ((p - m) ** 2).sum(axis=1).min() >= ((a - m) ** 2).sum() * (1 - 1e-9)


@pytest.mark.parametrize("holes", [False, True])
def test_terra_error(spark, holes):
    r, c = np.mgrid[0:40, 0:60]
    z = 10 * np.sin(0.1 * c) * np.sin(0.1 * r)
    if holes:
        z[np.random.default_rng(42).uniform(size=z.shape) < 0.4] = np.nan
        z[0, 0] = np.nan
    rows = [(1, int(i), int(j), None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(40) for j in range(60)]
    out = local.terra_meshes(spark.createDataFrame(rows, "mesh_id int, row int, col int, z double"), 0.1)
    v, f = local.split(out)
    v, f = mesh.written(v, "v"), mesh.written(f, "f")
    assert mesh.tin_report(v.drop("u", "v"), f).collect() == []
    assert v.count() < 1200
    t = mesh.triangles(v, f)
    got = {(r.px, r.py): r.z for r in mesh.rasterize(t).collect()}
    assert all(abs(got[j, 39 - i] - z[i, j]) <= 0.1 + 1e-9 for i in range(40) for j in range(60) if not np.isnan(z[i, j]))


def test_simplify_keeps_the_border(spark):
    r, c = np.mgrid[0:20, 0:20]
    p = np.stack((c.ravel(), r.ravel(), np.sin(c.ravel() * 0.3)), axis=1).astype(float)
    f = np.array([t for i in range(19) for j in range(19) for t in ((i * 20 + j, i * 20 + j + 1, i * 20 + j + 20), (i * 20 + j + 1, i * 20 + j + 21, i * 20 + j + 20))])
    vertices = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], "mesh_id int, vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, i, *map(int, x)) for i, x in enumerate(f)], "mesh_id int, fid long, a long, b long, c long")
    v, g = local.split(local.simplify_meshes(vertices, faces, 0.5))
    v, g = mesh.written(v, "v"), mesh.written(g, "g")
    assert g.count() <= 0.55 * len(f)
    assert {(q.x, q.y) for q in v.collect() if q.x in (0, 19) or q.y in (0, 19)} == {(x, y) for x, y, _ in p if x in (0, 19) or y in (0, 19)}
    assert {r.kind for r in mesh.tin_report(v.drop("u", "v"), g).collect()} <= set()
    new = np.array([(q.x, q.y, q.z) for q in v.collect()])
    assert local.hausdorff(new, p, f) < 0.2
    # an error bound of nothing takes away only what lies on the surface
    q, g, _ = local.simplify(p, f, 0.1, 1e-6)
    assert len(g) < len(f) and local.hausdorff(q, p, f) < 1e-4


@pytest.mark.parametrize("weights", ["tutte", "mean_value", "conformal", "authalic"])
@pytest.mark.parametrize("border", ["circle", "square"])
def test_uv(weights, border):
    p = np.array([(x, y, 0.1 * x * y) for y in range(6) for x in range(6)], float)
    f = np.array([t for i in range(5) for j in range(5) for t in ((i * 6 + j, i * 6 + j + 1, i * 6 + j + 6), (i * 6 + j + 1, i * 6 + j + 7, i * 6 + j + 6))])
    uv = local.uv_map(p, f, weights, border)
    assert uv.min() >= 0 and uv.max() <= 1
    a = areas2(uv, f)
    assert (a > -1e-9).all() and (a > 1e-6).sum() >= len(f) - 4


def bumps(n, seed):
    r, c = np.mgrid[0:n, 0:n]
    z = np.random.default_rng(seed).normal(0, 0.4, (n, n)) + np.sin(c * 0.5) * 2
    f = np.array([t for i in range(n - 1) for j in range(n - 1) for t in ((i * n + j, i * n + j + 1, i * n + j + n), (i * n + j + 1, i * n + j + n + 1, i * n + j + n))])
    return np.stack((c.ravel(), r.ravel(), z.ravel()), axis=1).astype(float), f


def sampled(p, f, q, g, n=12):
    """Distance of many points of each triangle of one mesh to the other, by all triangles."""
    w = np.array([(i, j, n - i - j) for i in range(n + 1) for j in range(n + 1 - i)]) / n
    x = np.einsum("wk,fkd->fwd", w, p[f]).reshape(-1, 3)
    return max(np.sqrt(local._to_triangles(y[:, None], *(q[g][None, :, k] for k in range(3))).min(axis=1).max()) for y in np.array_split(x, 50))


def test_distance_to_a_triangle():
    t = [np.array([[0.0, 0, 0]]), np.array([[2.0, 0, 0]]), np.array([[0.0, 2, 0]])]
    x = np.array([(0.5, 0.5, 3), (-1, 1, 0), (2, 2, 0), (3, 0, 0), (-3, -4, 0), (1, 1, 0)], float)
    assert np.allclose(np.sqrt(local._to_triangles(x[:, None], *t)[:, 0]), [3, 1, np.sqrt(2), 1, 5, 0])
    flat = [np.array([[0.0, 0, 0]]), np.array([[2.0, 0, 0]]), np.array([[4.0, 0, 0]])]  # no area
    assert np.allclose(np.sqrt(local._to_triangles(np.array([[[3.0, 1, 0]]]), *flat)), 1)


def test_surface_distance_is_that_of_dense_samples():
    p, f = bumps(9, 1)
    q, g = bumps(9, 2)
    for a, b in (((p, f), (q, g)), ((q, g), (p, f)), ((p, f), (q, g[:40]))):
        want, got = sampled(*a, *b), local.surface_distance(*a, *b, 1e-4)
        assert want - 1e-4 <= got <= want + 0.05
        assert local.hausdorff(a[0], *b) <= got + 1e-4
    assert local.surface_distance(p, f, p, f, 1e-6) < 1e-9
    # a ridge between vertices: every vertex of the first lies on the second
    ridge = (np.array([(0, 0, 0), (2, 0, 0), (0, 2, 0)], float), np.array([(0, 1, 2)]))
    bent = (np.array([(0, 0, 0), (2, 0, 0), (0, 2, 0), (1, 1, 1)], float), np.array([(0, 1, 3), (0, 3, 2)]))
    assert local.hausdorff(ridge[0], *bent) == 0 and local.surface_distance(*ridge, *bent, 1e-4) > 0.5
    assert local.surface_distance(p, f, q, g[:0], 1) == float("inf") and local.surface_distance(p, f[:0], q, g, 1) == 0


@pytest.mark.parametrize("bound", [0.3, 1.0])
def test_simplify_keeps_a_distance(bound):
    p, f = bumps(14, 3)
    q, g, _ = local.simplify(p, f, None, distance=bound)
    assert len(g) < len(f) and sampled(p, f, q, g) <= bound
    edge = lambda x: {tuple(v) for v in x[(x[:, :2].min(axis=1) == 0) | (x[:, :2].max(axis=1) == 13)]}
    assert edge(q) == edge(p)
    r, h, _ = local.simplify(p, f, None, relative_distance=bound / np.ptp(p, axis=0).max())
    assert np.allclose(q, r) and (g == h).all()
    # nothing to spare: the mesh as it was
    q, g, _ = local.simplify(p, f, None, distance=1e-9)
    assert len(g) == len(f) and np.allclose(q, p)


def test_simplify_ratios():
    p, f = bumps(14, 4)
    faces, vertices = len(f), len(p)
    assert 0.6 * faces - 2 <= len(local.simplify(p, f, None, face_ratio=0.6)[1]) <= 0.6 * faces
    assert len(local.simplify(p, f, None, vertex_ratio=0.7)[0]) == int(0.7 * vertices)
    assert len(local.simplify(p, f, 0.9, vertex_ratio=0.1, face_ratio=0.2)[0]) > 0.85 * vertices  # the first that holds
    assert all(len(x) == 0 for x in local.simplify(np.zeros((0, 3)), np.zeros((0, 3), dtype=int), None, distance=1, relative_distance=1)[:2])
