"""Vector near-dedup against all pairs."""

import numpy as np

from quadspark.llm.embeddings import Tables, near_duplicate_vectors


def brute(rows, cosine):
    n, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    ok = [(i, np.array(v, dtype=np.float64), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, u, k) in enumerate(ok):
        for j, v, m in ok[x + 1 :]:
            if k == m and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (n[i], find(i), find(i) == i) for i in n}


def cloud(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, dim))
    out = [base[rng.integers(len(base))] * rng.uniform(0.5, 2) + rng.standard_normal(dim) * rng.uniform(0, 0.25) for _ in range(n)]
    return np.array(out + out[:5], dtype=np.float32)


def check(spark, rows, cosine=0.98):
    want = brute(rows, cosine)
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), cosine).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want and len(got) == len(rows)


def test_all_links_are_found(spark):
    rows = [(1000 - i, v.tolist(), i % 2) for i, v in enumerate(cloud(3, 500))]
    check(spark, rows)


def test_one_tight_cluster(spark):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal(64) + rng.standard_normal((2500, 64)) * 0.02).astype(np.float32)
    rows = [(i, x.tolist(), 7) for i, x in enumerate(v)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(n.tolist())) and {r.component_id for r in got} == {0}


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [float("nan"), 2.0, 3.0], 1), (9, [1.0, 2.0, 3.0, 0.0], 1), (10, [], 1), (11, [-1.0, -2.0, -3.0], 1), (12, [1e30, 2e30, 3e30], 1)]
    check(spark, rows)
    again = near_duplicate_vectors(spark.createDataFrame([(1, v, 1), (1, v, 1), (None, v, 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in again) == [("1", 1, 1, True), ("1", 1, 1, True), ("None", 0, None, True)]
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_parameters():
    t = Tables.for_rows(10**9, 0.98)
    assert t.k > Tables.for_rows(1000, 0.98).k == 2
    assert (1 - t.same_cell(t.radius) ** t.k) ** t.tables <= t.miss and t.count < t.lines


def test_repeated_ids_and_clashing_columns(spark):
    v, far = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [(1, v, 1), (1, far, 1), (2, [1.0, 2.0, 3.01], 1), (3, [3.0, -1.0, 0.01], 1), (1, v, 2), (9, v, 3)]
    df = spark.createDataFrame([(*r, "x", 4, 5, [6]) for r in rows], "vec_id long, embedding array<double>, label int, key string, cid long, kept int, vec array<int>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (9, 0, 9, True)]
    text = spark.createDataFrame([("5", v, "a"), ("07", v, "a"), ("x", v, "a")], "vec_id string, embedding array<double>, label string")
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in near_duplicate_vectors(text).collect()) == [("5", 1, 5), ("7", 1, 5), ("None", 0, None)]


def test_windows_hold_every_pair():
    """Pairs of a block are those of the table's window with enough collisions, each once."""
    t = Tables.for_rows(1000, 0.98)
    rng = np.random.default_rng(2)
    q = rng.integers(-20, 20, (300, t.lines)).astype(np.int16)
    q[200:] = q[:100] + rng.integers(-3, 4, (100, t.lines)).astype(np.int16)
    near = np.abs(q[:, None] - q[None]) <= t.window
    want = near[:, :, 5] & (near.sum(axis=2) >= t.count)
    every = np.arange(300)
    i, j = t.met(5, q, every, every)
    assert len(i) and sorted(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True)) == [(a, b) for a in range(300) for b in range(a + 1, 300) if want[a, b]]
    a, b = every[:150], every[150:]
    i, j = t.met(5, q, a, b)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in a for y in b if want[x, y]]
