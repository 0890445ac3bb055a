"""Connected components against union-find."""

import random

import pytest

from quadspark.llm.common import Workspace, components


def graphs():
    rng = random.Random(9)
    yield []
    yield [(5, 5)]
    yield [(i, i + 1) for i in range(300)]
    yield [(1000 - i, 0) for i in range(400)] + [(0, 0)]
    yield [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    yield [(i, i + 1) for i in range(0, 100, 2)] * 2 + [(500, 3), (500, 501), (501, 499)]


@pytest.mark.parametrize("edges", list(graphs()))
def test_components(spark, edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = [(r.id, r.component_id) for r in components(Workspace(spark, "test"), df).collect()]
    assert len(got) == len(set(got))
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b) if find(x) != x}
    assert set(got) == want
