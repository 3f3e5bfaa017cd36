"""Connected components: shapes that need many steps, against plain Python."""

import random

import brute
import pytest

from harrow.llm import common


def path(n):
    order = [0, *range(n, 0, -1)]
    return list(zip(order, order[1:], strict=False))


def zigzag(n):
    order = [x for k in range(n) for x in (k, 10_000 - k)]
    return list(zip(order, order[1:], strict=False))


r = random.Random(11)
SHAPES = {
    "path": path(200), "upward": [(k, k + 1) for k in range(300)], "zigzag": zigzag(150), "star": [(5_000, k) for k in range(400)],
    "random": [(r.randrange(3000), r.randrange(3000)) for _ in range(1800)], "self": [(7, 7), (8, 9), (9, 8)],
    "trees": [(k, r.randrange(k)) for k in range(1, 500)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, monkeypatch, shape):
    written = []
    materialize = common.materialize
    monkeypatch.setattr(common, "materialize", lambda spark, df, name: written.append(name) or materialize(spark, df, name))
    edges = SHAPES[shape]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(spark, df).collect()}
    assert got == brute.smallest_reachable({x for e in edges for x in e}, edges)
    assert len(written) < (20 if shape == "path" else 40)


def test_no_edges(spark):
    assert common.connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
