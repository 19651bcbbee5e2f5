"""Nearest shapes by widening search, against distances of all pairs of sides."""

import numpy as np
import pytest

from hotspark.operators.nearest import nearest_shapes

EDGES = "x0 double, y0 double, x1 double, y1 double"


def polygons(rng, n, spread, sizes):
    """Rotated regular polygons as lists of corners."""
    out = []
    for _ in range(n):
        c, r, k = rng.uniform(-spread, spread, 2), rng.choice(sizes), rng.integers(3, 8)
        at = rng.uniform(0, 7) + np.arange(k) * 2 * np.pi / k
        out.append(c + r * np.stack([np.cos(at), np.sin(at)], 1))
    return out


def edges(spark, shapes, key):
    rows = [(i, *map(float, p), *map(float, q)) for i, s in enumerate(shapes) for p, q in zip(s, np.roll(s, -1, axis=0))]
    return spark.createDataFrame(rows, f"{key} long, {EDGES}")


def to_segment(p, a, b):
    t = np.clip(np.dot(p - a, b - a) / np.dot(b - a, b - a), 0, 1)
    return np.hypot(*(p - a - t * (b - a)))


def within(p, s):
    """Convex shapes, counter-clockwise."""
    d, o = np.roll(s, -1, axis=0) - s, p - s
    return (d[:, 0] * o[:, 1] - d[:, 1] * o[:, 0] > 0).all()


def crosses(a, b, c, d):
    def cr(u, v, w):
        return (v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0])

    return cr(a, b, c) * cr(a, b, d) < 0 and cr(c, d, a) * cr(c, d, b) < 0


def distance(s, t, solid):
    if solid and (within(s[0], t) or within(t[0], s)):
        return 0.0
    best = np.inf
    for a, b in zip(s, np.roll(s, -1, axis=0)):
        for c, d in zip(t, np.roll(t, -1, axis=0)):
            if crosses(a, b, c, d):
                return 0.0
            best = min(best, to_segment(a, c, d), to_segment(b, c, d), to_segment(c, a, b), to_segment(d, a, b))
    return best


@pytest.mark.parametrize("tile,start", [(100.0, 20.0), (None, 500.0)])
def test_nearest_shapes(spark, tile, start):
    rng = np.random.default_rng(8)
    a, b = polygons(rng, 25, 400, [1, 10, 90]), polygons(rng, 30, 500, [2, 15, 120])
    got = {r["ia"]: (r["ib"], r["dist"]) for r in nearest_shapes(edges(spark, a, "ia"), "ia", edges(spark, b, "ib"), "ib", start, 150.0, tile).collect()}
    want = {}
    for i, s in enumerate(a):
        d = [round(distance(s, t, tile is not None), 3) for t in b]
        if min(d) <= 150:
            want[i] = (int(np.argmin(d)), min(d))
    assert set(got) == set(want) and any(d == 0 for _, d in want.values()) and len(want) < 25
    for i, (k, d) in want.items():
        assert got[i][1] == pytest.approx(d, abs=2e-3) and (got[i][0] == k or d > 0)


def test_dense_layers_meet_few_pieces_and_copies_stand_for_one(spark):
    from pyspark.sql import functions as F

    # a lattice of 40,000 points, and 20,000 copies of one point: degenerate edges
    grid = spark.range(40_000).select((F.col("id") + 1).alias("ib"), ((F.col("id") % 200) * 10.0).alias("x0"), (F.floor(F.col("id") / 200) * 10.0).alias("y0"))
    copies = spark.range(20_000).select((F.col("id") + 50_000).alias("ib"), F.lit(1003.0).alias("x0"), F.lit(1003.0).alias("y0"))
    b = grid.unionByName(copies).withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    a = spark.createDataFrame([(1, 1003.0, 1004.0, 1003.0, 1004.0), (2, 2100.0, 0.0, 2100.0, 0.0), (3, 5000.0, 0.0, 5000.0, 0.0), (None, 0.0, 0.0, 0.0, 0.0), (4, None, 0.0, 0.0, 0.0)], f"ia long, {EDGES}")
    got = {r["ia"]: tuple(r)[1:] for r in nearest_shapes(a, "ia", b, "ib", 10.0, 1000.0).collect()}
    assert got[1][:2] == (50_000, 1.0) and got[2][:2] == (200, 110.0) and set(got) == {1, 2}
    assert got[1][2] <= 30 and got[2][2] <= 2_000
    assert nearest_shapes(a.limit(0), "ia", b, "ib", 10.0, 1000.0).count() == 0
    assert nearest_shapes(a, "ia", b.limit(0), "ib", 10.0, 20.0).count() == 0
