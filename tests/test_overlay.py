"""Polygon overlay and predicates against the slab kernel, cell sums and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspark.functions import arrangement as A, kernels
from hotspark.operators import overlay as O, predicates as P

SHAPE = "id long, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"


def star(rng, cx, cy, r, n):
    t = (np.arange(n) + rng.uniform(0, 0.9, n)) * 2 * np.pi / n
    d = rng.uniform(0.4 * r, r, n)
    return np.column_stack([cx + d * np.cos(t), cy + d * np.sin(t)])


def corners(ring):
    return [(float(x), float(y)) for x, y in ring]


def shapes(rng, n, reach, holed=True):
    out = []
    for i in range(n):
        c, r = rng.uniform(0, reach, 2), rng.uniform(300, 2500)
        ring = star(rng, *c, r, int(rng.integers(5, 25)))
        if i % 2:
            ring = ring[::-1]
        hole = star(rng, *c, 0.3 * r, 5)
        out.append((i, corners(ring), [corners(hole)] if holed and i % 3 == 0 else None))
    return out


def area(rings):
    out = 0.0
    for ring in rings:
        p = np.array(ring)
        p = p - p[0]
        out += float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum() / 2)
    return out


def rings_of(shape):
    return [np.array(r) for r in [shape[1], *(shape[2] or [])]]


def edges(spark, rows, keys, layer, **extra):
    df = spark.createDataFrame(rows, SHAPE)
    for k, v in extra.items():
        df = df.withColumn(k, v)
    return O.polygon_edges(df, keys, layer, F.col("ring"), F.col("holes"))


def test_one_tile_agrees_with_the_slab_kernel():
    rng = np.random.default_rng(0)
    for _ in range(60):
        p, q = ((2 * np.rint((star(rng, *rng.uniform(6000, 14000, 2), 5000, int(rng.integers(4, 30))) - 1) / 2) + 1).astype(np.int64) for _ in range(2))
        a, b = np.vstack([p, q]), np.vstack([np.roll(p, -1, 0), np.roll(q, -1, 0)])
        w = np.zeros((len(a), 2), np.int64)
        w[:len(p), 0] = w[len(p):, 1] = 1
        a, b, w = A.split(a, b, w, 20_000)
        left, right = A.windings(a, b, w, np.zeros(2, np.int64))
        got = {}
        for op in A.OPERATIONS:
            found = A.chains(*A.outline(a, b, left, right, op), 20_000)
            assert all(closed for closed, _ in found)
            got[op] = area([r for _, r in found])
        slack = 2 * np.hypot(*(b - a).T).sum()
        both, pa, qa = kernels.overlap_area([p], [q]), kernels.ring_area(p.astype(float)), kernels.ring_area(q.astype(float))
        want = {"both": both, "only_a": pa - both, "only_b": qa - both, "any": pa + qa - both, "one": pa + qa - 2 * both}
        assert all(abs(got[op] - want[op]) <= slack for op in want)


def test_pairs_of_shapes_over_many_tiles(spark):
    rng = np.random.default_rng(4)
    a, b = shapes(rng, 25, 8000), shapes(rng, 25, 8000)
    both = edges(spark, a, ["pair"], 0, pair=F.col("id")).unionByName(edges(spark, b, ["pair"], 1, pair=F.col("id")))
    found = O.overlay(both, ["pair"], ["both", "only_a", "only_b", "any"], tile=700.0).collect()
    assert all(len(r["ring"]) >= 3 and abs(area([[(p["x"], p["y"]) for p in r["ring"]]]) - r["area"]) < 1e-3 for r in found)
    for i in range(25):
        got = {op: sum(r["area"] for r in found if r["pair"] == i and r["operation"] == op) for op in ("both", "only_a", "only_b", "any")}
        pa, pb = kernels.overlap_area(rings_of(a[i]), rings_of(a[i])), kernels.overlap_area(rings_of(b[i]), rings_of(b[i]))
        met = kernels.overlap_area(rings_of(a[i]), rings_of(b[i]))
        for op, want in (("both", met), ("only_a", pa - met), ("only_b", pb - met), ("any", pa + pb - met)):
            assert got[op] == pytest.approx(want, abs=60), (i, op)


def test_layers_do_not_depend_on_the_tiles(spark):
    rng = np.random.default_rng(9)
    a, b = shapes(rng, 60, 12000), shapes(rng, 60, 12000)
    a += [(100 + i, a[5][1], a[5][2]) for i in range(30)]  # copies
    both = edges(spark, a, [], 0).unionByName(edges(spark, b, [], 1)).repartition(3)
    sums = []
    for tile in (1_000_000.0, 900.0):
        rings = O.overlay(both, [], list(A.OPERATIONS), tile)
        whole = rings.groupBy("operation").agg(F.sum("area").alias("s"), F.count("*").alias("n"), F.sum(F.size("ring")).alias("c")).collect()
        sums.append({r["operation"]: r for r in whole})
    for op in A.OPERATIONS:
        assert sums[0][op]["s"] == pytest.approx(sums[1][op]["s"], abs=400)
        assert abs(sums[0][op]["n"] - sums[1][op]["n"]) <= 2 and abs(sums[0][op]["c"] - sums[1][op]["c"]) <= 40
    s = {op: sums[1][op]["s"] for op in sums[1]}
    assert s["any"] == pytest.approx(s["both"] + s["only_a"] + s["only_b"], abs=200) and s["one"] == pytest.approx(s["only_a"] + s["only_b"], abs=200)


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_squares_with_shared_borders_and_holes(spark):
    a = [(1, square(0.0, 0.0, 1000.0, 1000.0), None), (2, square(1000.0, 0.0, 2000.0, 1000.0), [square(1200.0, 200.0, 1800.0, 800.0)]), (3, square(5000.0, 0.0, 6000.0, 1000.0)[::-1], None),
         (4, [(0.0, 0.0), (1.0, 1.0)], None), (5, None, None)]
    rows = spark.createDataFrame(a, SHAPE)
    e = O.polygon_edges(rows, [], 0, F.col("ring"), F.col("holes"))
    for tile in (300.0, 500.0, 1000.0, 100_000.0):
        got = O.with_holes(O.overlay(e, [], ["any"], tile), [], 2000.0).collect()
        assert sorted((r["area"], len(r["ring"]), [len(h) for h in r["holes"]]) for r in got) == [(1e6, 4, []), (2e6 - 360_000.0, 4, [4])]
    assert O.overlay(e.limit(0), [], ["any"], 500.0).collect() == []
    keyed = O.polygon_edges(rows.withColumn("k", F.when(F.col("id") > 2, F.lit("x"))), ["k"], 0, F.col("ring"), F.col("holes"))
    assert sorted((r["k"] or "", r["area"]) for r in O.overlay(keyed, ["k"], ["any"], 500.0).collect()) == [("x", 1e6)]


def test_shapes_that_touch_in_a_corner_stay_apart(spark):
    e = edges(spark, [(1, square(0.0, 0.0, 10.0, 10.0), None), (2, square(10.0, 10.0, 20.0, 20.0), None)], [], 0)
    assert sorted(r["area"] for r in O.overlay(e, [], ["any"], 1000.0).collect()) == [100.0, 100.0]


def test_relations_of_polygons(spark):
    rng = np.random.default_rng(12)
    a, b = shapes(rng, 30, 9000), shapes(rng, 12, 9000)
    b += [(50, square(-4000.0, -4000.0, 14000.0, 14000.0), [square(3000.0, 3000.0, 6500.0, 6500.0)])]
    ia = P.edge_index(edges(spark, a, ["a"], 0, a=F.col("id")), "a", 500.0)
    ib = P.edge_index(edges(spark, b, ["b"], 0, b=F.col("id")), "b", 500.0)
    assert ib.where("b = 50 and size(pieces) = 0").count() > 500
    got = {(r["a"], r["b"]): r for r in P.relations(ia, "a", ib, "b", 500.0).collect()}
    for i, j in ((x, y) for x in a for y in b):
        met, own = kernels.overlap_area(rings_of(i), rings_of(j)), kernels.overlap_area(rings_of(i), rings_of(i))
        r = got.get((i[0], j[0]))
        assert (r["area"] if r else 0.0) == pytest.approx(met, abs=40)
        if r:
            assert r["share_a"] == pytest.approx(met / own, abs=1e-3)
            assert r["a_within_b"] == (abs(met - own) < 1e-6 * own)
    assert any(r["a_within_b"] for r in got.values()) and not all(r["a_within_b"] for (_, j), r in got.items() if j == 50)


def test_a_ring_of_many_corners_is_spread_over_tiles(spark):
    n = 200_000
    t, u = (F.col("id") * (2 * np.pi / n), ((F.col("id") + 1) % n) * (2 * np.pi / n))
    r = 100_000.0
    ring = spark.range(n).select(F.lit(1).alias("k"), F.lit(0).alias("layer"), (F.cos(t) * r).alias("x0"), (F.sin(t) * r).alias("y0"), (F.cos(u) * r).alias("x1"), (F.sin(u) * r).alias("y1"))
    index = P.edge_index(ring, "k", 5000.0)
    assert index.agg(F.max(F.size("pieces"))).collect()[0][0] < 5000
    assert P.areas(index, "k", 5000.0).collect()[0]["area"] == pytest.approx(np.pi * r * r, rel=1e-6)
    points = spark.range(20_000).select("id", (F.rand(3) * 240_000 - 120_000).alias("x"), (F.rand(4) * 240_000 - 120_000).alias("y"))
    rows = spark.createDataFrame(points.toPandas())
    inside = {x["id"] for x in P.points_in_polygons(rows, index, 5000.0).collect()}
    for x in rows.collect():
        d = np.hypot(x["x"], x["y"])
        if abs(d - r) > 1:
            assert (x["id"] in inside) == (d < r)


def test_points_in_random_polygons(spark):
    rng = np.random.default_rng(21)
    rows = shapes(rng, 20, 6000)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2000, 8000, (500, 2)))] + [(900, None, 1.0)]
    index = P.edge_index(edges(spark, rows, ["k"], 0, k=F.col("id")), "k", 800.0)
    got = {(r["p"], r["k"]) for r in P.points_in_polygons(spark.createDataFrame(points, "p long, x double, y double"), index, 800.0).collect()}
    want = set()
    for s in rows:
        rings = [kernels.inside(np.array([p[1:] for p in points[:-1]]), kernels._segments([r])) for r in rings_of(s)]
        for k in np.flatnonzero(rings[0] & ~(rings[1] if len(rings) > 1 else False)):
            want.add((int(k), s[0]))
    assert got == want


def test_many_tiles_in_one_call():
    """Tiles set side by side give what each gives alone: crossings, windings, areas and paths."""
    rng, size, tiles = np.random.default_rng(8), 20_000, 40
    parts, corner = [], rng.integers(0, 2, (tiles, 2))
    for k in range(tiles):
        p, q = ((2 * np.rint((star(rng, *rng.uniform(6000, 14000, 2), 5000, int(rng.integers(4, 20))) - 1) / 2) + 1).astype(np.int64) for _ in range(2))
        w = np.zeros((len(p) + len(q), 2), np.int64)
        w[:len(p), 0], w[len(p):, 1] = 1, 1
        # an edge through the tile from its left border to its right one
        line = np.array([[[0, 2 * k + 1], [size, 4001 + 2 * k]]])
        parts.append((np.vstack([p, q, line[:, 0]]), np.vstack([np.roll(p, -1, 0), np.roll(q, -1, 0), line[:, 1]]), np.vstack([w, [[1, 0]]])))
    shift = [k * A.stride(size) for k in range(tiles)]
    every = [np.vstack(x) for x in zip(*((a + s, b + s, w) for s, (a, b, w) in zip(shift, parts)))]
    a, b, w = A.split(*every, size)
    left, right = A.windings(a, b, w, corner, size)
    alone = [A.split(*part, size) for part in parts]
    sides = [A.windings(*part, corner[k]) for k, part in enumerate(alone)]
    assert np.array_equal(a, np.vstack([part[0] + s for part, s in zip(alone, shift)]))
    assert np.array_equal(left, np.vstack([s[0] for s in sides])) and np.array_equal(right, np.vstack([s[1] for s in sides]))
    for op in A.OPERATIONS:
        one = [A.region_areas(*part, corner[k:k + 1], size, op)[0] for k, part in enumerate(parts)]
        assert A.region_areas(*every, corner, size, op).tolist() == one
        found = {(c, tuple(map(tuple, p.tolist()))) for c, p in A.chains(*A.outline(a, b, left, right, op), size)}
        expected = {(c, tuple(map(tuple, (p + s).tolist()))) for s, part, lr in zip(shift, alone, sides) for c, p in A.chains(*A.outline(part[0], part[1], *lr, op), size)}
        assert found == expected


def test_paths_join_within_their_group_only():
    group, ids = np.array([0, 0, 0, 1, 1]), np.array([10, 11, 12, 13, 14])
    start = np.array([[0, 0], [1, 0], [2, 0], [0, 0], [1, 0]])
    end = np.array([[1, 0], [2, 0], [0, 0], [1, 0], [5, 5]])
    walk, parent, pos, closed, first, last = O._joined(group, ids, start, end)
    by = {int(ids[w]): (int(p), int(n), bool(c), int(ids[f]), int(ids[g])) for w, p, n, c, f, g in zip(walk, parent, pos, closed, first, last)}
    assert by == {10: (10, 0, True, 10, 12), 11: (10, 1, True, 10, 12), 12: (10, 2, True, 10, 12), 13: (13, 0, False, 13, 14), 14: (13, 1, False, 13, 14)}


def test_straight_corners_go_from_many_rings_at_once():
    square = [(0, 0), (2, 0), (4, 0), (4, 2), (4, 4), (0, 4)]
    line = [(0, 0), (2, 0), (4, 0)]
    far = [(x << 33, y << 33) for x, y in square]
    points, count = A.straightened(np.array([*square, *line, *far]), np.array([6, 3, 6]))
    assert count.tolist() == [4, 0, 4]
    assert points.tolist() == [[0, 0], [4, 0], [4, 4], [0, 4], *([x << 33, y << 33] for x, y in [(0, 0), (4, 0), (4, 4), (0, 4)])]


def test_ends_of_a_full_batch_are_joined_a_few_rows_at_a_time(monkeypatch):
    """Memory follows the call, not the batch; the joined paths are those of one call over all rows."""
    monkeypatch.setattr(O, "CALL_EDGES", 100)
    count = np.array([40, 0, 60, 250, 4, 16, 30])
    k = np.arange(count.sum())
    ring, place = k // 2, k % 2
    v = {"id": k + 7, "sx": 10 * ring + place, "sy": ring, "ex": 10 * ring + 1 - place, "ey": ring}
    group = np.repeat(np.arange(len(count)), count)
    walk, parent, pos, closed, first, last = O._joined(group, v["id"], np.column_stack([v["sx"], v["sy"]]), np.column_stack([v["ex"], v["ey"]]))
    whole = sorted(zip(group[walk].tolist(), v["id"][walk].tolist(), parent.tolist(), pos.tolist(), closed.tolist(), v["sx"][first].tolist(), v["ex"][last].tolist()))
    sizes, one = [], O._joined
    monkeypatch.setattr(O, "_joined", lambda g, *rest: (sizes.append(len(g)), one(g, *rest))[1])
    parts = list(O._joined_calls(count, v))
    assert sizes == [100, 300]
    found = [r for row, c in parts for r in zip(row.tolist(), *(c[n].tolist() for n in ("id", "parent", "pos", "closed", "sx", "ex")))]
    assert sorted(found) == whole
