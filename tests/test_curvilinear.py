"""Curvilinear grids: places, power and values against plain versions and the grid before the turn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspark.functions import kernels as K
from hotspark.operators import curvilinear as C, raster as R
from hotspark.plans import curved, grids

NODE = "i long, j long, x double, y double, value double"
RING = "array<struct<x:double,y:double>>"


def warped(rng, n, m, flip=False, wobble=0.25):
    """Nodes of convex cells about 10 wide."""
    out = []
    for i in range(n):
        for j in range(m):
            x, y = 10 * i + rng.uniform(-wobble, wobble) * 10, 10 * j + rng.uniform(-wobble, wobble) * 10
            out.append((i, j, -x if flip else x, y, float(rng.uniform(0, 9))))
    return out


@pytest.mark.parametrize("flip", [False, True])
def test_points_are_found_in_their_cell(spark, flip):
    rng = np.random.default_rng(5)
    rows = warped(rng, 7, 6, flip, 0.2)
    at = {(r[0], r[1]): np.array(r[2:5]) for r in rows}
    points = []
    for k in range(400):
        i, j, u, v = int(rng.integers(6)), int(rng.integers(5)), rng.uniform(0.001, 0.999), rng.uniform(0.001, 0.999)
        p = at[i, j] * (1 - u) * (1 - v) + at[i + 1, j] * u * (1 - v) + at[i + 1, j + 1] * u * v + at[i, j + 1] * (1 - u) * v
        points.append((k, float(p[0]), float(p[1]), i, j, u, v, float(p[2])))
    df = spark.createDataFrame(points, "id long, x double, y double, wi long, wj long, wu double, wv double, want double")
    nodes = spark.createDataFrame(rows, NODE)
    got = C.locate(df, C.cells(nodes), 20.0).toPandas()
    assert sorted(got["id"]) == list(range(400)) and (got.i == got.wi).all() and (got.j == got.wj).all()
    assert np.allclose(got.u, got.wu, atol=1e-9) and np.allclose(got.v, got.wv, atol=1e-9)
    read = C.interpolate(df, nodes, "value", 20.0).toPandas()
    assert np.allclose(read.value, read.want, atol=1e-9)


def test_each_place_lies_in_one_cell(spark):
    """Corners and rims: inner ones belong to one cell, far ones to none."""
    nodes = spark.createDataFrame([(i, j, 10.0 * i, 10.0 * j, 0.0) for i in range(4) for j in range(4)], NODE)
    df = spark.createDataFrame([(x * 5.0, y * 5.0) for x in range(8) for y in range(8)], "x double, y double")
    got = {(r.x, r.y): (r.i, r.j) for r in C.locate(df, C.cells(nodes), 20.0).collect()}
    assert got == {(x * 5.0, y * 5.0): (x // 2, y // 2) for x in range(6) for y in range(6)}


def test_area_in_a_box(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        t = np.sort(rng.uniform(0, 2 * np.pi, 9))
        r = rng.uniform(2, 9, 9)
        ring = np.column_stack([r * np.cos(t), r * np.sin(t)]) + rng.uniform(-5, 5, 2)
        if k % 3 == 0:
            ring = np.rint(ring)  # upright and level sides
        if k % 2:
            ring = ring[::-1]
        box = [(0.0, 0.0, 4.0, 3.0), (-20.0, -20.0, 20.0, 20.0), (50.0, 50.0, 51.0, 51.0)][k % 3]
        square = np.array([(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])])
        rows.append((ring.tolist(), *box, float(K.overlap_area([ring], [square]))))
    df = spark.createDataFrame([([{"x": a, "y": b} for a, b in r[0]], *r[1:]) for r in rows], f"ring {RING}, x0 double, y0 double, x1 double, y1 double, want double")
    got = df.select("want", C.area_in_box(*(F.col(c) for c in ("ring", "x0", "y0", "x1", "y1"))).alias("got")).toPandas()
    assert np.allclose(got.got, got.want, atol=1e-6)


def test_resampling_keeps_the_sum(spark):
    rng = np.random.default_rng(2)
    rows = warped(rng, 8, 8)
    nodes = spark.createDataFrame(rows, NODE)
    field = nodes.where("i < 7 and j < 7").select("i", "j", F.when((F.col("i") == 3) & (F.col("j") == 3), None).otherwise(F.col("value")).alias("value"))
    got = C.resample_area(nodes, field, "value", 7.0).toPandas()
    at = {(r[0], r[1]): r for r in rows}
    quads = {(i, j): np.array([at[i + a, j + b][2:4] for a, b in C.AROUND]) for i in range(7) for j in range(7) if (i, j) != (3, 3)}
    area = {k: K.ring_area(q) for k, q in quads.items()}
    assert got.coverage.sum() * 49 == pytest.approx(sum(area.values()), rel=1e-9) and got.coverage.max() <= 1 + 1e-9
    assert got.value.sum() * 49 == pytest.approx(sum(a * at[k][4] for k, a in area.items()), rel=1e-9)


def test_the_turned_grid_holds_what_the_plain_one_holds(spark, sf):
    """Polygons, lines and points of the registered query, cell by cell, to the exactness of the lattice.

    Parts are at least 100 m wide, and each of two cuts moves by half a millimetre at most: 1e-5.
    """
    shapes = grids.shapes_of_days(spark, sf)
    want = R.share_power_polygons(shapes, grids.CELL, grids.DOMAIN, ["day"], "shape").withColumnRenamed("frp", "want")
    both = curved.turned_power(spark, shapes).join(want, ["day", "i", "j"], "full").toPandas()
    assert len(both) and not both.isna().any().any() and np.allclose(both.frp, both.want, rtol=1e-5, atol=0)


def test_odd_input(spark):
    nodes = [(i, j, 10.0 * i, 10.0 * j, 1.0) for i in range(4) for j in range(4)]
    grid = spark.createDataFrame([*nodes[:-1], nodes[0], (None, 1, 0.0, 0.0, 1.0), (3, 3, None, 0.0, 1.0)], NODE)
    assert C.cells(grid).count() == 8  # the cell (2, 2) lacks a node
    def ring(*p):
        return [{"x": float(x), "y": float(y)} for x, y in p]
    events = [
        ("a", "line", 8.0, ring((5, 10), (15, 10))), ("a", "out", 5.0, ring((-10, 3), (-5, 3))), ("a", "half", 6.0, ring((-10, 5), (10, 5))),
        ("b", "dot", 2.0, ring((10, 10))), ("b", "dot", 3.0, ring((10, 10))), ("c", "box", 4.0, ring((5, 5), (15, 5), (15, 15), (5, 15))),
        ("d", "none", 4.0, None), ("d", "empty", 4.0, []), ("d", "weak", None, ring((5, 5))), ("e", "hole", 7.0, ring((25, 25))), (None, "dot", 1.0, ring((1, 1)))]
    ev = spark.createDataFrame(events, f"day string, shape string, frp double, ring {RING}")
    got = {(r.day, r.i, r.j): r.frp for r in C.share_power(ev, grid, ["day"], "shape", 100.0, 20.0).collect()}
    want = {("a", 0, 1): 4.0, ("a", 1, 1): 4.0, ("a", 0, 0): 6.0, ("b", 1, 1): 5.0, (None, 0, 0): 1.0} | {("c", i, j): 1.0 for i in (0, 1) for j in (0, 1)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    assert C.share_power(ev.limit(0), grid, ["day"], "shape", 100.0, 20.0).count() == 0
    assert C.share_power(ev, grid.limit(0), ["day"], "shape", 100.0, 20.0).count() == 0
    assert C.resample_area(grid, grid.limit(0), "value", 7.0).count() == 0
    assert C.interpolate(spark.createDataFrame([(None, 1.0)], "x double, y double"), grid, "value", 20.0).count() == 0


def slanting(n, m, run=3_000.0):
    """Nodes of cells 10 wide and high whose sides lean over by `run` a row, as those far east in a widening grid do."""
    return [(i, j, 10.0 * i + run * j, 10.0 * j, float((7 * i + 3 * j) % 11)) for i in range(n) for j in range(m)]


def test_slanting_cells_share_squares_as_their_boxes_would(spark):
    rows = slanting(60, 4, 400.0)
    nodes = spark.createDataFrame(rows, NODE)
    field = nodes.where("i < 59 and j < 3").select("i", "j", "value")
    quads = C.cells(nodes).join(field, ["i", "j"])
    met = R.covered_cells(quads.drop("i", "j"), 7.0)
    part = C.area_in_box(F.col("ring"), F.col("i") * 7.0, F.col("j") * 7.0, F.col("i") * 7.0 + 7, F.col("j") * 7.0 + 7) / 49
    want = met.withColumn("w", part).where(F.col("w") > C.NOISE).groupBy("i", "j").agg(F.sum(F.col("value") * F.col("w")).alias("value"), F.sum("w").alias("coverage"))
    got, want = (d.toPandas().set_index(["i", "j"]).sort_index() for d in (C.resample_area(nodes, field, "value", 7.0), want))
    assert got.index.equals(want.index) and np.allclose(got.to_numpy(), want[["value", "coverage"]].to_numpy(), atol=1e-9)


def test_slanting_cells_meet_only_squares_at_their_height(monkeypatch):
    """Pairs are worked on in bounded parts, and those of a box's corners, far from the cell, are left out."""
    worked = []
    plain = C._areas_in_squares
    monkeypatch.setattr(C, "_areas_in_squares", lambda x, *rest: worked.append(len(x)) or plain(x, *rest))
    x, y = np.array([[0.0, 10.0, 1e6 + 10, 1e6]]), np.array([[0.0, 0.0, 100.0, 100.0]])
    areas = sum(w.sum() for _, _, _, w in C._square_sums(x, y, np.ones(1), 10.0)) * 100
    assert areas == pytest.approx(1000.0, rel=1e-6) and max(worked) <= C.PAIRS
    assert sum(worked) < 1.1 * 1e5  # the box holds ten times as many


def test_points_meet_runs_of_slanting_cells(spark):
    n = 3 * C.BLOCK
    nodes = spark.createDataFrame(slanting(n + 1, 3, 30_000.0), NODE)
    quads = C.cells(nodes)
    blocks = C._blocks(C._bounded(quads)).toPandas()
    assert len(blocks) == 6 and (blocks.x1 - blocks.x0 > 30_000).all() and (blocks.hi - blocks.lo < 1).all()
    rng = np.random.default_rng(3)
    points = []
    for k in range(300):
        i, j, u, v = int(rng.integers(n)), int(rng.integers(2)), rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99)
        points.append((k, float(10 * (i + u) + 30_000.0 * (j + v)), float(10 * (j + v)), i, j))
    df = spark.createDataFrame(points, "id long, x double, y double, wi long, wj long")
    got = C.locate(df, quads, 20.0).toPandas()
    assert sorted(got["id"]) == list(range(300)) and (got.i == got.wi).all() and (got.j == got.wj).all()
