"""Operators against brute force on small made-up inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspark.operators import cluster as C, episodes, grid as G, outline, tiles
from hotspark.operators.asof import asof, nearest_in_time
from hotspark.operators.components import components
from hotspark.operators.nearest import nearest_box
from hotspark.operators.ranking import number_rows, number_within
from hotspark.operators.setops import rows_once


def union_find(n, edges):
    p = list(range(n))

    def root(a):
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    for a, b in edges:
        p[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def groups(labels):
    out = {}
    for k, v in labels.items():
        out.setdefault(v, set()).add(k)
    return sorted(map(sorted, out.values()))


def solve(spark, n, edges, **kw):
    e = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src long, dst long")
    got = {r["id"]: r["root"] for r in components(e, **kw).collect()}
    return groups({i: got.get(i, i) for i in range(n)})


def test_components_shapes(spark):
    rng = np.random.default_rng(5)
    n = 300
    path = [(i, i + 1) for i in range(100)]
    hub = [(101, i) for i in range(102, 200)]
    rand = [tuple(x) for x in rng.integers(200, n, size=(70, 2)) if x[0] != x[1]]
    edges = path + hub + rand
    want = groups(dict(enumerate(union_find(n, edges))))
    assert solve(spark, n, edges) == want


def brute_clusters(xy, eps):
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    edges = [(i, j) for i, j in np.argwhere(d2 <= eps * eps) if i < j]
    return groups(dict(enumerate(union_find(len(xy), edges))))


@pytest.mark.parametrize("seed,eps", [(1, 30.0), (2, 12.0), (3, 55.0)])
def test_clusters_match_brute_force(spark, seed, eps):
    rng = np.random.default_rng(seed)
    # sparse points, and a dense blob that fills a few cells with many points each
    xy = np.vstack([rng.uniform(0, 600, (250, 2)), rng.normal(300, 8, (200, 2)), rng.normal(420, 6, (150, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in C.cluster_points(df, eps).collect()}
    assert groups(got) == brute_clusters(xy, eps)
    # numbers are 1..n in the order of the smallest point
    first = {}
    for i, c in got.items():
        first[c] = min(first.get(c, (math.inf, 0)), tuple(xy[i]))
    assert [c for c, _ in sorted(first.items(), key=lambda kv: kv[1])] == list(range(1, len(first) + 1))


def test_two_dense_cells_need_refinement(spark):
    # two columns of points whose boxes overlap the limit but whose points are never that close, and then are
    eps = 10.0
    a = [(0.0, 0.1 * k) for k in range(40)]
    b = [(10.5 + 0.01 * (k % 3), 0.1 * k) for k in range(40)]
    for extra, want in (([], 2), ([(9.9, 2.0)], 1)):
        rows = [(i, x, y) for i, (x, y) in enumerate(a + b + extra)]
        df = spark.createDataFrame(rows, "id long, x double, y double")
        assert C.cluster_points(df, eps).select("cluster").distinct().count() == want


def test_neighbour_cells_meet_by_tiles(spark):
    """Every pair of places of the reach once, with three copies of a cell, not twelve."""
    rng = np.random.default_rng(4)
    places = {(int(a), int(b)) for a, b in rng.integers(-20, 20, (700, 2))} | {(a, b) for a in range(40, 60) for b in range(-9, 11)}
    cells = spark.createDataFrame([(a, b, 0.0, 0.0, 0.0, 0.0) for a, b in places], "cx long, cy long, x0 double, y0 double, x1 double, y1 double")
    got = sorted(map(tuple, C._neighbours(cells).select("a.cx", "a.cy", "b.cx", "b.cy").collect()))
    assert got == sorted((a, b, a + dx, b + dy) for a, b in places for dx, dy in C._REACH if (a + dx, b + dy) in places)
    assert C._towards(cells).count() < 3.2 * len(places)


def test_distance_pairs_with_salt(spark):
    rng = np.random.default_rng(7)
    xy = np.vstack([rng.uniform(0, 50, (150, 2)), rng.normal(20, 2, (100, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    want = {(i, j) for i, j in np.argwhere(d2 <= 25.0) if i < j}
    assert {(r["a"], r["b"]) for r in C.distance_pairs(df, 5.0).collect()} == want
    left = df.select("id", F.floor(F.col("x") / 10).alias("k"))
    right = df.select(F.col("id").alias("id2"), F.floor(F.col("x") / 10).alias("k"))
    plain = sorted(map(tuple, left.join(right, "k").select("id", "id2").collect()))
    salted = sorted(map(tuple, C.salted_join(left, right, ["k"], per_salt=10).select("id", "id2").collect()))
    assert salted == plain


def test_numbering(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, "u" if i % 3 else "v") for i in range(1000)], "a long, k string")
    got = {r["a"]: r["n"] for r in number_rows(df, ["a"], "n").collect()}
    assert got == {a: i + 1 for i, a in enumerate(sorted(got))}
    for key in ("u", "v"):
        rows = sorted((r["a"], r["n"]) for r in number_within(df, ["k"], ["a"], "n").where(F.col("k") == key).collect())
        assert [n for _, n in rows] == list(range(1, len(rows) + 1))


def test_gap_split_equals_row_window(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), float(t)) for c, t in zip(rng.integers(0, 4, 300), rng.uniform(0, 400_000, 300))]
    df = spark.createDataFrame(rows, "cluster long, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["cluster"], r["s"]): r["episode"] for r in episodes.split_on_gaps(df, ["cluster"], "ts", 5000).collect()}
    for c in range(4):
        prev, ep = None, 1
        for s in sorted(s for k, s in rows if k == c):
            if prev is not None and s - prev > 5000:
                ep += 1
            assert got[(c, s)] == ep
            prev = s


def boxes_of(spark, arr, name):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(arr)], f"{name} long, x0 double, y0 double, x1 double, y1 double")


def some_boxes(rng, n, big):
    xy = rng.uniform(-500, 500, (n, 2))
    wh = rng.uniform(0.5, 20, (n, 2))
    wh[:big] *= 30
    return np.hstack([xy, xy + wh])


def test_small_boxes_do_not_meet_in_the_tiles_of_a_large_one(spark):
    small = [(k, 10.0 * (k % 20), 10.0 * (k // 20), 10.0 * (k % 20) + 1, 10.0 * (k // 20) + 1) for k in range(400)]
    wide = [(400, 0.0, 0.0, 200.0, 200.0)]
    a = spark.createDataFrame(small + wide, "ia long, x0 double, y0 double, x1 double, y1 double")
    b = a.withColumnRenamed("ia", "ib")
    assert tiles.box_pairs(a, b, 4.0).count() == 400 + 2 * 400 + 1
    # a small box may lie in four tiles of its own level; none of the 160,000 pairs of small boxes meets in a coarse one
    assert tiles.box_candidates(a, b, 4.0).count() < 4 * 400 + 2 * 400 * 4 + 4


def test_box_pairs_and_points_with_mixed_sizes(spark):
    rng = np.random.default_rng(11)
    a, b = some_boxes(rng, 80, 5), some_boxes(rng, 120, 4)
    got = sorted((r["a"]["ia"], r["b"]["ib"]) for r in tiles.box_pairs(boxes_of(spark, a, "ia"), boxes_of(spark, b, "ib"), 10.0, 3.0).collect())
    want = sorted(
        (i, j) for i in range(80) for j in range(120)
        if a[i, 0] - 3 <= b[j, 2] and b[j, 0] <= a[i, 2] + 3 and a[i, 1] - 3 <= b[j, 3] and b[j, 1] <= a[i, 3] + 3
    )
    assert got == want
    pts = rng.uniform(-500, 500, (300, 2))
    pdf = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    inside = {i for i, (x, y) in enumerate(pts) if ((b[:, 0] <= x) & (x <= b[:, 2]) & (b[:, 1] <= y) & (y <= b[:, 3])).any()}
    kept = {r["id"] for r in tiles.split_by_mask(pdf, boxes_of(spark, b, "ib"), 10.0, keep=True).collect()}
    gone = [r["id"] for r in tiles.split_by_mask(pdf, boxes_of(spark, b, "ib"), 10.0, keep=False).collect()]
    assert kept == set(range(300)) - inside and sorted(gone) == sorted(inside)
    near = {r["ia"]: r["dist"] for r in nearest_box(boxes_of(spark, a, "ia"), "ia", boxes_of(spark, b, "ib"), "ib", 25.0).collect()}
    for i in range(80):
        gx = np.maximum(np.maximum(b[:, 0] - a[i, 2], a[i, 0] - b[:, 2]), 0)
        gy = np.maximum(np.maximum(b[:, 1] - a[i, 3], a[i, 1] - b[:, 3]), 0)
        d = np.sqrt(gx**2 + gy**2).min()
        assert (i in near) == (d <= 25.0)
        if i in near:
            assert near[i] == pytest.approx(d)


@pytest.mark.parametrize("strict,parts", [(False, None), (True, None), (False, 1), (True, 7), (False, 50), (True, 50)])
def test_asof_with_keys_gaps_and_a_hot_time(spark, strict, parts):
    """Half of the left rows stand at one time, which is a right time too; null times and keys, repeated rows."""
    rng = np.random.default_rng(2)
    left = [(i, int(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 3000, 200)))]
    left += [(200 + i, i % 3, 900) for i in range(200)] + [(400, None, 950), (401, 1, None), (402, 1, None), (402, 1, None)]
    right = [(int(k), int(t)) for k, t in zip(rng.integers(0, 3, 40), rng.choice([5, 40, 41, 900, 901, 902, 2500], 40))] + [(None, 30), (0, 900), (2, 40), (1, None)]
    ldf = spark.createDataFrame(left, "id long, k long, t long").withColumn("ts", F.timestamp_seconds("t"))
    rdf = spark.createDataFrame(right, "k long, v long").withColumn("rts", F.timestamp_seconds("v"))
    rows = asof(ldf, rdf, "ts", "rts", ["v"], "m", ["k"], strict, parts).collect()
    got = sorted((r["id"], r["m"]["row"]["v"] if r["m"] else -1) for r in rows)
    want = []
    for i, k, t in left:
        best = [v for kk, v in right if kk == k and None not in (t, v) and (v < t if strict else v <= t)]
        want.append((i, max(best, default=-1)))
    assert got == sorted(want)
    assert rows[0].asDict().keys() == {"id", "k", "t", "ts", "m"}


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_nearest_in_time(spark, parts):
    rng = np.random.default_rng(4)
    left = [int(t) for t in rng.integers(0, 300, 150)] + [77] * 100
    right = sorted({int(t) for t in rng.integers(50, 250, 30)} | {77})
    ldf = spark.createDataFrame([(i, t) for i, t in enumerate(left)], "id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    rdf = spark.createDataFrame([(v,) for v in right], "v long").withColumn("rts", F.timestamp_seconds("v"))
    got = {r["id"]: r["m"]["v"] for r in nearest_in_time(ldf, rdf, "ts", "rts", ["v"], "m", parts).collect()}
    assert got == {i: min(right, key=lambda v: (abs(v - t), v)) for i, t in enumerate(left)}
    assert {r["m"] for r in nearest_in_time(ldf, rdf.limit(0), "ts", "rts", ["v"], "m", parts).collect()} == {None}


def test_hull_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(outline, "HULL_CHUNK", 50)
    rng = np.random.default_rng(9)
    xy = rng.normal(0, 100, (700, 2))
    rows = [(1 if i < 600 else 2, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    got = {r["k"]: r for r in outline.convex_outline(spark.createDataFrame(rows, "k long, x double, y double"), ["k"]).collect()}
    from hotspark.functions.kernels import convex_hull, ring_area

    for k, part in ((1, xy[:600]), (2, xy[600:])):
        assert got[k]["area"] == pytest.approx(ring_area(convex_hull(part)))
        assert got[k]["n_points"] == len(part)


def test_alpha_outline_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(4)
    # a long band that crosses several tiles
    xy = np.column_stack([rng.uniform(0, 60_000, 500), rng.uniform(0, 6_000, 500)])
    eps = 2000.0
    rows = [(1, float(x), float(y)) for x, y in xy]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    a = outline.alpha_outline(df, ["k"], eps, tile=200).first()
    b = outline.alpha_outline(df, ["k"], eps, tile=8).first()
    assert a["kind"] == "Polygon" and a["area"] > 0
    assert a["area"] == pytest.approx(b["area"], rel=1e-6)
    assert a["edges"] == b["edges"]


def test_rows_once_counts_null_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (3, "b"), (3, "b")], "a long, b string")
    assert [tuple(r) for r in rows_once(df).collect()] == [(2, "a")]


def test_neighbour_mean_of_known_grid(spark):
    # documented 3 x 3 example: 1..9
    g = spark.createDataFrame([(i, j, float(3 * i + j + 1)) for i in range(3) for j in range(3)], "i long, j long, value double")
    got = {(r["i"], r["j"]): r["mean8"] for r in G.neighbour_mean(g, "value", G.extent(g)).collect()}
    assert got[(1, 1)] == pytest.approx(5.0)
    assert got[(0, 0)] == pytest.approx((2 + 4 + 5) / 3)
    assert got[(2, 0)] == pytest.approx((4 + 5 + 8) / 3)
    assert got[(0, 1)] == pytest.approx((1 + 3 + 4 + 5 + 6) / 5)


def test_gap_fill_recovers_a_plane(spark):
    rows = [(i, j, float(2 * i + j)) for i in range(24) for j in range(24) if (i * 5 + j * 3) % 4]
    g = spark.createDataFrame(rows, "i long, j long, value double")
    got = {(r["i"], r["j"]): r["filled"] for r in G.fill_blocks(g, "value", 8, G.extent(g)).collect()}
    assert len(got) == 24 * 24 - len(rows)
    inner = [abs(v - (2 * i + j)) for (i, j), v in got.items() if 3 < i < 20 and 3 < j < 20]
    assert max(inner) < 0.5


def test_rate_of_spread_of_a_steady_front(spark):
    rows = [(i, j, 100.0 * i, 0.0) for i in range(9) for j in range(9)]
    g = spark.createDataFrame(rows, "i long, j long, arrival double, h double")
    r = {(x["i"], x["j"]): x for x in G.rate_of_spread(g, "arrival", "h", 50.0, G.extent(g)).collect()}
    assert r[(4, 4)]["ros"] == pytest.approx(0.5) and r[(4, 4)]["nx"] == pytest.approx(1.0)


def test_alpha_outline_backs_off_and_gives_rings(spark):
    """A ring of points has no small triangle at first; the wider radius fills it and the rim comes out closed."""
    k = np.arange(24)
    ring = np.c_[1000 + 60 * np.cos(2 * np.pi * k / 24), 1000 + 60 * np.sin(2 * np.pi * k / 24)]
    lattice = np.array([(10.0 * i, 10.0 * j) for i in range(12) for j in range(9)])
    rows = [(1, float(x), float(y)) for x, y in ring] + [(2, float(x), float(y)) for x, y in lattice]
    out = {r["k"]: r for r in outline.alpha_outline(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], 40.0).collect()}
    assert out[1]["kind"] == out[2]["kind"] == "Polygon" and out[1]["area"] > 0
    # the octagons reach a quarter of the spacing beyond the lattice
    assert 110 * 80 <= out[2]["area"] <= 115.1 * 85.1
    for r in out.values():
        areas = [outline.ring_area(np.array([(p["x"], p["y"]) for p in ring])) for ring in r["rings"]]
        assert areas[0] - sum(areas[1:]) <= r["area"] * 1.001 and areas[0] >= r["area"] * 0.999


def test_hull_of_more_corners_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(outline, "HULL_CHUNK", 50)
    k = np.arange(200)
    rows = [(1, float(np.cos(2 * np.pi * i / 200)), float(np.sin(2 * np.pi * i / 200))) for i in k]
    r = outline.convex_outline(spark.createDataFrame(rows, "k int, x double, y double"), ["k"]).first()
    assert r["n_points"] == 200 and len(r["ring"]) == 200


def test_hulls_of_many_groups_in_one_call():
    import pyarrow as pa

    square, line = [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)], [(0, 0), (1, 1), (2, 2)]
    xy = np.array([*square, *line, (7, 7)], float)
    value = {"x": pa.array(xy[:, 0]), "y": pa.array(xy[:, 1]), "n": pa.array(np.ones(len(xy), np.int64))}
    group, out = outline._last_hull(value, np.array([5, 3, 1]), {})
    assert group.tolist() == [0, 1, 2] and out["n_points"].tolist() == [5, 3, 1]
    assert out["kind"] == ["Polygon", "LineString", "Point"] and out["area"] == [16.0, 0.0, 0.0]
    assert [len(r) for r in out["ring"].to_pylist()] == [4, 2, 1]
    group, out = outline._partial_hull(value, np.array([5, 3, 1]), {})
    assert group.tolist() == [0, 0, 0, 0, 1, 1, 2] and out["n"].tolist() == [5, 0, 0, 0, 3, 0, 1]
