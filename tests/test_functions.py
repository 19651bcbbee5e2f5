"""Scalar and geometry functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspark.functions import geom, kernels as K, proj
from hotspark.functions.names import clean_name, event_label
from hotspark.functions.proj import laea, laea_inverse
from hotspark.functions.timefns import packed_time, polar_time
from hotspark.sources import readers as R, writers as W


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_equal_area_check_point(spark):
    x, y = laea(F.lit(5.0), F.lit(50.0))
    r = one(spark, x.alias("x"), y.alias("y"))
    assert r["x"] == pytest.approx(3962799.45, abs=0.01) and r["y"] == pytest.approx(2999718.85, abs=0.01)
    lon, lat = laea_inverse(F.lit(r["x"]), F.lit(r["y"]))
    b = one(spark, lon.alias("lon"), lat.alias("lat"))
    assert b["lon"] == pytest.approx(5.0, abs=1e-7) and b["lat"] == pytest.approx(50.0, abs=1e-7)


def test_times(spark):
    slot = F.lit("2024-01-01 10:20:00").cast("timestamp")
    vals = [(F.lit(59.0), "2024-01-01 10:20:59"), (F.lit(-60.0), "2024-01-01 10:19:00"), (F.lit(20240203040506.0), "2024-02-03 04:05:06"),
            (F.lit(99999999999999.0), None)]
    for v, want in vals:
        got = one(spark, packed_time(v, slot).cast("string").alias("t"))["t"]
        assert got == want
    assert one(spark, polar_time(F.lit("2024-03-01"), F.lit(5)).cast("string").alias("t"))["t"] == "2024-03-01 00:05:00"


def test_names(spark):
    r = one(spark, clean_name(F.lit(None).cast("string"), F.lit("Saint-Étienne du Bœuf")).alias("n"), event_label(F.lit(None).cast("string"), F.lit("2024-01-02").cast("timestamp")).alias("l"))
    assert r["n"] == "Saint-EtienneduBoeuf" and r["l"] == "fire_XX_20240102"


def random_convex(rng, n=8):
    return K.convex_hull(rng.uniform(0, 10, (n, 2)))


def test_overlap_area_of_rectangles_and_convex_shapes():
    a = np.array([(0, 0), (4, 0), (4, 3), (0, 3)], float)
    assert K.overlap_area([a], [a + [1, 1]]) == pytest.approx(6.0)
    assert K.overlap_area([a], [a + [5, 0]]) == 0.0
    hole = np.array([(1, 1), (2, 1), (2, 2), (1, 2)], float)
    assert K.overlap_area([a, hole], [a]) == pytest.approx(11.0)
    rng = np.random.default_rng(1)
    for _ in range(20):
        p, q = random_convex(rng), random_convex(rng)
        assert K.overlap_area([p], [p]) == pytest.approx(K.ring_area(p))
        pts = rng.uniform(0, 10, (40_000, 2))
        sp, sq = K._segments([p]), K._segments([q])
        share = (K.inside(pts, sp) & K.inside(pts, sq)).mean() * 100
        assert K.overlap_area([p], [q]) == pytest.approx(share, abs=1.2)
        assert K.overlap_area([p], [q]) == pytest.approx(K.overlap_area([q], [p]))


def test_concave_overlap():
    c = np.array([(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)], float)
    bar = np.array([(-1, 4), (7, 4), (7, 5), (-1, 5)], float)
    assert K.overlap_area([c], [bar]) == pytest.approx(4.0)


def _star(rng, n):
    t = (np.arange(n) + rng.uniform(0, 0.9, n)) * 2 * np.pi / n
    return np.column_stack([np.cos(t), np.sin(t)]) * rng.uniform(1, 4, n)[:, None] + rng.uniform(0, 5, 2)


def test_many_pairs_share_a_call(monkeypatch):
    """Overlaps of many pairs are those of each pair, and small pairs do not become a call each."""
    rng = np.random.default_rng(4)
    box = np.array([(0, 0), (3, 0), (3, 2), (0, 2)], float)
    pairs = [([box], [box]), ([box], [box + [3, 0]]), ([box], [box[::-1] + [1, 1]]), ([], [box]), ([box[:2]], [box]), ([box, box / 2], [box + 0.5])]
    pairs += [([_star(rng, int(n))], [_star(rng, int(m)), _star(rng, 3)]) for n, m in rng.integers(3, 13, (60, 2))]
    pairs += [([_star(rng, 900)], [_star(rng, 700)]), ([np.array([(0, np.nan), (1, 0), (1, 1)])], [box])]
    plain = [K.overlap_area(a, b) for a, b in pairs]
    seg = [[K._segments(p[k]) for p in pairs] for k in (0, 1)]
    flat = [x for s in seg for x in (np.concatenate(s), np.repeat(np.arange(len(s)), [len(v) for v in s]))]
    calls, one = [], K._overlap
    monkeypatch.setattr(K, "_overlap", lambda a, b: (calls.append(len(a)), one(a, b))[1])
    assert K.overlap_areas(*flat, len(pairs)) == pytest.approx(plain, abs=1e-9, nan_ok=True)
    assert sorted(calls) == [3, 900]


def test_overlap_column(spark):
    ring = "array<struct<x:double,y:double>>"
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    moved = [(x + 2, y) for x, y in square]
    rows = [(1, [square], [moved]), (2, [square, hole], [square]), (3, [], [square]), (4, [[], square], [moved]), (5, [square[:2]], [square]), (6, [square, hole], [moved])]
    df = spark.createDataFrame(rows, f"id int, a array<{ring}>, b array<{ring}>").repartition(1)
    got = {r["id"]: r["v"] for r in df.select("id", geom.overlap_area(F.col("a"), F.col("b")).alias("v")).collect()}
    assert got == pytest.approx({1: 8.0, 2: 12.0, 3: 0.0, 4: 8.0, 5: 0.0, 6: 6.0})


def test_surface_through_distinct_places_is_solved(monkeypatch):
    rng = np.random.default_rng(6)
    every = np.array([(i, j) for i in range(24) for j in range(24)], float)
    known = rng.random(len(every)) < 0.5
    xy, at, z = every[known], every[~known], rng.uniform(0, 2.6e6, known.sum())
    d, e = (np.sqrt(((p[:, None] - xy[None]) ** 2).sum(axis=2) + 1) for p in (xy, at))
    plain = e @ np.linalg.lstsq(d, z, rcond=None)[0]
    twice = K.multiquadric_fill(np.vstack([xy, xy[:5]]), np.concatenate([z, z[:5]]), at, 1.0)
    assert twice == pytest.approx(plain, abs=1e-4)

    def slow(*_, **__):
        raise AssertionError("least squares")

    monkeypatch.setattr(np.linalg, "lstsq", slow)
    assert K.multiquadric_fill(xy, z, at, 1.0) == pytest.approx(plain, abs=1e-4)


def test_hull_holds_all_points():
    rng = np.random.default_rng(3)
    pts = rng.normal(0, 1, (200, 2))
    h = K.convex_hull(pts)
    nxt = np.roll(h, -1, axis=0)
    cross = (nxt - h)[None, :, 0] * (pts[:, None, 1] - h[None, :, 1]) - (nxt - h)[None, :, 1] * (pts[:, None, 0] - h[None, :, 0])
    assert (cross >= -1e-9).all()


def test_delaunay_covers_the_hull():
    rng = np.random.default_rng(8)
    pts = rng.uniform(0, 100, (120, 2))
    tri = K.delaunay(pts)
    a, b, c = (pts[tri[:, k]] for k in range(3))
    areas = 0.5 * np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    assert areas.sum() == pytest.approx(K.ring_area(K.convex_hull(pts)), rel=1e-3)
    x, y, r2 = K._circle(a, b, c)
    d2 = (pts[None, :, 0] - x[:, None]) ** 2 + (pts[None, :, 1] - y[:, None]) ** 2
    assert (d2 >= r2[:, None] * (1 - 1e-6) - 1e-6).all()


def test_ring_columns(spark):
    ring = geom.box_ring(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0))
    r = one(
        spark, geom.area(ring).alias("a"), geom.length(ring).alias("l"), geom.contains(ring, F.lit(1.0), F.lit(1.0)).alias("c"),
        geom.distance(ring, F.lit(7.0), F.lit(6.0)).alias("d"), geom.covers(ring, F.lit(4.0), F.lit(1.0)).alias("edge"), F.size(geom.densify(ring, 5)).alias("n"),
    )
    assert (r["a"], r["l"], r["c"], r["d"], r["edge"], r["n"]) == (8.0, 12.0, True, 5.0, True, 20)


def test_points_to_thin_out_are_made_once(spark):
    """Measures take rings made by an expression; it is worked out once a measure, not once a corner."""
    # the expression's nodes in a plan say how often it is worked out
    ring = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.cos(k).alias("x"), F.sin(k).alias("y")))
    df = spark.range(21).select((F.col("id") + 20).cast("int").alias("n"))
    for measure in (geom.stride(ring, 7), geom.area(ring), geom.length(ring), geom.centroid(ring)):
        plan = df.select(measure.alias("m"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("sequence(") == 1
    got = df.select("n", geom.stride(ring, 7).alias("s")).collect()
    assert [len(r.s) for r in got] == [-(-r.n // -(-r.n // 7)) for r in got]


def test_hexagons_partition_the_plane(spark):
    rng = np.random.default_rng(6)
    pts = [(float(x), float(y)) for x, y in rng.uniform(-50, 50, (300, 2))]
    df = spark.createDataFrame(pts, "x double, y double")
    h = geom.hex_cell(F.col("x"), F.col("y"), 7.0)
    ring = geom.hex_ring(h, 7.0)
    bad = df.where(~geom.covers(ring, F.col("x"), F.col("y")) & (geom.boundary_distance(F.col("x"), F.col("y"), ring) > 1e-9))
    assert bad.count() == 0


def test_geojson_goes_round(spark, tmp_path):
    ring = geom.box_ring(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(5.0))
    text = one(spark, geom.geojson_polygon(ring, F.struct(F.lit("a").alias("name"))).alias("f"))["f"]
    (tmp_path / "layer.geojson").write_text('{"type": "FeatureCollection", "features": [' + text + "]}")
    back = R.read_polygons(spark, str(tmp_path / "layer.geojson"))
    row = back.select("kind", F.element_at("properties", "name").alias("name"), geom.area(F.slice("ring", 1, 4)).alias("a")).first()
    assert tuple(row) == ("Polygon", "a", 6.0)


def test_snapshot_is_replaced_not_doubled(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "a long, snapshot_ts string")
    W.write_hotspots(rows, str(tmp_path / "s"))
    W.write_hotspots(rows.where("a = 2"), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 2 and back.where("ABS_LINE = -999").count() == 2


def test_empty_slot_is_typed(spark):
    assert R.empty_hotspots(spark).schema == R.POLAR_SCHEMA


def test_large_folders_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ROWS_PER_FILE", 200)
    df = spark.range(3000).select(F.lit(7.0).alias("frp"), F.lit("2024-01-01").alias("acq_date"), F.when(F.col("id") < 2500, 130).otherwise(1245).alias("acq_time"))
    W.write_hourly(df, str(tmp_path / "t"))
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    sizes = [r["n"] for r in back.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 200


def test_columns_are_bound_by_header(spark, tmp_path):
    """Files in the product's own order and in another one; unknown, missing and mixed headers; no files."""
    def put(name, *lines):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"{len(list((tmp_path / name).iterdir()))}.csv").write_text("\n".join(lines) + "\n")

    put("geo", "BW_SIZE,FRP,LONGITUDE,Latitude,ACQTIME", "7,12.5,3.25,44.5,30")
    raw = R.read_by_header(spark, str(tmp_path / "geo"), R.GEO_SCHEMA, R.GEO_REQUIRED).first()
    assert (raw.BW_SIZE, raw.FRP, raw.LONGITUDE, raw.LATITUDE, raw.ACQTIME, raw.BT_MIR) == (7, 12.5, 3.25, 44.5, 30, None)
    put("polar", ",".join(R.POLAR_COLUMNS), "44.1,3.2,330.5,0.4,0.5,2024-01-02,7,N,VIIRS,n,2.0NRT,290.2,7.5,D")
    raw = R.read_polar(spark, str(tmp_path / "polar"))
    row = R.clean_polar(raw).first()
    assert (row.acq_time, row.frp, row.daynight, str(row.ts)) == (7, 7.5, "D", "2024-01-02 00:07:00")
    put("both", ",".join(reversed(R.POLAR_COLUMNS)), "N,1.5,280.0,v,n,VIIRS,N,1230,2024-01-03,0.5,0.4,300.0,4.0,45.0")
    two = R.read_platforms(spark, [str(tmp_path / "polar"), str(tmp_path / "both")], R.POLAR_SCHEMA, ["frp"])
    assert sorted((r.latitude, r.frp) for r in two.collect()) == [(44.1, 7.5), (45.0, 1.5)]
    put("bad", "LATITUDE,LONGITUDE,FRP,ACQTIME,SURPRISE", "1,2,3,4,5")
    with pytest.raises(ValueError, match="SURPRISE"):
        R.read_by_header(spark, str(tmp_path / "bad"), R.GEO_SCHEMA, R.GEO_REQUIRED)
    put("less", "LATITUDE,LONGITUDE", "1,2")
    with pytest.raises(ValueError, match="ACQTIME"):
        R.read_by_header(spark, str(tmp_path / "less"), R.GEO_SCHEMA, R.GEO_REQUIRED)
    put("geo", "FRP,BW_SIZE,LONGITUDE,Latitude,ACQTIME", "1,2,3,4,5")
    with pytest.raises(Exception):
        R.read_by_header(spark, str(tmp_path / "geo"), R.GEO_SCHEMA, R.GEO_REQUIRED).collect()
    (tmp_path / "none").mkdir()
    assert R.read_polar(spark, str(tmp_path / "none")).columns == R.POLAR_COLUMNS and R.read_polar(spark, str(tmp_path / "none")).count() == 0



@pytest.mark.parametrize("epsg,lon,lat", [(25829, -7.3, 40.6), (6679, 141.9, 39.0), (9473, 149.6, -32.0), (25832, 10.7, 59.9)])
def test_grids_keep_angles_or_areas(spark, epsg, lon, lat):
    """Finite differences: transverse grids are conformal, the conic one keeps areas; on the meridian lengths are exact."""
    d = 1e-5
    cols = []
    for name, (a, b) in {"o": (lon, lat), "e": (lon + d, lat), "n": (lon, lat + d)}.items():
        x, y = proj.project(F.lit(a), F.lit(b), epsg)
        cols += [x.alias(name + "x"), y.alias(name + "y")]
    r = spark.range(1).select(*cols).first()
    e, n = np.array([r.ex - r.ox, r.ey - r.oy]), np.array([r.nx - r.ox, r.ny - r.oy])
    s = np.sin(np.radians(lat))
    east = proj.GRS80_A * np.cos(np.radians(lat)) / np.sqrt(1 - proj.E2 * s * s) * np.radians(d)
    north = proj.GRS80_A * (1 - proj.E2) / (1 - proj.E2 * s * s) ** 1.5 * np.radians(d)
    if epsg == 9473:
        assert e[0] * n[1] - e[1] * n[0] == pytest.approx(east * north, rel=1e-6)
    else:
        assert np.hypot(*e) / east == pytest.approx(np.hypot(*n) / north, rel=1e-6)
        assert abs(e @ n) / (np.hypot(*e) * np.hypot(*n)) < 1e-5


def test_meridian_length(spark):
    x, y = proj.utm(F.lit(9.0), F.lit(52.0), 32)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    t = np.radians(np.linspace(0, 52, 200_001))
    m = proj.GRS80_A * (1 - proj.E2) / (1 - proj.E2 * np.sin(t) ** 2) ** 1.5
    assert r.x == pytest.approx(500_000.0) and r.y == pytest.approx(0.9996 * np.trapezoid(m, t), abs=1e-3)


def test_cylindrical_equal_area(spark):
    x, y = proj.equal_area_cylindrical(F.lit(30.0), F.lit(90.0), 0.0, 30.0)
    lon, lat = proj.equal_area_cylindrical_inverse(x, y, 0.0, 30.0)
    r = spark.range(1).select(x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat")).first()
    assert r.lon == pytest.approx(30) and r.lat == pytest.approx(90, abs=1e-4)
    # a twelfth of the half sphere's area
    assert r.x * r.y == pytest.approx(2 * np.pi * proj.RQ**2 / 12, rel=1e-9)


def test_delaunay_of_many_sets_is_that_of_each():
    rng = np.random.default_rng(5)
    sets = [rng.uniform(0, 100, (int(n), 2)) for n in rng.integers(3, 40, 30)]
    count = np.array([len(s) for s in sets])
    tri, at = K.delaunay_sets(np.concatenate(sets), count)
    first = np.cumsum(count) - count
    for k, s in enumerate(sets):
        assert {frozenset((t - first[k]).tolist()) for t in tri[at == k]} == {frozenset(t.tolist()) for t in K.delaunay(s)}
