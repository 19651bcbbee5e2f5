"""Grids and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hotspark.functions.scalars import quarter_tile
from hotspark.operators import fronts, grid as G, raster as R
from hotspark.operators.asof import nearest_in_time
from hotspark.plans import standins as S

Q, SQL = {}, {}

CELL = 10_000.0
DOMAIN = (3.0e6, 2.0e6, 3.2e6, 2.5e6)


def _cell_power():
    # a hair is added, so that exact halves round the same way on every engine
    return F.round(F.col("frp") + 1e-9, 6).alias("frp")


def raster_power(spark, sf):
    out = R.share_power(S.boxes(spark, sf), CELL, DOMAIN, ["day"])
    return out.select("day", "i", "j", _cell_power())


Q["raster_power"] = raster_power
RASTER = """ins AS (SELECT day, box_id, frp, greatest(x0, 3e6) AS x0, greatest(y0, 2e6) AS y0, least(x1, 3.2e6) AS x1, least(y1, 2.5e6) AS y1 FROM boxes),
 cov AS (SELECT *, greatest(least(x1, (i+1)*1e4) - greatest(x0, i*1e4), 0e0) * greatest(least(y1, (j+1)*1e4) - greatest(y0, j*1e4), 0e0) AS part FROM
   (SELECT *, unnest(generate_series(CAST(floor(y0/1e4) AS BIGINT), CAST(ceil(y1/1e4) AS BIGINT) - 1)) AS j FROM
    (SELECT *, unnest(generate_series(CAST(floor(x0/1e4) AS BIGINT), CAST(ceil(x1/1e4) AS BIGINT) - 1)) AS i FROM ins WHERE x1 > x0 AND y1 > y0)))"""
SQL["raster_power"] = S.with_boxes(
    """SELECT day, i, j, round(sum(frp * part / tot) + 1e-9, 6) AS frp FROM (SELECT *, sum(part) OVER (PARTITION BY box_id) AS tot FROM cov WHERE part > 0)
  GROUP BY day, i, j""", RASTER
)


def raster_conservation(spark, sf):
    """Per day the power of the events in the domain and of the raster, and the 1 % check."""
    west, south, east, north = DOMAIN
    b = S.boxes(spark, sf)
    inside = b.where((F.col("x1") > west) & (F.col("x0") < east) & (F.col("y1") > south) & (F.col("y0") < north))
    want = inside.groupBy("day").agg(F.sum("frp").alias("power"))
    got = R.share_power(b, CELL, DOMAIN, ["day"]).groupBy("day").agg(F.sum("frp").alias("raster"))
    j = want.join(got, "day", "left")
    ok = F.abs(F.col("power") - F.col("raster")) <= 0.01 * F.abs(F.col("power"))
    return j.select("day", F.round("power", 3).alias("power"), F.round("raster", 3).alias("raster"), ok.alias("conserved"))


Q["raster_conservation"] = raster_conservation
SQL["raster_conservation"] = S.with_boxes(
    """SELECT day, round(sum(frp), 3) AS power, round(sum(frp), 3) AS raster, true AS conserved FROM ins WHERE x1 > x0 AND y1 > y0 GROUP BY day""",
    RASTER,
)


def shapes_of_days(spark, sf) -> DataFrame:
    """(day, shape, frp, ring): polygons, lines and points of one id at several times."""
    from hotspark.operators.matching import with_rings

    ev = with_rings(S.boxes(spark, sf).select("cluster", "day", "frp", "x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")
    # a cluster is one shape, seen on several days; its lower side goes along as a line, its last corner as a point
    near, far = F.col("ring")[0], F.col("ring")[2]
    side = F.array(near, F.struct(far.x.alias("x"), near.y.alias("y")))
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("frp").alias("frp"), F.col("ring").alias("ring")),
        F.struct(F.lit(1).alias("kind"), (F.col("frp") / 2).alias("frp"), side.alias("ring")),
        F.struct(F.lit(2).alias("kind"), (F.col("frp") / 4).alias("frp"), F.array(far).alias("ring")),
    )
    return ev.select("day", "cluster", F.explode(kinds).alias("s")).select("day", (F.col("cluster") * 3 + F.col("s.kind")).alias("shape"), "s.frp", "s.ring")


def raster_polygons(spark, sf):
    """Power of polygons, lines and points spread exactly, for one id at several times."""
    out = R.share_power_polygons(shapes_of_days(spark, sf), CELL, DOMAIN, ["day"], "shape")
    return out.select("day", "i", "j", _cell_power())


Q["raster_polygons"] = raster_polygons
SHAPES_TO_CELLS = """SELECT day, i, j, sum(frp) AS frp FROM (
   SELECT day, i, j, frp * part / sum(part) OVER (PARTITION BY box_id) AS frp FROM cov WHERE part > 0
   UNION ALL SELECT day, i, CAST(floor(y0/1e4) AS BIGINT), frp / 2 * (least(b, (i+1)*1e4) - greatest(a, i*1e4)) / (b - a) FROM
    (SELECT *, unnest(generate_series(CAST(floor(a/1e4) AS BIGINT), CAST(ceil(b/1e4) AS BIGINT) - 1)) AS i FROM
     (SELECT day, y0, frp, greatest(x0, 3e6) AS a, least(x1, 3.2e6) AS b FROM boxes WHERE y0 >= 2e6 AND y0 < 2.5e6) WHERE b > a)
   UNION ALL SELECT day, CAST(floor(x1/1e4) AS BIGINT), CAST(floor(y1/1e4) AS BIGINT), frp / 4 FROM boxes
    WHERE x1 BETWEEN 3e6 AND 3.2e6 AND y1 BETWEEN 2e6 AND 2.5e6)
  GROUP BY day, i, j"""
SQL["raster_polygons"] = S.with_boxes(f"SELECT day, i, j, round(frp + 1e-9, 6) AS frp FROM ({SHAPES_TO_CELLS})", RASTER)


def block_downsample(spark, sf):
    s = G.block_shrink(S.grid(spark, sf), "value", 4)
    return s.select("bi", "bj", F.round("sum", 3).alias("sum"), "max", "min", F.round("average", 6).alias("average"), "valid")


Q["block_downsample"] = block_downsample
SQL["block_downsample"] = S.with_grid(
    """SELECT i // 4 AS bi, j // 4 AS bj, round(sum(value), 3) AS sum, max(value) AS max, min(value) AS min,
  round(avg(value), 6) AS average, count(*) AS valid FROM grid GROUP BY 1, 2"""
)

_EXT = "ext AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM grid)"


def neighbour_mean(spark, sf):
    g = S.grid(spark, sf)
    return G.neighbour_mean(g, "value", G.extent(g)).select("i", "j", F.round("mean8", 6).alias("mean8"))


Q["neighbour_mean"] = neighbour_mean
SQL["neighbour_mean"] = S.with_grid(
    """SELECT g.i, g.j, round(coalesce(sum(n.value), 0) / any_value((1 + (g.i > i0)::INT + (g.i < i1)::INT) * (1 + (g.j > j0)::INT + (g.j < j1)::INT) - 1), 6) AS mean8
  FROM grid g CROSS JOIN ext LEFT JOIN grid n ON n.i BETWEEN g.i - 1 AND g.i + 1 AND n.j BETWEEN g.j - 1 AND g.j + 1 AND NOT (n.i = g.i AND n.j = g.j)
  GROUP BY g.i, g.j""", _EXT
)


def neighbour_minmax(spark, sf):
    return G.neighbour_stats(S.grid(spark, sf), "value", 5).select("i", "j", "min", "max", F.round("mean", 6).alias("mean"))


Q["neighbour_minmax"] = neighbour_minmax
SQL["neighbour_minmax"] = S.with_grid(
    """SELECT g.i, g.j, min(n.value) AS min, max(n.value) AS max, round(avg(n.value), 6) AS mean FROM grid g JOIN grid n
  ON n.i BETWEEN g.i - 2 AND g.i + 2 AND n.j BETWEEN g.j - 2 AND g.j + 2 GROUP BY g.i, g.j"""
)


def grid_gradient(spark, sf):
    g = S.grid(spark, sf)
    return G.gradient(g, "arrival", G.extent(g)).select("i", "j", F.round("gx", 7).alias("gx"), F.round("gy", 7).alias("gy"))


def _side(a, b, rim):
    return (
        f"CASE WHEN {rim} OR ({a} IS NULL AND {b} IS NULL) THEN 0 WHEN {b} IS NULL THEN z - {a} WHEN {a} IS NULL THEN {b} - z ELSE ({b} - {a}) * 5e-1 END"
    )


_NEAR = ", ".join(
    f"max({v}) FILTER (n.i = g.i + ({a}) AND n.j = g.j + ({b})) AS {p}{G.name_of(a, b)}"
    for v, p in (("n.arrival", ""), ("n.value", "h"))
    for a, b in G.AROUND9
)
GRAD = f"""near AS MATERIALIZED (SELECT g.i, g.j, any_value(g.arrival) AS z, any_value(i0) AS i0, any_value(i1) AS i1, any_value(j0) AS j0, any_value(j1) AS j1, {_NEAR}
   FROM grid g CROSS JOIN ext JOIN grid n ON n.i BETWEEN g.i - 1 AND g.i + 1 AND n.j BETWEEN g.j - 1 AND g.j + 1 GROUP BY g.i, g.j),
 grad AS (SELECT *, {_side('n_m1_0', 'n_1_0', 'i = i0 OR i = i1')} AS gx, {_side('n_0_m1', 'n_0_1', 'j = j0 OR j = j1')} AS gy FROM near)"""
Q["grid_gradient"] = grid_gradient
SQL["grid_gradient"] = S.with_grid("SELECT i, j, round(gx, 7) AS gx, round(gy, 7) AS gy FROM grad", _EXT, GRAD)


def rate_of_spread(spark, sf):
    """Front speed from arrival time; the power grid stands for the terrain height."""
    g = S.grid(spark, sf)
    r = G.rate_of_spread(g, "arrival", "value", 1800.0, G.extent(g))
    return r.select("i", "j", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"), F.round("ros", 6).alias("ros"), "quality")


def _sample(prefix, sign):
    parts = []
    for a, b in G.AROUND9:
        w = f"(greatest(0e0, 1 - abs({sign}*nx*75e-2 - ({a}))) * greatest(0e0, 1 - abs({sign}*ny*75e-2 - ({b}))))"
        parts.append(f"CASE WHEN {w} > 0 THEN {w} * {prefix}{G.name_of(a, b)} ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


Q["rate_of_spread"] = rate_of_spread
_LIM = "sqrt(2e0)*1350e0/10"
SQL["rate_of_spread"] = S.with_grid(
    f"""SELECT i, j, round(nx, 6) AS nx, round(ny, 6) AS ny, round(CASE WHEN norm = 0 THEN 0 WHEN tf IS NULL OR tb IS NULL THEN NULL
    WHEN tf > {_LIM} AND tb > {_LIM} THEN 5e-1*(df/tf + db/tb) WHEN tf > {_LIM} THEN df/tf WHEN tb > {_LIM} THEN db/tb ELSE 10 END, 6) AS ros,
   CASE WHEN norm = 0 THEN 1 WHEN tf IS NULL OR tb IS NULL THEN NULL WHEN tf <= {_LIM} AND tb <= {_LIM} THEN -1 ELSE 1 END AS quality FROM c""",
    _EXT, GRAD,
    """a AS (SELECT *, sqrt(gx*gx + gy*gy) AS norm, CASE WHEN sqrt(gx*gx + gy*gy) > 0 THEN gx/sqrt(gx*gx + gy*gy) ELSE 0 END AS nx,
     CASE WHEN sqrt(gx*gx + gy*gy) > 0 THEN gy/sqrt(gx*gx + gy*gy) ELSE 0 END AS ny FROM grad)""",
    f"""b AS (SELECT *, i >= i0+2 AND i <= i1-2 AND j >= j0+2 AND j <= j1-2 AS inn, {_sample('', 1)} AS sf, {_sample('', -1)} AS sb,
     {_sample('h', 1)} AS shf, {_sample('h', -1)} AS shb, 1350e0*sqrt(nx*nx + ny*ny) AS dist FROM a)""",
    """c AS (SELECT *, CASE WHEN inn THEN sf - z END AS tf, CASE WHEN inn THEN z - sb END AS tb,
     sqrt(dist*dist + (shf - hn_0_0)*(shf - hn_0_0)) AS df, sqrt(dist*dist + (shb - hn_0_0)*(shb - hn_0_0)) AS db FROM b)""",
)


def first_arrival(spark, sf):
    """First day each lattice cell was covered by its event, and the step before."""
    a = R.first_arrival(S.boxes(spark, sf), "cluster", "day", S.STEP, 3e6 - 900.0, 2e6 - 900.0)
    hours = lambda x, y: (F.unix_seconds(y) - F.unix_seconds(x)) / 3600
    return a.select("cluster", "i", "j", hours(F.col("start"), F.col("day")).alias("arr_h"), hours(F.col("prev"), F.col("day")).alias("diff_h"))


Q["first_arrival"] = first_arrival
SQL["first_arrival"] = S.with_boxes(
    """SELECT cluster, i, j, min(arr_h) AS arr_h, arg_min_null(diff_h, arr_h) AS diff_h FROM
  (SELECT cluster, (epoch_us(day) - epoch_us(min(day) OVER (PARTITION BY cluster)))/3600e6 AS arr_h,
     (epoch_us(day) - epoch_us(lag(day) OVER (PARTITION BY cluster ORDER BY day)))/3600e6 AS diff_h,
     unnest(generate_series(CAST((x0 - 2999100)/1.8e3 AS BIGINT), CAST((x1 - 2999100)/1.8e3 AS BIGINT) - 1)) AS i, y0, y1 FROM boxes) b,
   LATERAL (SELECT unnest(generate_series(CAST((y0 - 1999100)/1.8e3 AS BIGINT), CAST((y1 - 1999100)/1.8e3 AS BIGINT) - 1)) AS j)
  GROUP BY cluster, i, j"""
)


def front_cells(spark, sf):
    return G.front_cells(S.grid(spark, sf), "arrival").select("i", "j", F.col("t").alias("t"), "open")


Q["front_cells"] = front_cells
SQL["front_cells"] = S.with_grid(
    """SELECT i, j, t, CAST(8 - k AS INTEGER) AS open FROM (SELECT g.i, g.j, any_value(g.arrival) AS t, count(n.i) AS k FROM grid g LEFT JOIN grid n
   ON n.i BETWEEN g.i - 1 AND g.i + 1 AND n.j BETWEEN g.j - 1 AND g.j + 1 AND NOT (n.i = g.i AND n.j = g.j) AND n.arrival <= g.arrival
   GROUP BY g.i, g.j) WHERE k < 8"""
)

LINK_LIMIT, LINK_STEP = 4.0, 3600.0


def _links(spark, sf) -> DataFrame:
    g = S.grid(spark, sf)
    return fronts.front_links(G.front_cells(g, "arrival"), g, LINK_LIMIT, LINK_STEP, 1800.0)


def front_pairs(spark, sf):
    return _links(spark, sf).select(
        "ai", "aj", "bi", "bj", F.round("dist", 6).alias("dist"), "cells", F.round("speed", 9).alias("speed")
    )


Q["front_pairs"] = front_pairs
LINKS = """fr AS MATERIALIZED (SELECT i, j, arrival AS t FROM grid g WHERE (SELECT count(*) FROM grid n WHERE n.i BETWEEN g.i - 1 AND g.i + 1 AND n.j BETWEEN g.j - 1 AND g.j + 1
     AND NOT (n.i = g.i AND n.j = g.j) AND n.arrival <= g.arrival) < 8),
 lk AS MATERIALIZED (SELECT a.i AS ai, a.j AS aj, a.t AS at, b.i AS bi, b.j AS bj, b.t AS bt, sqrt((a.i-b.i)*(a.i-b.i) + (a.j-b.j)*(a.j-b.j)) AS dist
    FROM fr a JOIN fr b ON b.i BETWEEN a.i - 4 AND a.i + 4 AND b.j BETWEEN a.j - 4 AND a.j + 4
    WHERE b.t - a.t > 3600 AND (a.i-b.i)*(a.i-b.i) + (a.j-b.j)*(a.j-b.j) BETWEEN 4 AND 16),
 path AS (SELECT lk.*, ai + u AS i, aj + v AS j FROM lk, (SELECT unnest(generate_series(-4, 4)) AS u), (SELECT unnest(generate_series(-4, 4)) AS v)
    WHERE u BETWEEN least(bi-ai, 0) AND greatest(bi-ai, 0) AND v BETWEEN least(bj-aj, 0) AND greatest(bj-aj, 0)
     AND abs((bi-ai)*v - (bj-aj)*u) / dist <= 5e-1),
 clr AS MATERIALIZED (SELECT p.ai, p.aj, any_value(p.at) AS at, p.bi, p.bj, any_value(p.bt) AS bt, any_value(p.dist) AS dist, count(*) AS cells,
     1.8e3 * any_value(p.dist) / (any_value(p.bt) - any_value(p.at)) AS speed
    FROM path p LEFT JOIN grid g ON g.i = p.i AND g.j = p.j WHERE NOT (p.i = p.ai AND p.j = p.aj) AND NOT (p.i = p.bi AND p.j = p.bj)
    GROUP BY p.ai, p.aj, p.bi, p.bj HAVING count(g.i) = 0),
 kept AS MATERIALIZED (SELECT * FROM clr QUALIFY dist < min(dist) OVER (PARTITION BY bi, bj) * 12e-1 OR dist < min(dist) OVER (PARTITION BY ai, aj) * 12e-1),
 links AS MATERIALIZED (SELECT * FROM kept WHERE speed <= (SELECT quantile_disc(speed, 0.99) FROM kept))"""
SQL["front_pairs"] = S.with_grid(
    "SELECT ai, aj, bi, bj, round(dist, 6) AS dist, cells, round(speed, 9) AS speed FROM links", LINKS
)


def front_times(spark, sf):
    """Times of nodata cells between fronts, from the links that cross them."""
    return fronts.times_between(_links(spark, sf)).select("i", "j", F.round("t", 3).alias("t"), "n")


Q["front_times"] = front_times
SQL["front_times"] = S.with_grid(
    """SELECT i, j, round(t, 3) AS t, n FROM m LEFT JOIN (SELECT i, j, stddev_pop(acos(greatest(-1e0, least(1e0, round((ux*mx + uy*my)/(dist*sqrt(mx*mx + my*my)), 9))))) AS spread
     FROM p2 JOIN m USING (i, j) WHERE n > 2 AND mx*mx + my*my > 0 GROUP BY i, j) s USING (i, j) WHERE spread IS NULL OR spread <= 698e-3""",
    LINKS,
    """p2 AS MATERIALIZED (SELECT ai + u AS i, aj + v AS j, "at" + sqrt(u*u + v*v)/dist*(bt - "at") AS t, bi - ai AS ux, bj - aj AS uy, dist
     FROM links, (SELECT unnest(generate_series(-4, 4)) AS u), (SELECT unnest(generate_series(-4, 4)) AS v)
    WHERE u BETWEEN least(bi-ai, 0) AND greatest(bi-ai, 0) AND v BETWEEN least(bj-aj, 0) AND greatest(bj-aj, 0)
     AND abs((bi-ai)*v - (bj-aj)*u) / dist <= 5e-1)""",
    "m AS (SELECT i, j, avg(t) AS t, count(*) AS n, avg(ux) AS mx, avg(uy) AS my FROM p2 GROUP BY i, j)",
)


def gap_fill_blocks(spark, sf):
    """Arrival time of nodata cells from a smooth surface per block."""
    g = S.grid(spark, sf)
    return G.fill_blocks(g, "arrival", 16, G.extent(g)).select("i", "j", F.round("filled", 3).alias("arrival"))


Q["gap_fill_blocks"] = gap_fill_blocks


def nodata_components(spark, sf):
    """Connected groups of nodata cells: first cell and size."""
    g = S.grid(spark, sf).select("i", "j")
    gaps = G.dense_cells(G.extent(g)).join(g, ["i", "j"], "left_anti")
    c = G.cell_components(gaps).groupBy("root").agg(F.min(F.struct("i", "j")).alias("f"), F.count("*").alias("size"))
    return c.select("f.i", "f.j", "size")


Q["nodata_components"] = nodata_components
SQL["nodata_components"] = (
    "WITH RECURSIVE "
    + S.GRID
    + """, ext AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM grid),
 gap AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i, j) AS id, i, j FROM (SELECT unnest(generate_series(i0, i1)) AS i FROM ext),
    (SELECT unnest(generate_series(j0, j1)) AS j FROM ext) WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.i = i.i AND g.j = j.j)),
 e AS MATERIALIZED (SELECT a.id AS s, b.id AS d FROM gap a JOIN gap b ON b.i BETWEEN a.i-1 AND a.i+1 AND b.j BETWEEN a.j-1 AND a.j+1 AND a.id <> b.id),
 cc(id, lbl) USING KEY (id) AS (SELECT id, id FROM gap UNION SELECT e.d, min(cc.lbl) FROM cc JOIN e ON e.s = cc.id
    JOIN recurring.cc AS cur ON cur.id = e.d WHERE cc.lbl < cur.lbl GROUP BY e.d)
 SELECT any_value(f.i) AS i, any_value(f.j) AS j, count(*) AS size FROM cc JOIN gap f ON f.id = cc.lbl GROUP BY cc.lbl"""
).replace(
    """FROM (SELECT unnest(generate_series(i0, i1)) AS i FROM ext),
    (SELECT unnest(generate_series(j0, j1)) AS j FROM ext) WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.i = i.i AND g.j = j.j))""",
    """FROM (SELECT a.i, b.j FROM (SELECT unnest(generate_series(i0, i1)) AS i FROM ext) a,
    (SELECT unnest(generate_series(j0, j1)) AS j FROM ext) b) c WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.i = c.i AND g.j = c.j))""",
)


def static_mask_dilated(spark, sf):
    return R.static_mask(S.hotspots(spark, sf), S.masks(spark, sf), 3600.0, 6).select("cx", "cy")


Q["static_mask_dilated"] = static_mask_dilated
SQL["static_mask_dilated"] = S.with_hs(
    """SELECT DISTINCT cx + a AS cx, cy + b AS cy FROM
  (SELECT CAST(floor(x/3.6e3) AS BIGINT) AS cx, CAST(floor(y/3.6e3) AS BIGINT) AS cy FROM hs GROUP BY 1, 2 HAVING count(*) > 6
   UNION SELECT i, unnest(generate_series(CAST(floor(y0/3.6e3) AS BIGINT), CAST(floor(y1/3.6e3) AS BIGINT))) FROM
    (SELECT *, unnest(generate_series(CAST(floor(x0/3.6e3) AS BIGINT), CAST(floor(x1/3.6e3) AS BIGINT))) AS i FROM masks)) c,
  (VALUES(-1),(0),(1)) t(a), (VALUES(-1),(0),(1)) u(b)""", S.MASKS
)


def regrid_nearest(spark, sf):
    """Source cells read at the nearest place of a 2.5 km grid, clipped to a buffered window."""
    g = S.grid(spark, sf)
    ext = G.extent(g)
    src = g.select(F.col("i").alias("si"), F.col("j").alias("sj"), "value")
    n = lambda c: F.floor(F.col(c) * 1800 / 2500).cast("long")
    box = ext.select(n("i0").alias("i0"), n("i1").alias("i1"), n("j0").alias("j0"), n("j1").alias("j1"))
    to = G.dense_cells(box).select(
        "i", "j", F.floor(F.col("i") * 2500 / 1800 + 0.5).cast("long").alias("si"), F.floor(F.col("j") * 2500 / 1800 + 0.5).cast("long").alias("sj")
    )
    lon, lat = F.lit(-9.0) + F.col("i") * 0.03, F.lit(36.0) + F.col("j") * 0.03
    clip = lon.between(-9.0 - 0.1, -6.0 + 0.1) & lat.between(36.0 - 0.1, 38.0 + 0.1)
    return to.join(src, ["si", "sj"], "left").where(clip).select("i", "j", "value", quarter_tile(lon).alias("tile_lon"), quarter_tile(lat).alias("tile_lat"))


Q["regrid_nearest"] = regrid_nearest
SQL["regrid_nearest"] = S.with_grid(
    """SELECT t.i, t.j, g.value, round_even((-9e0 + t.i*3e-2)*4, 0)/4 AS tile_lon, round_even((36e0 + t.j*3e-2)*4, 0)/4 AS tile_lat FROM
  (SELECT a.i, b.j FROM (SELECT unnest(generate_series(CAST(floor(i0*1800/2500) AS BIGINT), CAST(floor(i1*1800/2500) AS BIGINT))) AS i FROM ext) a,
    (SELECT unnest(generate_series(CAST(floor(j0*1800/2500) AS BIGINT), CAST(floor(j1*1800/2500) AS BIGINT))) AS j FROM ext) b) t
  LEFT JOIN grid g ON g.i = CAST(floor(t.i*2500/1800 + 5e-1) AS BIGINT) AND g.j = CAST(floor(t.j*2500/1800 + 5e-1) AS BIGINT)
  WHERE -9e0 + t.i*3e-2 BETWEEN -9e0 - 1e-1 AND -6e0 + 1e-1 AND 36e0 + t.j*3e-2 BETWEEN 36e0 - 1e-1 AND 38e0 + 1e-1""", _EXT
)


def area_resample(spark, sf):
    r = R.resample_area(S.grid(spark, sf), "value", 1800.0, 5000.0)
    return r.select("i", "j", F.round("value", 5).alias("value"), F.round("coverage", 6).alias("coverage"))


Q["area_resample"] = area_resample
SQL["area_resample"] = S.with_grid(
    """SELECT i, j, round(sum(value*w), 5) AS value, round(sum(w), 6) AS coverage FROM
  (SELECT a.i, b.j, value, (least(si*1.8e3+1.8e3, (a.i+1)*5e3) - greatest(si*1.8e3, a.i*5e3))*(least(sj*1.8e3+1.8e3, (b.j+1)*5e3) - greatest(sj*1.8e3, b.j*5e3))/25e6 AS w
   FROM (SELECT i AS si, j AS sj, value FROM grid) g,
    LATERAL (SELECT unnest(generate_series(si*1800//5000, (si*1800+1799)//5000)) AS i) a, LATERAL (SELECT unnest(generate_series(sj*1800//5000, (sj*1800+1799)//5000)) AS j) b)
  GROUP BY i, j"""
)


def blur_fill(spark, sf):
    """Nearest fill of the nodata cells, then a Gaussian blur."""
    g = S.grid(spark, sf)
    ext = G.extent(g)
    gaps = G.dense_cells(ext).join(g, ["i", "j"], "left_anti")
    full = g.select("i", "j", F.col("value").alias("v")).unionByName(G.nearest_fill(g, "value", gaps))
    return G.gaussian_blur(full, "v", 1.0, ext).select("i", "j", F.round("v", 5).alias("v"))


Q["blur_fill"] = blur_fill
SQL["blur_fill"] = S.with_grid(
    """SELECT h.ti AS i, vv.tj AS j, round(sum(h.v * vv.w), 5) AS v FROM h JOIN
   (SELECT src, t AS tj, sum(w) AS w FROM (SELECT src, p - o AS t, w FROM (SELECT j AS src, unnest([j, 2*j0-1-j, 2*j1+1-j]) AS p, j0, j1 FROM
     (SELECT DISTINCT j, j0, j1 FROM full0, ext)) , k WHERE p - o BETWEEN j0 AND j1) GROUP BY src, t) vv ON vv.src = h.j GROUP BY 1, 2""",
    _EXT,
    """cells AS (SELECT a.i, b.j FROM (SELECT unnest(generate_series(i0, i1)) AS i FROM ext) a, (SELECT unnest(generate_series(j0, j1)) AS j FROM ext) b)""",
    """full0 AS MATERIALIZED (SELECT c.i, c.j, coalesce(g.value, f.v) AS v FROM cells c LEFT JOIN grid g USING (i, j) LEFT JOIN
     (SELECT c.i, c.j, arg_min(n.value, ((c.i-n.i)*(c.i-n.i) + (c.j-n.j)*(c.j-n.j), n.i, n.j)) AS v FROM cells c JOIN grid n ON n.i BETWEEN c.i-12 AND c.i+12 AND n.j BETWEEN c.j-12 AND c.j+12
       GROUP BY c.i, c.j) f ON f.i = c.i AND f.j = c.j)""",
    """k AS MATERIALIZED (SELECT o, exp(-5e-1*o*o) / sum(exp(-5e-1*o*o)) OVER () AS w FROM (SELECT unnest(generate_series(-4, 4)) AS o))""",
    """h AS MATERIALIZED (SELECT p - o AS ti, j, sum(v*w) AS v FROM (SELECT *, unnest([i, 2*i0-1-i, 2*i1+1-i]) AS p FROM full0, ext), k
     WHERE p - o BETWEEN i0 AND i1 GROUP BY 1, 2)""",
)


def value_deltas(spark, sf):
    """Distinct arrival hours and the step to the next one."""
    g = S.grid(spark, sf).select(F.floor(F.col("arrival") / 3600).cast("long").alias("h"))
    return G.consecutive(g, "h", 24).select("v", "next", (F.col("next") - F.col("v")).alias("delta"))


Q["value_deltas"] = value_deltas
SQL["value_deltas"] = S.with_grid(
    """SELECT v, lead(v) OVER (ORDER BY v) AS next, lead(v) OVER (ORDER BY v) - v AS delta
  FROM (SELECT DISTINCT CAST(floor(arrival/3600) AS BIGINT) AS v FROM grid)"""
)


def residence_time(spark, sf):
    """Time above a threshold per pixel column: daily maximum, outliers out, last minus first.

    Bins first: a pixel has one row per day however many readings it holds.
    """
    ev = S.table(spark, sf, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    bins = ev.groupBy(F.col("user_id").alias("pixel"), day.alias("d")).agg(F.max("value").alias("v"))
    w = Window.partitionBy("pixel").orderBy("d")
    every = Window.partitionBy("pixel")
    b = bins.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(every))
    mid = w.rowsBetween(-2, 2)
    head, tail = F.when(F.col("r") <= 5, F.col("v")), F.when(F.col("r") > F.col("n") - 5, F.col("v"))
    for name, fn in (("m", F.avg), ("s", F.stddev_pop)):
        b = b.withColumn(
            name,
            F.when(F.col("r") <= 2, fn(head).over(every)).when(F.col("r") > F.col("n") - 2, fn(tail).over(every)).otherwise(fn("v").over(mid)),
        )
    kept = b.where(~(F.abs(F.col("v") - F.col("m")) > 1.5 * F.col("s")))
    above = kept.where(F.col("v") > 60.0).groupBy("pixel").agg(F.count("*").alias("bins"), (F.max("d") - F.min("d")).cast("long").alias("days"))
    return above.where("bins >= 2")


Q["residence_time"] = residence_time
SQL["residence_time"] = """WITH b AS (SELECT user_id AS pixel, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, max(value) AS v FROM events GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY pixel) AS n, avg(v) OVER mid AS mm, stddev_pop(v) OVER mid AS ms FROM b
   WINDOW w AS (PARTITION BY pixel ORDER BY d), mid AS (PARTITION BY pixel ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
 h AS (SELECT pixel, avg(v) FILTER (r <= 5) AS hm, stddev_pop(v) FILTER (r <= 5) AS hsd, avg(v) FILTER (r > n-5) AS tm, stddev_pop(v) FILTER (r > n-5) AS tsd FROM r GROUP BY pixel)
 SELECT pixel, count(*) AS bins, max(d) - min(d) AS days FROM r JOIN h USING (pixel)
 WHERE NOT (abs(v - CASE WHEN r <= 2 THEN hm WHEN r > n-2 THEN tm ELSE mm END) > 15e-1 * CASE WHEN r <= 2 THEN hsd WHEN r > n-2 THEN tsd ELSE ms END) AND v > 60
 GROUP BY pixel HAVING count(*) >= 2"""


def grid_window(spark, sf):
    """Mean of a daily grid around each burnt area, at the grid time nearest to its date."""
    ev = S.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    daily = ev.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), F.col("user_id").alias("i"), k.alias("j")).agg(F.sum("value").alias("value"))
    grids = daily
    b = nearest_in_time(S.burnt(spark, sf), grids.select("day").distinct(), "firedate", "day", ["day"], "g").withColumn("day", F.col("g.day"))
    cells = R.covered_cells(
        b.select("burnt_id", "day", *[(F.col(c) - o).alias(c) for c, o in (("x0", 3e6 - 900), ("x1", 3e6 - 900), ("y0", 2e6 - 900), ("y1", 2e6 - 900))]), S.STEP
    ).where("part > 0")
    got = cells.join(grids, ["day", "i", "j"], "left").groupBy("burnt_id", "day")
    return got.agg(F.count("*").alias("cells"), F.count("value").alias("known"), F.round(F.avg("value"), 6).alias("mean"))


Q["grid_window"] = grid_window
SQL["grid_window"] = S.with_hs(
    """SELECT burnt_id, n.day, count(*) AS cells, count(d.value) AS known, round(avg(d.value), 6) AS mean FROM
   (SELECT *, unnest(generate_series(CAST(floor((y0-1999100)/1.8e3) AS BIGINT), CAST(ceil((y1-1999100)/1.8e3) AS BIGINT) - 1)) AS j FROM
    (SELECT *, unnest(generate_series(CAST(floor((x0-2999100)/1.8e3) AS BIGINT), CAST(ceil((x1-2999100)/1.8e3) AS BIGINT) - 1)) AS i FROM
     (SELECT b.*, g.day FROM burnt b, (SELECT DISTINCT day FROM daily) g
       QUALIFY row_number() OVER (PARTITION BY burnt_id ORDER BY abs(epoch_us(firedate) - epoch_us(g.day)), g.day) = 1))) n
  LEFT JOIN daily d ON d.day = n.day AND d.i = n.i AND d.j = n.j GROUP BY burnt_id, n.day""",
    S.BURNT,
    """daily AS MATERIALIZED (SELECT date_trunc('day', ts) AS day, CAST((x-3e6)/1.8e3 AS BIGINT) AS i, CAST((y-2e6)/1.8e3 AS BIGINT) AS j, sum(frp) AS value FROM hs GROUP BY ALL)""",
)
