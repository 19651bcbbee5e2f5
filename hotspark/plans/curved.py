"""Rotated and narrowing grids: power, values between nodes, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotspark.operators import curvilinear as C
from hotspark.plans import grids as G, standins as S

Q, SQL = {}, {}

TILE = 36_000.0
#: Cosine and sine of the rotated grid; whole metres stay whole millimetres.
COS, SIN = 0.6, 0.8
#: Added before rounding, so that exact halves of a power in ten-thousandths round alike everywhere.
HAIR = 1e-6


def _turned(x, y):
    return x * COS - y * SIN, x * SIN + y * COS


def _nodes(spark, cell: float, domain: tuple[float, float, float, float]) -> DataFrame:
    west, south, east, north = (round(v / cell) for v in domain)
    # one row a node of the grid's own definition
    i = spark.range(west, east + 1).withColumnRenamed("id", "i")
    return i.withColumn("j", F.explode(F.sequence(F.lit(south).cast("long"), F.lit(north).cast("long"))))


def turned_power(spark, shapes: DataFrame) -> DataFrame:
    """Power of shapes over the grid of the plain rasters, after both were turned by the same angle."""
    turned = F.transform("ring", lambda p: F.struct(*(c.alias(n) for n, c in zip("xy", _turned(p.x, p.y)))))
    x, y = _turned(F.col("i") * G.CELL, F.col("j") * G.CELL)
    nodes = _nodes(spark, G.CELL, G.DOMAIN).select("i", "j", x.alias("x"), y.alias("y"))
    return C.share_power(shapes.withColumn("ring", turned), nodes, ["day"], "shape", TILE, 2 * G.CELL)


def raster_curvilinear(spark, sf):
    """Each day's power on a turned grid: cells, sum, and mean cell. They are those of the grid and shapes before the turn."""
    shapes = G.shapes_of_days(spark, sf)
    out = turned_power(spark, shapes)
    mean = {c: F.round(F.sum(F.col("frp") * F.col(c)) / F.sum("frp"), 3).alias(f"mean_{c}") for c in "ij"}
    return out.groupBy("day").agg(F.count("*").alias("cells"), F.round(F.sum("frp") + HAIR, 3).alias("frp"), *mean.values())


Q["raster_curvilinear"] = raster_curvilinear
SQL["raster_curvilinear"] = S.with_boxes(
    "SELECT day, count(*) AS cells, round(sum(frp) + 1e-6, 3) AS frp, round(sum(frp*i)/sum(frp), 3) AS mean_i, round(sum(frp*j)/sum(frp), 3) AS mean_j FROM cell GROUP BY day",
    G.RASTER, f"cell AS ({G.SHAPES_TO_CELLS})",
)

#: A grid that widens to the north: cell size, origin, axis, and growth a row.
STEP, X0, Y0, AXIS, GROWTH = 7200.0, 2_999_100.0, 1_999_100.0, 3_000_450.0, 0.0123457


def _extent(spark, sf) -> DataFrame:
    n = lambda c, o: F.floor((F.col(c) - o) / STEP)
    return S.hotspots(spark, sf).agg(F.min(n("x", X0)).alias("i0"), F.max(n("x", X0)).alias("i1"), F.min(n("y", Y0)).alias("j0"), F.max(n("y", Y0)).alias("j1"))


def _widening(spark, sf) -> DataFrame:
    """Nodes around all hotspots with the number of hotspots in the square cell of the same number."""
    spread = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b) + 1))
    nodes = _extent(spark, sf).withColumn("i", spread("i0", "i1")).withColumn("j", spread("j0", "j1")).select("i", "j")
    h = S.hotspots(spark, sf)
    counted = h.groupBy(F.floor((F.col("x") - X0) / STEP).alias("i"), F.floor((F.col("y") - Y0) / STEP).alias("j")).agg(F.count("*").cast("double").alias("value"))
    x = AXIS + (X0 + F.col("i") * STEP - AXIS) * (1 + GROWTH * F.col("j"))
    return nodes.join(counted, ["i", "j"], "left").select("i", "j", x.alias("x"), (Y0 + F.col("j") * STEP).alias("y"), F.coalesce("value", F.lit(0.0)).alias("value"))


def interp_curvilinear(spark, sf):
    """A field on the nodes of a widening grid, read at every hotspot between the four nodes around it."""
    points = S.hotspots(spark, sf).select("hs_id", "x", "y")
    return C.interpolate(points, _widening(spark, sf), "value", 2 * STEP).select("hs_id", "i", "j", F.round("value", 6).alias("value"))


_WIDE = """ext AS (SELECT min(CAST(floor((x-2999100)/72e2) AS BIGINT)) AS i0, max(CAST(floor((x-2999100)/72e2) AS BIGINT)) AS i1,
  min(CAST(floor((y-1999100)/72e2) AS BIGINT)) AS j0, max(CAST(floor((y-1999100)/72e2) AS BIGINT)) AS j1 FROM hs),
 field AS (SELECT CAST(floor((x-2999100)/72e2) AS BIGINT) AS i, CAST(floor((y-1999100)/72e2) AS BIGINT) AS j, count(*)::DOUBLE AS value FROM hs GROUP BY ALL)"""

Q["interp_curvilinear"] = interp_curvilinear
# rows run east, so the height tells the row, and the row's width there the place within it
SQL["interp_curvilinear"] = S.with_hs(
    """SELECT hs_id, p.i, p.j, round(coalesce(a.value, 0)*(1-u)*(1-v) + coalesce(b.value, 0)*u*(1-v) + coalesce(c.value, 0)*u*v + coalesce(d.value, 0)*(1-u)*v, 6) AS value
  FROM p LEFT JOIN field a ON a.i = p.i AND a.j = p.j LEFT JOIN field b ON b.i = p.i+1 AND b.j = p.j
   LEFT JOIN field c ON c.i = p.i+1 AND c.j = p.j+1 LEFT JOIN field d ON d.i = p.i AND d.j = p.j+1""", _WIDE,
    """p AS (SELECT hs_id, CAST(floor(s) AS BIGINT) AS i, CAST(floor(t) AS BIGINT) AS j, s - floor(s) AS u, t - floor(t) AS v
   FROM (SELECT hs_id, t, (3000450e0 + (x-3000450e0)/(1 + 0.0123457e0*t) - 2999100e0)/72e2 AS s FROM (SELECT hs_id, x, (y-1999100e0)/72e2 AS t FROM hs)), ext
   WHERE s >= i0 AND s < i1 + 1 AND t >= j0 AND t < j1 + 1)""",
)


def resample_curvilinear(spark, sf):
    """The widening grid's field, one value a cell, carried over to square cells of 10 km by area."""
    n = _widening(spark, sf)
    r = C.resample_area(n, n.where("value > 0"), "value", 10_000.0)
    return r.select("i", "j", F.round("value", 5).alias("value"), F.round("coverage", 6).alias("coverage"))


Q["resample_curvilinear"] = resample_curvilinear
# strips: at every height a cell is as wide as its sides say, so its share of a square is an integral over heights,
# taken piece by piece between the heights at which a side passes a border of the square
SQL["resample_curvilinear"] = S.with_hs(
    """SELECT i, j, round(sum(value*w), 5) AS value, round(sum(w), 6) AS coverage FROM
  (SELECT ci, cj, i, j, value, sum((hi-lo)*(greatest(least(l0 + (l1-l0)*m, e1) - e0, 0) * -1 + greatest(least(r0 + (r1-r0)*m, e1) - e0, 0)))/1e8 AS w FROM
    (SELECT *, ((lo+hi)/2 - y0)/72e2 AS m FROM
     (SELECT *, t AS lo, lead(t) OVER (PARTITION BY ci, cj, i, j ORDER BY t) AS hi FROM
      (SELECT q.* EXCLUDE (b0, b1), least(greatest(unnest([b0, b1, y0 + 72e2*(e0-l0)/nullif(l1-l0, 0), y0 + 72e2*(e1-l0)/nullif(l1-l0, 0),
        y0 + 72e2*(e0-r0)/nullif(r1-r0, 0), y0 + 72e2*(e1-r0)/nullif(r1-r0, 0)]), b0), b1) AS t FROM q))
     WHERE hi > lo)
   GROUP BY ALL) WHERE w > 1e-12 GROUP BY i, j""", _WIDE,
    """quad AS (SELECT f.i AS ci, f.j AS cj, value, 1999100e0 + f.j*72e2 AS y0, 3000450e0 + (2999100e0 + f.i*72e2 - 3000450e0)*(1 + 0.0123457e0*f.j) AS l0,
   3000450e0 + (2999100e0 + f.i*72e2 - 3000450e0)*(1 + 0.0123457e0*(f.j+1)) AS l1, 3000450e0 + (2999100e0 + (f.i+1)*72e2 - 3000450e0)*(1 + 0.0123457e0*f.j) AS r0,
   3000450e0 + (2999100e0 + (f.i+1)*72e2 - 3000450e0)*(1 + 0.0123457e0*(f.j+1)) AS r1 FROM field f)""",
    """q AS (SELECT *, i*1e4 AS e0, (i+1)*1e4 AS e1, greatest(y0, j*1e4) AS b0, least(y0 + 72e2, (j+1)*1e4) AS b1 FROM
   (SELECT *, unnest(generate_series(CAST(floor(y0/1e4) AS BIGINT), CAST(ceil((y0+72e2)/1e4) AS BIGINT) - 1)) AS j FROM
    (SELECT *, unnest(generate_series(CAST(floor(least(l0,l1)/1e4) AS BIGINT), CAST(ceil(greatest(r0,r1)/1e4) AS BIGINT) - 1)) AS i FROM quad)))""",
)
