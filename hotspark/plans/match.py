"""Matches between shapes, and time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotspark.functions import geom
from hotspark.operators import matching
from hotspark.operators.asof import asof, nearest_in_time
from hotspark.operators.nearest import buffer_classes, nearest_box
from hotspark.operators.tiles import box_pairs
from hotspark.plans import standins as S

Q, SQL = {}, {}

BASE = 2 * S.STEP


def scored(spark, sf, **kw) -> DataFrame:
    return matching.candidates(
        S.boxes(spark, sf).select("box_id", "day", "x0", "y0", "x1", "y1"), S.burnt(spark, sf), "box_id", "burnt_id", "day", "firedate",
        BASE, max_days=2.0, max_km=10.0, min_iou=0.01, **kw,
    )


CAND = """cand0 AS MATERIALIZED (SELECT a.box_id AS a_id, b.burnt_id AS b_id,
   greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0), 0e0) * greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0), 0e0) AS inter,
   (a.x1-a.x0)*(a.y1-a.y0) AS area_a, (b.x1-b.x0)*(b.y1-b.y0) AS area_b,
   sqrt(((a.x0+a.x1-b.x0-b.x1)/2)*((a.x0+a.x1-b.x0-b.x1)/2) + ((a.y0+a.y1-b.y0-b.y1)/2)*((a.y0+a.y1-b.y0-b.y1)/2)) AS dist_m,
   abs(epoch_us(a.day) - epoch_us(b.firedate)) / 86400e6 AS dt_days
  FROM boxes a JOIN burnt b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
   AND abs(epoch_us(a.day) - epoch_us(b.firedate)) <= 172800000000),
 cand AS MATERIALIZED (SELECT *, inter / (area_a + area_b - inter) AS iou,
   4e-1 * (inter / (area_a + area_b - inter)) + 3e-1 * 0e0 + 3e-1 * (1e0 - least(dt_days, 2e0) / 2e0) AS score
  FROM cand0 WHERE dist_m <= 1e4 AND inter / (area_a + area_b - inter) >= 1e-2),
 best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, iou DESC, dist_m, b_id) = 1)"""


def burnt_match(spark, sf):
    m = matching.best_per_a(scored(spark, sf))
    return m.select("a_id", "b_id", F.round("score", 6).alias("score"), F.round("iou", 6).alias("iou"), F.round("dist_m", 3).alias("dist_m"), "dt_days")


Q["burnt_match"] = burnt_match
SQL["burnt_match"] = S.with_boxes(
    "SELECT a_id, b_id, round(score, 6) AS score, round(iou, 6) AS iou, round(dist_m, 3) AS dist_m, dt_days FROM best", S.BURNT, CAND
)


def burnt_unmatched(spark, sf):
    """Shapes of either side that found no partner."""
    m = matching.best_per_a(scored(spark, sf)).select("a_id", "b_id")
    a = S.boxes(spark, sf).select(F.lit("event").alias("side"), F.col("box_id").alias("id"))
    b = S.burnt(spark, sf).select(F.lit("burnt").alias("side"), F.col("burnt_id").alias("id"))
    lone_a = a.join(m.select(F.col("a_id").alias("id")), "id", "left_anti")
    lone_b = b.join(m.select(F.col("b_id").alias("id")).distinct(), "id", "left_anti")
    return lone_a.unionByName(lone_b).select("side", "id")


Q["burnt_unmatched"] = burnt_unmatched
SQL["burnt_unmatched"] = S.with_boxes(
    """SELECT 'event' AS side, box_id AS id FROM boxes WHERE box_id NOT IN (SELECT a_id FROM best)
  UNION ALL SELECT 'burnt', burnt_id FROM burnt WHERE burnt_id NOT IN (SELECT b_id FROM best)""", S.BURNT, CAND
)


def area_fit(spark, sf):
    """Fit of the overlap area on the event area over the matched pairs."""
    m = matching.best_per_a(scored(spark, sf)).select((F.col("area_a") / 1e4).alias("x"), (F.col("inter") / 1e4).alias("y"))
    fit = matching.linear_fit(m, "x", "y")
    return fit.select("n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "slope_err", "intercept_err", "corr")])


Q["area_fit"] = area_fit
SQL["area_fit"] = S.with_boxes(
    """SELECT n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(sqrt(s2/sxx), 6) AS slope_err,
   round(sqrt(s2*(1e0/n + mx*mx/sxx)), 6) AS intercept_err, round(corr, 6) AS corr FROM
  (SELECT *, (syy - slope*sxy)/(n-2) AS s2 FROM (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
    regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx, corr(y, x) AS corr
    FROM (SELECT area_a/1e4 AS x, inter/1e4 AS y FROM best)))""", S.BURNT, CAND
)


def match_ranked(spark, sf):
    """For each burnt area the winner by size and the winner by distance (ties: lowest id)."""
    c = scored(spark, sf)
    big = F.min_by("a_id", F.struct((-F.col("area_a")).alias("s"), F.col("a_id").alias("i")))
    close = F.min_by("a_id", F.struct(F.col("dist_m").alias("s"), F.col("a_id").alias("i")))
    return c.groupBy("b_id").agg(F.count("*").alias("n"), big.alias("largest"), close.alias("nearest"))


Q["match_ranked"] = match_ranked
SQL["match_ranked"] = S.with_boxes(
    """SELECT b_id, count(*) AS n, first(a_id ORDER BY area_a DESC, a_id) AS largest, first(a_id ORDER BY dist_m, a_id) AS nearest
  FROM cand GROUP BY b_id""", S.BURNT, CAND
)


def polygon_overlap(spark, sf):
    """Exact polygon overlap of events and burnt areas (slab kernel on Arrow batches)."""
    a = matching.with_rings(S.boxes(spark, sf).select("box_id", "x0", "y0", "x1", "y1"))
    b = matching.with_rings(S.burnt(spark, sf))
    # Python work per pair: keep the pairs spread over all cores
    pairs = box_pairs(a, b, BASE).repartition(2 * spark.sparkContext.defaultParallelism)
    met = pairs.withColumn("inter", geom.overlap_area(F.array("a.ring"), F.array("b.ring"))).where("inter > 0")
    union = geom.area(F.col("a.ring")) + geom.area(F.col("b.ring")) - F.col("inter")
    return met.select(
        F.col("a.box_id").alias("a_id"), F.col("b.burnt_id").alias("b_id"), F.round("inter", 2).alias("inter"),
        F.round(union, 2).alias("union_area"), F.round(F.col("inter") / union, 6).alias("iou"),
    )


Q["polygon_overlap"] = polygon_overlap
SQL["polygon_overlap"] = S.with_boxes(
    """SELECT a_id, b_id, round(i, 2) AS inter, round(u - i, 2) AS union_area, round(i/(u - i), 6) AS iou FROM
  (SELECT a.box_id AS a_id, b.burnt_id AS b_id, (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS i,
    (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) AS u
   FROM boxes a JOIN burnt b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)""", S.BURNT
)


def polygon_measures(spark, sf):
    """Ring measures and predicates of every box against its probe point."""
    b = S.boxes(spark, sf)
    ring = geom.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    px, py = F.col("x0") + 1000.0 * F.col("n_hs"), F.col("y0") - 500.0 + 400.0 * F.col("n_hs")
    moved = geom.box_ring(F.col("x0") + 30.0, F.col("y0") + 40.0, F.col("x1") + 30.0, F.col("y1") + 40.0)
    b = b.withColumn("ring", ring).withColumn("moved", moved).withColumn("px", px).withColumn("py", py)
    r, cen, box = F.col("ring"), geom.centroid(F.col("ring")), geom.bbox(F.col("ring"))
    dense = geom.densify(r, 5)
    parts = F.array(F.struct(F.lit("Polygon").alias("kind"), r.alias("ring")), F.struct(F.lit("Point").alias("kind"), r.alias("ring")))
    return b.select(
        "box_id", geom.area(r).alias("area"), geom.length(r).alias("length"), cen.x.alias("cx"), cen.y.alias("cy"),
        (box.x1 - box.x0).alias("width"), geom.contains(r, F.col("px"), F.col("py")).alias("holds"),
        F.round(geom.distance(r, F.col("px"), F.col("py")), 6).alias("dist"),
        geom.within_buffer(r, F.col("px"), F.col("py"), 600.0).alias("near"),
        F.round(geom.mean_min_distance(r, F.col("moved")), 6).alias("shift"), F.size(dense).cast("long").alias("dense_n"),
        F.size(geom.stride(dense, 7)).cast("long").alias("thin_n"), F.size(geom.polygonal_parts(parts)).cast("long").alias("polygons"),
    )


Q["polygon_measures"] = polygon_measures
SQL["polygon_measures"] = S.with_boxes(
    """SELECT box_id, (x1-x0)*(y1-y0) AS area, 2*((x1-x0)+(y1-y0)) AS length, (x0+x1)/2 AS cx, (y0+y1)/2 AS cy, x1-x0 AS width,
   px >= x0 AND px < x1 AND py >= y0 AND py < y1 AS holds,
   round(CASE WHEN px >= x0 AND px < x1 AND py >= y0 AND py < y1 THEN 0 ELSE sqrt(gx*gx + gy*gy) END, 6) AS dist,
   CASE WHEN px >= x0 AND px < x1 AND py >= y0 AND py < y1 THEN 0 ELSE sqrt(gx*gx + gy*gy) END <= 6e2 AS near,
   5e1 AS shift, CAST(20 AS BIGINT) AS dense_n, CAST(7 AS BIGINT) AS thin_n, CAST(1 AS BIGINT) AS polygons
  FROM (SELECT *, greatest(x0 - px, px - x1, 0e0) AS gx, greatest(y0 - py, py - y1, 0e0) AS gy FROM
   (SELECT *, x0 + 1e3*n_hs AS px, y0 - 5e2 + 4e2*n_hs AS py FROM boxes))"""
)


def overlay_boxes(spark, sf):
    """Intersection shapes of burnt areas with the static masks grown by 2 km."""
    wide = S.masks(spark, sf).selectExpr("mask_id", "x0 - 2e3 as x0", "y0 - 2e3 as y0", "x1 + 2e3 as x1", "y1 + 2e3 as y1")
    p = box_pairs(S.burnt(spark, sf), wide, BASE)
    out = p.select(
        F.col("a.burnt_id").alias("burnt_id"), F.col("b.mask_id").alias("mask_id"), F.greatest("a.x0", "b.x0").alias("x0"),
        F.greatest("a.y0", "b.y0").alias("y0"), F.least("a.x1", "b.x1").alias("x1"), F.least("a.y1", "b.y1").alias("y1"),
    )
    return out.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).where("area > 0")


Q["overlay_boxes"] = overlay_boxes
SQL["overlay_boxes"] = S.with_hs(
    """SELECT *, (x1-x0)*(y1-y0) AS area FROM (SELECT burnt_id, mask_id, greatest(a.x0, b.x0-2e3) AS x0, greatest(a.y0, b.y0-2e3) AS y0,
   least(a.x1, b.x1+2e3) AS x1, least(a.y1, b.y1+2e3) AS y1 FROM burnt a, masks b) WHERE x1 > x0 AND y1 > y0""", S.MASKS, S.BURNT
)


def nearest_polygon(spark, sf):
    """For each mask the nearest burnt area within 10 km and its distance."""
    n = nearest_box(S.masks(spark, sf), "mask_id", S.burnt(spark, sf), "burnt_id", 10_000.0)
    return n.select("mask_id", "burnt_id", F.round("dist", 3).alias("dist"))


Q["nearest_polygon"] = nearest_polygon
_DIST = "sqrt(greatest(b.x0-a.x1, a.x0-b.x1, 0e0)**2 + greatest(b.y0-a.y1, a.y0-b.y1, 0e0)**2)"
SQL["nearest_polygon"] = S.with_hs(
    f"""SELECT mask_id, burnt_id, round(dist, 3) AS dist FROM (SELECT mask_id, burnt_id, {_DIST} AS dist FROM masks a, burnt b)
  WHERE dist <= 1e4 QUALIFY row_number() OVER (PARTITION BY mask_id ORDER BY dist, burnt_id) = 1""", S.MASKS, S.BURNT
)


def buffer_class_join(spark, sf):
    """Fuel shapes within the distance of their class around industry shapes."""
    fuel = S.burnt(spark, sf).withColumn("category", (F.col("burnt_id") / 10 % 5).cast("int")).withColumn(
        "frag", F.element_at(F.array(F.lit(0.95), F.lit(0.5), F.lit(0.0)), (F.col("burnt_id") / 10 % 3 + 1).cast("int"))
    )
    return buffer_classes(fuel, "burnt_id", S.masks(spark, sf), "mask_id")


Q["buffer_class_join"] = buffer_class_join
SQL["buffer_class_join"] = S.with_hs(
    f"""SELECT burnt_id, mask_id, reach FROM (SELECT *, (ARRAY[2400, 1200, 800, 600, 480, 400, 343])[category + frag_class + 1]::DOUBLE AS reach
    FROM (SELECT *, CAST(floor(burnt_id/10) % 5 AS INT) AS category, CAST(floor(burnt_id/10) % 3 AS INT) AS frag_class FROM burnt)) b, masks a
   WHERE {_DIST} <= reach""", S.MASKS, S.BURNT
)


def area_filters(spark, sf):
    """Large shapes (5 km2 and more), the year test and the one-hectare test."""
    b = S.boxes(spark, sf).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    big = b.where((F.col("area") >= 5e6) & (F.year("day") == 2024))
    return big.select("box_id", (F.col("area") / 1e4).alias("area_ha"), (F.col("area") / 1e4 > 1).alias("over_1ha"))


Q["area_filters"] = area_filters
SQL["area_filters"] = S.with_boxes(
    """SELECT box_id, (x1-x0)*(y1-y0)/1e4 AS area_ha, (x1-x0)*(y1-y0)/1e4 > 1 AS over_1ha FROM boxes
  WHERE (x1-x0)*(y1-y0) >= 5e6 AND year(day) = 2024"""
)


def _sides(spark, sf):
    h = S.hotspots(spark, sf)
    left = h.where("sat <> 'purchase'").select("hs_id", "ts")
    right = h.where("sat = 'purchase'").select(F.col("hs_id").alias("ref_id"), F.col("ts").alias("ref_ts"))
    return left, right


_LR = "l AS (SELECT hs_id, ts FROM hs WHERE sat <> 'purchase'), r AS (SELECT hs_id AS ref_id, ts AS ref_ts FROM hs WHERE sat = 'purchase')"


def asof_backward(spark, sf):
    left, right = _sides(spark, sf)
    j = asof(left, right, "ts", "ref_ts", ["ref_id"], "m")
    return j.select("hs_id", F.col("m.row.ref_id").alias("ref_id"), F.timestamp_micros("m.at").alias("ref_ts"))


Q["asof_backward"] = asof_backward
SQL["asof_backward"] = S.with_hs("SELECT hs_id, ref_id, ref_ts FROM l ASOF LEFT JOIN r ON l.ts >= r.ref_ts", _LR)


def asof_strict(spark, sf):
    """Newest time strictly before, against a right side that shares the left times."""
    h = S.hotspots(spark, sf).select("hs_id", "ts")
    j = asof(h, h.select(F.col("hs_id").alias("ref_id"), F.col("ts").alias("ref_ts")), "ts", "ref_ts", ["ref_id"], "m", strict=True)
    return j.select("hs_id", F.col("m.row.ref_id").alias("ref_id"))


Q["asof_strict"] = asof_strict
SQL["asof_strict"] = S.with_hs(
    "SELECT l.hs_id, r.hs_id AS ref_id FROM hs l ASOF LEFT JOIN hs r ON l.ts > r.ts"
)


def nearest_time(spark, sf):
    left, right = _sides(spark, sf)
    j = nearest_in_time(left, right, "ts", "ref_ts", ["ref_id"], "m")
    return j.select("hs_id", F.col("m.ref_id").alias("ref_id"))


Q["nearest_time"] = nearest_time
SQL["nearest_time"] = S.with_hs(
    """SELECT p.hs_id, CASE WHEN n.nid IS NULL OR epoch_us(p.ts) - epoch_us(p.pt) <= epoch_us(n.nt) - epoch_us(p.ts) THEN p.pid ELSE n.nid END AS ref_id
  FROM (SELECT hs_id, ts, ref_id AS pid, ref_ts AS pt FROM l ASOF LEFT JOIN r ON l.ts >= r.ref_ts) p
  JOIN (SELECT hs_id, ref_id AS nid, ref_ts AS nt FROM l ASOF LEFT JOIN r ON l.ts <= r.ref_ts) n USING (hs_id)""", _LR
)
