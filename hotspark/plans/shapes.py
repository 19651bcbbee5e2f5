"""Overlays of polygon layers as shapes, and predicates between polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotspark.functions import geom
from hotspark.operators import overlay as O, predicates as P
from hotspark.operators.nearest import nearest_shapes
from hotspark.operators.tiles import box_pairs
from hotspark.plans import standins as S

Q, SQL = {}, {}

TILE = 36_000.0
#: Cells of the checks: all shapes below have their corners on this lattice.
CELL = 600.0


def _square(x0, y0, x1, y1):
    return geom.box_ring(x0, y0, x1, y1)


def burnt_shapes(spark, sf) -> DataFrame:
    """Burnt areas as rings with a hole in the middle; every third one lacks its upper right part instead."""
    b = S.burnt(spark, sf).select("burnt_id", "x0", "y0", "x1", "y1")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))

    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    notched = F.array(p(x0, y0), p(x1, y0), p(x1, y0 + 1200.0), p(x0 + 1800.0, y0 + 1200.0), p(x0 + 1800.0, y1), p(x0, y1))
    corner = F.col("burnt_id") % 3 == 0
    hole = F.array(_square(x0 + 1200.0, y0 + 1200.0, x1 - 1200.0, y1 - 1200.0))
    return b.select("*", F.when(corner, notched).otherwise(_square(x0, y0, x1, y1)).alias("ring"), F.when(~corner, hole).alias("holes"))


# the cells (cx, cy) of one burnt shape, from its lower left one: 6 x 6 without the hole or the notch
_CELLS = """bcell AS (SELECT burnt_id, CAST((x0 - 2998500)/6e2 AS BIGINT) + i AS cx, CAST((y0 - 1998500)/6e2 AS BIGINT) + j AS cy
  FROM burnt, range(6) t(i), range(6) u(j)
  WHERE CASE WHEN burnt_id % 3 = 0 THEN i < 3 OR j < 2 ELSE NOT (i BETWEEN 2 AND 3 AND j BETWEEN 2 AND 3) END),
 mcell AS (SELECT mask_id, CAST((x0 - 2998500)/6e2 AS BIGINT) + i AS cx, CAST((y0 - 1998500)/6e2 AS BIGINT) + j AS cy
  FROM (SELECT mask_id, x0 - 1.8e3 AS x0, y0 - 1.8e3 AS y0 FROM masks), range(9) t(i), range(9) u(j))"""

# area, rim, corners and rings less holes of a set of cells, from the 2 x 2 windows around every corner
_SHAPE_OF = """win AS (SELECT k, x, y, sum(b) AS q FROM (
   SELECT k, cx + dx AS x, cy + dy AS y, CAST(1 << (2*dx + dy) AS INT) AS b FROM cells, (VALUES(0),(1)) t(dx), (VALUES(0),(1)) u(dy)) GROUP BY ALL),
 meas AS (SELECT k, CAST(sum(CASE WHEN q IN (1,2,4,8,7,11,13,14) THEN 1 WHEN q IN (6,9) THEN 2 ELSE 0 END) AS BIGINT) AS corners,
   CAST(sum(CASE WHEN q IN (1,2,4,8) THEN 1 WHEN q IN (7,11,13,14) THEN -1 WHEN q IN (6,9) THEN 2 ELSE 0 END)/4 AS BIGINT) AS rings_less_holes FROM win GROUP BY k),
 size AS (SELECT k, count(*) * 36e4 AS area FROM cells GROUP BY k),
 rim AS (SELECT k, count(*) * 6e2 AS perimeter FROM (
   SELECT k, o, x, y FROM (SELECT k, 'v' AS o, cx + d AS x, cy AS y FROM cells, (VALUES(0),(1)) t(d)
    UNION ALL SELECT k, 'h', cx, cy + d FROM cells, (VALUES(0),(1)) t(d)) GROUP BY ALL HAVING count(*) = 1) GROUP BY k)"""


def _summed(rings: DataFrame, by: list[str]) -> DataFrame:
    """Measures of the rings of each result."""
    return rings.groupBy(*by).agg(
        F.round(F.sum("area"), 2).alias("area"), F.round(F.sum(geom.length(F.col("ring"))), 2).alias("perimeter"),
        F.sum(F.size("ring").cast("long")).alias("corners"), F.sum(F.signum("area")).cast("long").alias("rings_less_holes"))


def _masks(spark, sf) -> DataFrame:
    m = S.masks(spark, sf).selectExpr("mask_id", "x0 - 1.8e3 as x0", "y0 - 1.8e3 as y0", "x1 + 1.8e3 as x1", "y1 + 1.8e3 as y1")
    return m.withColumn("ring", _square(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))


def overlay_shapes(spark, sf):
    """Burnt areas and grown masks laid over each other: the shapes in both, in one only, and in either."""
    a = O.polygon_edges(burnt_shapes(spark, sf), [], 0, F.col("ring"), F.col("holes"))
    b = O.polygon_edges(_masks(spark, sf), [], 1, F.col("ring"))
    found = O.overlay(a.unionByName(b), [], ["both", "only_a", "only_b", "any", "one"], TILE)
    return _summed(found, ["operation"])


Q["overlay_shapes"] = overlay_shapes
SQL["overlay_shapes"] = S.with_hs(
    """SELECT k AS operation, round(area, 2) AS area, round(perimeter, 2) AS perimeter, corners, rings_less_holes FROM size JOIN meas USING (k) JOIN rim USING (k)""",
    S.BURNT, S.MASKS, _CELLS,
    """part AS (SELECT cx, cy, bool_or(s = 'a') AS a, bool_or(s = 'b') AS b FROM (SELECT 'a' AS s, cx, cy FROM bcell UNION ALL SELECT 'b', cx, cy FROM mcell) GROUP BY ALL),
 cells AS (SELECT 'both' AS k, cx, cy FROM part WHERE a AND b UNION ALL SELECT 'only_a', cx, cy FROM part WHERE a AND NOT b
  UNION ALL SELECT 'only_b', cx, cy FROM part WHERE b AND NOT a UNION ALL SELECT 'any', cx, cy FROM part UNION ALL SELECT 'one', cx, cy FROM part WHERE a <> b)""",
    _SHAPE_OF,
)


def overlap_shapes(spark, sf):
    """For each burnt area and mask that share ground: the shape in both and what the mask leaves of the burnt area."""
    b, m = burnt_shapes(spark, sf), _masks(spark, sf)
    pairs = box_pairs(b, m, 2 * S.STEP)
    keys = ["burnt_id", "mask_id"]
    named = pairs.select("a.burnt_id", "b.mask_id", F.col("a.ring").alias("ra"), F.col("a.holes").alias("ha"), F.col("b.ring").alias("rb"))
    e = O.polygon_edges(named, keys, 0, F.col("ra"), F.col("ha")).unionByName(O.polygon_edges(named, keys, 1, F.col("rb")))
    parts = _summed(O.overlay(e, keys, ["both", "only_a"], TILE), [*keys, "operation"])
    return parts.join(parts.where("operation = 'both'").select(*keys), keys, "left_semi")


Q["overlap_shapes"] = overlap_shapes
SQL["overlap_shapes"] = S.with_hs(
    """SELECT k.burnt_id AS burnt_id, k.mask_id AS mask_id, k.op AS operation, round(area, 2) AS area, round(perimeter, 2) AS perimeter, corners, rings_less_holes
  FROM size JOIN meas USING (k) JOIN rim USING (k)""",
    S.BURNT, S.MASKS, _CELLS,
    """met AS (SELECT DISTINCT burnt_id, mask_id FROM bcell JOIN mcell USING (cx, cy)),
 cells AS (SELECT {burnt_id: burnt_id, mask_id: mask_id, op: 'both'} AS k, cx, cy FROM bcell JOIN mcell USING (cx, cy)
  UNION ALL SELECT {burnt_id: b.burnt_id, mask_id: met.mask_id, op: 'only_a'}, b.cx, b.cy FROM bcell b JOIN met USING (burnt_id)
   ANTI JOIN mcell m ON m.mask_id = met.mask_id AND m.cx = b.cx AND m.cy = b.cy)""",
    _SHAPE_OF,
)


def union_shapes(spark, sf):
    """The burnt areas of each week united: outer rings with their holes."""
    b = burnt_shapes(spark, sf).join(S.burnt(spark, sf).select("burnt_id", F.date_trunc("week", "firedate").cast("date").alias("week")), "burnt_id")
    e = O.polygon_edges(b, ["week"], 0, F.col("ring"), F.col("holes"))
    found = O.with_holes(O.overlay(e, ["week"], ["any"], TILE), ["week"], 2 * S.STEP)
    corners = F.size("ring") + F.aggregate("holes", F.lit(0), lambda s, h: s + F.size(h))
    rim = geom.length(F.col("ring")) + F.aggregate("holes", F.lit(0.0), lambda s, h: s + geom.length(h))
    return found.groupBy("week").agg(
        F.round(F.sum("area"), 2).alias("area"), F.round(F.sum(rim), 2).alias("perimeter"), F.sum(corners.cast("long")).alias("corners"),
        F.sum((1 - F.size("holes")).cast("long")).alias("rings_less_holes"))


Q["union_shapes"] = union_shapes
SQL["union_shapes"] = S.with_hs(
    "SELECT k AS week, round(area, 2) AS area, round(perimeter, 2) AS perimeter, corners, rings_less_holes FROM size JOIN meas USING (k) JOIN rim USING (k)",
    S.BURNT, S.MASKS, _CELLS,
    "cells AS (SELECT DISTINCT CAST(date_trunc('week', firedate) AS DATE) AS k, cx, cy FROM bcell JOIN burnt USING (burnt_id))", _SHAPE_OF,
)


def event_match_polygons(spark, sf):
    """Burnt areas against grown masks by their true shapes: shared area, shares and containment."""
    a = P.edge_index(O.polygon_edges(burnt_shapes(spark, sf), ["burnt_id"], 0, F.col("ring"), F.col("holes")), "burnt_id", TILE)
    b = P.edge_index(O.polygon_edges(_masks(spark, sf), ["mask_id"], 0, F.col("ring")), "mask_id", TILE)
    r = P.relations(a, "burnt_id", b, "mask_id", TILE)
    return r.select("burnt_id", "mask_id", F.round("area", 2).alias("area"), F.round("share_a", 6).alias("share_a"), F.round("share_b", 6).alias("share_b"), "a_within_b", "b_within_a")


Q["event_match_polygons"] = event_match_polygons
SQL["event_match_polygons"] = S.with_hs(
    """SELECT burnt_id, mask_id, n * 36e4 AS area, round(n::DOUBLE / nb, 6) AS share_a, round(n::DOUBLE / 81, 6) AS share_b, n = nb AS a_within_b, n = 81 AS b_within_a
  FROM (SELECT burnt_id, mask_id, count(*) AS n FROM bcell JOIN mcell USING (cx, cy) GROUP BY ALL)
  JOIN (SELECT burnt_id, count(*) AS nb FROM bcell GROUP BY ALL) USING (burnt_id)""", S.BURNT, S.MASKS, _CELLS,
)


def commune_shapes(spark, sf) -> DataFrame:
    """Communes as stripes whose northern half starts a quarter of the way east, with a hole further on."""
    c = S.communes(spark, sf)
    x0, y0, x1, y1 = (F.col(n) for n in ("x0", "y0", "x1", "y1"))
    w = F.floor((x1 - x0) / 7200.0) * 1800.0

    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0 + w, y1), p(x0 + w, y0 + 3600.0), p(x0, y0 + 3600.0))
    hole = F.array(_square(x0 + 2 * w, y0 + 1800.0, x0 + 2 * w + 3600.0, y0 + 5400.0))
    return c.select("commune_id", "name", ring.alias("ring"), hole.alias("holes"))


def commune_join_polygons(spark, sf):
    """The communes, as polygons with holes, around every hotspot."""
    index = P.edge_index(O.polygon_edges(commune_shapes(spark, sf), ["commune_id"], 0, F.col("ring"), F.col("holes")), "commune_id", TILE)
    return P.points_in_polygons(S.hotspots(spark, sf).select("hs_id", "x", "y"), index, TILE).select("hs_id", "commune_id")


Q["commune_join_polygons"] = commune_join_polygons
SQL["commune_join_polygons"] = S.with_hs(
    """SELECT hs_id, commune_id FROM (SELECT hs_id, x, y, commune_id, y0, y1, a, a + w AS b, a + 2*w AS c FROM hs JOIN communes ON y > y0 AND y < y1,
    (SELECT min(x) - 9e2 AS a, floor((max(x) - min(x) + 1.8e3)/7.2e3)*1.8e3 AS w FROM hs))
  WHERE (x > b OR y < y0 + 3.6e3) AND NOT (x > c AND x < c + 3.6e3 AND y > y0 + 1.8e3 AND y < y0 + 5.4e3)""", S.COMMUNES,
)


DIAMOND = 700.0


def nearest_shape(spark, sf):
    """For each mask, as a diamond, the nearest burnt shape within 10 km by the distance of the shapes themselves."""
    m = S.masks(spark, sf).select("mask_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    around = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    ring = F.array(*[F.struct((F.col("cx") + i * DIAMOND).alias("x"), (F.col("cy") + j * DIAMOND).alias("y")) for i, j in around])
    a = O.polygon_edges(m, ["mask_id"], 0, ring)
    b = O.polygon_edges(burnt_shapes(spark, sf), ["burnt_id"], 0, F.col("ring"), F.col("holes"))
    return nearest_shapes(a, "mask_id", b, "burnt_id", 1800.0, 10_000.0, TILE).drop("met")


Q["nearest_shape"] = nearest_shape


def _gap(p: str, k: int, s: str) -> str:
    """Distance of the end k of a side p from a side s, in SQL."""
    x, y, dx, dy = f"{p}.x{k}", f"{p}.y{k}", f"({s}.x1-{s}.x0)", f"({s}.y1-{s}.y0)"
    t = f"greatest(0e0, least(1e0, (({x}-{s}.x0)*{dx} + ({y}-{s}.y0)*{dy}) / ({dx}*{dx}+{dy}*{dy})))"
    return f"sqrt(({x}-{s}.x0-{t}*{dx})**2 + ({y}-{s}.y0-{t}*{dy})**2)"


def _turn(s: str, p: str, k: int) -> str:
    return f"(({s}.x1-{s}.x0)*({p}.y{k}-{s}.y0) - ({s}.y1-{s}.y0)*({p}.x{k}-{s}.x0))"


SQL["nearest_shape"] = S.with_hs(
    f"""SELECT mask_id, burnt_id, dist FROM (SELECT mask_id, burnt_id, round(min(d), 3) AS dist FROM
   (SELECT l.mask_id, r.burnt_id, CASE WHEN {_turn('l', 'r', 0)}*{_turn('l', 'r', 1)} < 0 AND {_turn('r', 'l', 0)}*{_turn('r', 'l', 1)} < 0 THEN 0e0
     ELSE least({_gap('l', 0, 'r')}, {_gap('l', 1, 'r')}, {_gap('r', 0, 'l')}, {_gap('r', 1, 'l')}) END AS d
    FROM mside l JOIN bside r ON abs(l.cx - r.cx) <= 12500 AND abs(l.cy - r.cy) <= 12500
    UNION ALL
    -- the right corner of a diamond inside a burnt shape, or the lower left corner of a burnt shape inside a diamond
    SELECT mask_id, burnt_id, 0e0 FROM dia m JOIN burnt b ON m.cx + 7e2 > b.x0 AND m.cx + 7e2 < b.x1 AND m.cy > b.y0 AND m.cy < b.y1
     AND CASE WHEN burnt_id % 3 = 0 THEN m.cx + 7e2 < b.x0 + 18e2 OR m.cy < b.y0 + 12e2
       ELSE NOT (m.cx + 7e2 > b.x0 + 12e2 AND m.cx + 7e2 < b.x1 - 12e2 AND m.cy > b.y0 + 12e2 AND m.cy < b.y1 - 12e2) END
    UNION ALL
    SELECT mask_id, burnt_id, 0e0 FROM dia m JOIN burnt b ON abs(b.x0 - m.cx) + abs(b.y0 - m.cy) < 7e2)
   GROUP BY ALL) WHERE dist <= 1e4 QUALIFY row_number() OVER (PARTITION BY mask_id ORDER BY dist, burnt_id) = 1""",
    S.BURNT, S.MASKS,
    "dia AS (SELECT mask_id, (x0 + x1)/2 AS cx, (y0 + y1)/2 AS cy FROM masks)",
    """mside AS (SELECT mask_id, cx, cy, cx + 7e2*i AS x0, cy + 7e2*j AS y0, cx - 7e2*j AS x1, cy + 7e2*i AS y1 FROM dia, (VALUES(1,0),(0,1),(-1,0),(0,-1)) t(i, j))""",
    """bside AS (SELECT burnt_id, (x0 + x1)/2 AS cx, (y0 + y1)/2 AS cy, x0 + 6e2*a AS x0, y0 + 6e2*b AS y0, x0 + 6e2*c AS x1, y0 + 6e2*d AS y1
   FROM burnt JOIN (VALUES (0,0,0,6,0),(0,6,0,6,2),(0,6,2,3,2),(0,3,2,3,6),(0,3,6,0,6),(0,0,6,0,0),
     (1,0,0,6,0),(1,6,0,6,6),(1,6,6,0,6),(1,0,6,0,0),(1,2,2,4,2),(1,4,2,4,4),(1,4,4,2,4),(1,2,4,2,2)) t(k, a, b, c, d)
   ON t.k = CASE WHEN burnt_id % 3 = 0 THEN 0 ELSE 1 END)""",
)
