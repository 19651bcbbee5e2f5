"""Reference layers: names, levels, tags, coverage, dissolving, fragmentation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from hotspark.functions.names import clean_name, has_tag
from hotspark.functions.scalars import hex_colour
from hotspark.operators import landuse as L, outline
from hotspark.operators.cluster import cluster_points
from hotspark.operators.footprint import box_cells, union_cells
from hotspark.plans import standins as S

Q, SQL = {}, {}


def name_dedup(spark, sf):
    """Customers named after their nation get a running suffix; single names stay."""
    c = S.table(spark, sf, "customer").join(
        S.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    named = c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.col("n_name")).alias("name"))
    return L.dedupe_names(named, "name", ["c_custkey"])


Q["name_dedup"] = name_dedup
SQL["name_dedup"] = """SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY name) > 1
   THEN name || '_' || (row_number() OVER (PARTITION BY name ORDER BY c_custkey) - 1) ELSE name END AS name
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def name_clean(spark, sf):
    c = S.table(spark, sf, "customer")
    en = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Saint "), F.col("c_mktsegment")))
    local = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("Évora São "), F.col("c_name"), F.lit(" ñandú Ürgüp")))
    return c.select("c_custkey", clean_name(en, local).alias("name"))


Q["name_clean"] = name_clean
SQL["name_clean"] = """SELECT c_custkey, replace(strip_accents(coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'Saint ' || c_mktsegment END,
  CASE WHEN c_custkey % 5 <> 0 THEN 'Évora São ' || c_name || ' ñandú Ürgüp' END, 'unknown')), ' ', '') AS name FROM customer"""


def _rows_with_level(spark, sf) -> DataFrame:
    c = S.table(spark, sf, "customer")
    level = F.element_at(F.array(*[F.lit(v) for v in ("8", "9", "10", "x", "4", None, "8.5")]), (F.col("c_custkey") % 7 + 1).cast("int"))
    label = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("fire_"), F.element_at(F.array(F.lit("FR"), F.lit("ES")), (F.col("c_custkey") % 2 + 1).cast("int")), F.lit("_"), F.col("c_name")))
    return c.select("c_custkey", level.alias("raw"), label.alias("label"))


def level_select(spark, sf):
    """Numeric admin levels 8 and 9, and the label test."""
    r = _rows_with_level(spark, sf).withColumn("admin_level", F.col("raw").try_cast("double").cast("int"))
    return r.where(F.col("admin_level").isin(8, 9)).select("c_custkey", "admin_level", has_tag(F.col("label")).alias("in_fr"))


Q["level_select"] = level_select
SQL["level_select"] = """SELECT c_custkey, CAST(floor(TRY_CAST(raw AS DOUBLE)) AS INTEGER) AS admin_level, coalesce(contains(label, '_FR_'), false) AS in_fr FROM
 (SELECT c_custkey, (['8','9','10','x','4',NULL,'8.5'])[c_custkey % 7 + 1] AS raw,
   CASE WHEN c_custkey % 4 <> 0 THEN 'fire_' || (['FR','ES'])[c_custkey % 2 + 1] || '_' || c_name END AS label FROM customer)
 WHERE floor(TRY_CAST(raw AS DOUBLE)) IN (8, 9)"""


def country_select(spark, sf):
    """Nations picked by each region's code list; region 1 also asks for a second code."""
    n = S.table(spark, sf, "nation")
    borders = n.select("n_nationkey", F.col("n_name").alias("sov"), F.concat(F.lit("ADM_"), F.col("n_nationkey") % 2).alias("adm"), "n_regionkey")
    sel = n.where(F.col("n_nationkey") % 5 != 4).groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("codes"))
    sel = sel.where(F.col("n_regionkey") < 3).withColumn("code2", F.when(F.col("n_regionkey") == 1, "ADM_1"))
    return L.select_codes(borders, sel).select("n_nationkey", "sov", "adm")


Q["country_select"] = country_select
SQL["country_select"] = """SELECT n_nationkey, n_name AS sov, 'ADM_' || n_nationkey % 2 AS adm FROM nation
 WHERE n_nationkey % 5 <> 4 AND n_regionkey < 3 AND (n_regionkey <> 1 OR n_nationkey % 2 = 1)"""


def _tagged(spark, sf) -> DataFrame:
    p = S.table(spark, sf, "part")

    def one_of(values, key):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))

    tags = F.map_filter(
        F.create_map(
            F.lit("landuse"), one_of(["forest", "industrial", "quarry", "farmland", None], F.col("p_size")),
            F.lit("natural"), one_of(["wood", "scrub", "heath", "wetlands", None, "grassland", "water"], F.col("p_partkey")),
            F.lit("leaf_type"), one_of(["needleleaved", "mixed", "brodleaved", None], F.floor(F.col("p_partkey") / 7)),
        ),
        lambda k, v: v.isNotNull(),
    )
    kind = one_of(["Polygon", "MultiPolygon", "LineString", "Point"], F.floor(F.col("p_partkey") / 3))
    return p.select("p_partkey", tags.alias("tags"), kind.alias("kind"))


def tag_rules(spark, sf):
    """Industry test and fuel categories of tagged shapes; one row per category met."""
    t = _tagged(spark, sf)
    out = t.select(
        "p_partkey", L.is_industry(F.col("tags"), F.col("kind")).alias("industry"),
        F.explode_outer(F.when(F.col("kind").isin(L.POLYGONAL), L.fuel_categories(F.col("tags")))).alias("category"),
    )
    return out


Q["tag_rules"] = tag_rules
SQL["tag_rules"] = """WITH t AS (SELECT p_partkey, (['forest','industrial','quarry','farmland',NULL])[p_size % 5 + 1] AS landuse,
   (['wood','scrub','heath','wetlands',NULL,'grassland','water'])[p_partkey % 7 + 1] AS nat,
   (['needleleaved','mixed','brodleaved',NULL])[(p_partkey // 7) % 4 + 1] AS leaf,
   (['Polygon','MultiPolygon','LineString','Point'])[(p_partkey // 3) % 4 + 1] AS kind FROM part),
 c AS (SELECT *, kind IN ('Polygon','MultiPolygon') AS poly, coalesce(landuse = 'forest', false) OR coalesce(nat = 'wood', false) AS wood FROM t),
 k AS (SELECT p_partkey, unnest(list_filter([CASE WHEN wood AND leaf = 'needleleaved' THEN 1 END, CASE WHEN wood AND leaf = 'mixed' THEN 2 END,
   CASE WHEN (wood AND leaf = 'brodleaved') OR nat IN ('scrub','meadow','grassland') THEN 3 END, CASE WHEN nat = 'heath' THEN 4 END,
   CASE WHEN nat = 'wetlands' THEN 5 END], lambda v: v IS NOT NULL)) AS category FROM c WHERE poly)
 SELECT c.p_partkey, poly AND coalesce(landuse IN ('industrial','landfill','quarry','military'), false) AS industry, category
 FROM c LEFT JOIN k ON k.p_partkey = c.p_partkey"""


def _coded(spark, sf) -> DataFrame:
    codes = sorted(v for vs in L.FUEL_CODES.values() for v in vs) + [40, 50, 60, 80, 200]
    g = S.grid(spark, sf)
    pick = F.element_at(F.array(*[F.lit(v) for v in codes]), ((F.col("i") * 7 + F.col("j") * 3) % len(codes) + 1).cast("int"))
    return g.select("i", "j", pick.alias("code"))


_CODES = str(sorted(v for vs in L.FUEL_CODES.values() for v in vs) + [40, 50, 60, 80, 200])


def class_codes(spark, sf):
    """Fuel category of each land-cover cell; other classes are dropped."""
    return _coded(spark, sf).withColumn("category", L.fuel_of_code(F.col("code"))).where("category is not null")


Q["class_codes"] = class_codes
SQL["class_codes"] = S.with_grid(
    f"""SELECT i, j, code, category FROM (SELECT i, j, code, CASE WHEN code IN (111,113,121,123) THEN 1 WHEN code IN (115,116,125,126) THEN 2
   WHEN code IN (112,114,122,124,20,30) THEN 3 WHEN code = 90 THEN 4 WHEN code = 100 THEN 5 END AS category
   FROM (SELECT i, j, CAST(({_CODES})[(i*7 + j*3) % 21 + 1] AS INTEGER) AS code FROM grid)) WHERE category IS NOT NULL"""
)


def legend_join(spark, sf):
    """Legend rows of the classes that occur, by code, with cell counts and hex colours."""
    legend = S.table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("code"), F.col("p_name").alias("label"), (F.col("p_partkey") * 3 % 256).alias("r"),
        (F.col("p_partkey") * 7 % 256).alias("g"), (F.col("p_partkey") * 11 % 256).alias("b"),
    )
    used = _coded(spark, sf).groupBy("code").agg(F.count("*").alias("cells"))
    return legend.join(used, "code").select("code", "label", hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("color"), "cells").orderBy("code")


Q["legend_join"] = legend_join
SQL["legend_join"] = S.with_grid(
    f"""SELECT code, label, color, count(*) AS cells FROM (SELECT CAST(({_CODES})[(i*7 + j*3) % 21 + 1] AS INTEGER) AS code FROM grid) u JOIN
   (SELECT CAST(p_partkey AS INTEGER) AS code, p_name AS label, printf('#%02x%02x%02x', p_partkey*3 % 256, p_partkey*7 % 256, p_partkey*11 % 256) AS color
    FROM part) USING (code) GROUP BY code, label, color"""
)


def centroid_groups(spark, sf):
    """Burnt areas grouped by chains of centroids closer than 4 km."""
    b = S.burnt(spark, sf).select("burnt_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return cluster_points(b, math.nextafter(4000.0, 0.0), out="grp").select("burnt_id", "grp")


Q["centroid_groups"] = centroid_groups


def _groups_sql(link: str, body: str) -> str:
    return "WITH RECURSIVE " + S.HS + ",\n " + S.BURNT + f""",
 n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x0, y0, burnt_id) AS id, * FROM burnt),
 e AS MATERIALIZED (SELECT a.id AS s, b.id AS d FROM n a JOIN n b ON a.id <> b.id AND {link}),
 cc(id, lbl) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT e.d, min(cc.lbl) FROM cc JOIN e ON e.s = cc.id
    JOIN recurring.cc AS cur ON cur.id = e.d WHERE cc.lbl < cur.lbl GROUP BY e.d)
 {body}"""


SQL["centroid_groups"] = _groups_sql(
    "(a.x0-b.x0)*(a.x0-b.x0) + (a.y0-b.y0)*(a.y0-b.y0) < 16e6",
    "SELECT burnt_id, dense_rank() OVER (ORDER BY lbl) AS grp FROM cc JOIN n USING (id)",
)


def admin_cells(spark, sf) -> DataFrame:
    """Boundaries as cells: nations as level 2 (level 5 in region 3), suppliers as levels 4 to 10."""
    n = S.table(spark, sf, "nation")
    s = S.table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    whole = n.where("n_regionkey <> 4").select(
        F.col("n_regionkey").alias("country"), F.col("n_nationkey").cast("long").alias("poly_id"),
        F.when(F.col("n_regionkey") == 3, 5).otherwise(2).alias("level"), F.lit(0).alias("c0"), (F.lit(59) + F.col("n_nationkey")).alias("c1"),
        (F.col("n_nationkey") * 4).alias("r0"), (F.col("n_nationkey") * 4 + 3).alias("r1"),
    )
    level = F.element_at(F.array(*[F.lit(v) for v in (8, 9, 10, 6, 4)]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    start = (F.col("s_suppkey") * 7 % 50).cast("int")
    part = s.select(
        F.col("n_regionkey").alias("country"), (F.col("s_suppkey") + 1000).alias("poly_id"), level.alias("level"), start.alias("c0"),
        (start + 5 + (F.col("s_suppkey") % 9).cast("int")).alias("c1"), (F.col("n_nationkey") * 4 + 1).alias("r0"), (F.col("n_nationkey") * 4 + 4).alias("r1"),
    )
    both = whole.unionByName(part)
    return both.withColumn("cx", F.explode(F.sequence("c0", "c1"))).withColumn("cy", F.explode(F.sequence("r0", "r1"))).select(
        "country", "poly_id", "level", "cx", "cy"
    )


ADMIN = """adm AS MATERIALIZED (SELECT country, poly_id, level, cx, unnest(generate_series(r0, r1)) AS cy FROM (SELECT *, unnest(generate_series(c0, c1)) AS cx FROM
  (SELECT n_regionkey AS country, CAST(n_nationkey AS BIGINT) AS poly_id, CASE WHEN n_regionkey = 3 THEN 5 ELSE 2 END AS level, 0 AS c0, 59 + n_nationkey AS c1,
     n_nationkey*4 AS r0, n_nationkey*4+3 AS r1 FROM nation WHERE n_regionkey <> 4
   UNION ALL SELECT n_regionkey, s_suppkey + 1000, ([8,9,10,6,4])[s_suppkey % 5 + 1], s_suppkey*7 % 50, s_suppkey*7 % 50 + 5 + s_suppkey % 9,
     n_nationkey*4+1, n_nationkey*4+4 FROM supplier JOIN nation ON s_nationkey = n_nationkey))),
 big AS (SELECT country, arg_min(poly_id, (-n, poly_id)) AS p, arg_min(level, (-n, poly_id)) AS l FROM
    (SELECT country, poly_id, level, count(*) AS n FROM adm WHERE level BETWEEN 3 AND 5 GROUP BY ALL) GROUP BY country),
 has2 AS (SELECT DISTINCT country FROM adm WHERE level = 2),
 ref AS MATERIALIZED (SELECT DISTINCT a.country, cx, cy, CAST(CASE WHEN h.country IS NOT NULL THEN 2 ELSE b.l END AS INTEGER) AS ref_level
   FROM adm a LEFT JOIN has2 h ON h.country = a.country LEFT JOIN big b ON b.country = a.country
   WHERE CASE WHEN h.country IS NOT NULL THEN a.level = 2 WHEN b.p IS NOT NULL THEN a.poly_id = b.p ELSE true END),
 refn AS (SELECT country, count(*) AS ref_n, any_value(ref_level) AS ref_level FROM ref GROUP BY country),
 frac AS (SELECT r.country, l.level, ref_level, ref_n, (SELECT count(*) FROM (SELECT DISTINCT cx, cy FROM adm a WHERE a.country = r.country AND a.level = l.level) q
    JOIN ref ON ref.country = r.country AND ref.cx = q.cx AND ref.cy = q.cy) / ref_n AS fraction FROM refn r, (VALUES (8), (9)) l(level)),
 best AS (SELECT country, arg_min(level, (-fraction, level)) AS best, max(fraction) AS fraction, any_value(ref_level) AS ref_level, any_value(ref_n) AS ref_n FROM frac GROUP BY country),
 rk AS (SELECT a.*, CASE WHEN level = best THEN 100 WHEN ref.cx IS NOT NULL AND level BETWEEN 4 AND 10 THEN level END AS rk
   FROM adm a JOIN best USING (country) LEFT JOIN ref ON ref.country = a.country AND ref.cx = a.cx AND ref.cy = a.cy),
 filled AS MATERIALIZED (SELECT * FROM rk WHERE rk IS NOT NULL QUALIFY rk = max(rk) OVER (PARTITION BY country, cx, cy))"""


def coverage_fill(spark, sf):
    """Cells each boundary adds when gaps are filled from level 10 down to 4."""
    cells = admin_cells(spark, sf)
    got = L.fill_coverage(cells, L.reference_cells(cells))
    return got.groupBy("country", "poly_id", "level").agg(F.count("*").alias("cells"))


Q["coverage_fill"] = coverage_fill
SQL["coverage_fill"] = "WITH " + ADMIN + " SELECT country, poly_id, CAST(level AS INTEGER) AS level, count(*) AS cells FROM filled GROUP BY ALL"


def coverage_fraction(spark, sf):
    """Best level, its share, and the share after filling, per country."""
    cells = admin_cells(spark, sf)
    ref = L.reference_cells(cells)
    best = L.best_level(L.coverage_by_level(cells, ref))
    done = L.fill_coverage(cells, ref).select("country", "cx", "cy").distinct().groupBy("country").agg(F.count("*").alias("n"))
    return best.join(done, "country").select("country", "best", "ref_level", F.round("fraction", 6).alias("fraction"), F.round(F.col("n") / F.col("ref_n"), 6).alias("final"))


Q["coverage_fraction"] = coverage_fraction
SQL["coverage_fraction"] = "WITH " + ADMIN + """ SELECT b.country, CAST(best AS INTEGER) AS best, ref_level, round(fraction, 6) AS fraction, round(n / ref_n, 6) AS final
 FROM best b JOIN (SELECT country, count(DISTINCT (cx, cy)) AS n FROM filled GROUP BY country) d ON d.country = b.country"""

FINE, FX, FY = 600.0, 3e6 - 1500.0, 2e6 - 1500.0


def dissolve_cells(spark, sf):
    """Burnt areas at most 40 m apart dissolved: members and area of each group."""
    b = S.burnt(spark, sf)
    groups = L.touch_groups(b, "burnt_id", 40.0, 2 * S.STEP)
    cells = box_cells(b.join(groups, "burnt_id"), ["grp"], FINE, FX, FY)
    area = union_cells(cells, ["grp"]).groupBy("grp").agg((F.count("*") * F.lit(FINE * FINE) / 1e4).alias("area_ha"))
    return groups.groupBy("grp").agg(F.count("*").alias("members")).join(area, "grp")


Q["dissolve_cells"] = dissolve_cells
_CELLS_OF_BURNT = """cb AS (SELECT burnt_id, cx, unnest(generate_series(CAST((y0 - 1998500)/6e2 AS BIGINT), CAST((y1 - 1998500)/6e2 AS BIGINT) - 1)) AS cy FROM
   (SELECT *, unnest(generate_series(CAST((x0 - 2998500)/6e2 AS BIGINT), CAST((x1 - 2998500)/6e2 AS BIGINT) - 1)) AS cx FROM burnt))"""
SQL["dissolve_cells"] = _groups_sql(
    "greatest(b.x0-a.x1, a.x0-b.x1, 0e0)**2 + greatest(b.y0-a.y1, a.y0-b.y1, 0e0)**2 <= 1600",
    f""", g AS (SELECT burnt_id, min(burnt_id) OVER (PARTITION BY lbl) AS grp FROM cc JOIN n USING (id)), {_CELLS_OF_BURNT}
 SELECT grp, any_value(members) AS members, count(DISTINCT (cx, cy)) * 36e4 / 1e4 AS area_ha FROM
  (SELECT burnt_id, grp, count(*) OVER (PARTITION BY grp) AS members FROM g) JOIN cb USING (burnt_id) GROUP BY grp""",
)


def dissolve_by_country(spark, sf):
    """Supplier masks dissolved by nation: cells of the union, balances summed once per shape."""
    s = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mask_id"), "s_nationkey", "s_acctbal")
    m = S.masks(spark, sf).selectExpr("mask_id", "x0 - 1800 as x0", "y0 - 1800 as y0", "x1 + 1800 as x1", "y1 + 1800 as y1").join(s, "mask_id")
    cells = union_cells(box_cells(m, ["s_nationkey"], S.STEP, 3e6 - 900.0, 2e6 - 900.0), ["s_nationkey"])
    sums = m.groupBy("s_nationkey").agg(F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return cells.groupBy("s_nationkey").agg(F.count("*").alias("cells")).join(sums, "s_nationkey")


Q["dissolve_by_country"] = dissolve_by_country
SQL["dissolve_by_country"] = f"""WITH {S.MASKS}, m AS (SELECT mask_id, s_nationkey, s_acctbal, (x0 + 9e2 - 3e6)/1.8e3 AS cx, (y0 + 9e2 - 2e6)/1.8e3 AS cy
   FROM masks JOIN supplier ON s_suppkey = mask_id)
 SELECT s_nationkey, count(DISTINCT (cx + a, cy + b)) AS cells, any_value(bal) AS balance FROM
  (SELECT *, (SELECT round(sum(s_acctbal), 2) FROM supplier z WHERE z.s_nationkey = m.s_nationkey) AS bal FROM m), (VALUES(-1),(0),(1)) t(a), (VALUES(-1),(0),(1)) u(b) GROUP BY s_nationkey"""


def overlay_union(spark, sf):
    """Pieces of two layers laid over each other: cells in both, only burnt, only hotspot."""
    a = union_cells(box_cells(S.burnt(spark, sf), [], S.STEP, 3e6 - 900.0, 2e6 - 900.0), []).withColumn("a", F.lit(1))
    h = S.hotspots(spark, sf).select(
        F.floor((F.col("x") - 3e6 + 900) / S.STEP).cast("long").alias("cx"), F.floor((F.col("y") - 2e6 + 900) / S.STEP).cast("long").alias("cy")
    ).distinct().withColumn("b", F.lit(1))
    piece = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "burnt").otherwise("hotspot")
    return a.join(h, ["cx", "cy"], "full").groupBy(piece.alias("piece")).agg(F.count("*").alias("cells"))


Q["overlay_union"] = overlay_union
SQL["overlay_union"] = S.with_hs(
    """SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'burnt' ELSE 'hotspot' END AS piece, count(*) AS cells FROM
  (SELECT cx, cy, bool_or(s = 'a') AS a, bool_or(s = 'b') AS b FROM
   (SELECT 'b' AS s, CAST((x-3e6)/1.8e3 AS BIGINT) AS cx, CAST((y-2e6)/1.8e3 AS BIGINT) AS cy FROM hs UNION ALL
    SELECT 'a', cx, unnest(generate_series(CAST(ceil((y0-1999100)/1.8e3 - 5e-1) AS BIGINT), CAST(ceil((y1-1999100)/1.8e3 - 5e-1) AS BIGINT) - 1)) FROM
     (SELECT *, unnest(generate_series(CAST(ceil((x0-2999100)/1.8e3 - 5e-1) AS BIGINT), CAST(ceil((x1-2999100)/1.8e3 - 5e-1) AS BIGINT) - 1)) AS cx FROM burnt))
   GROUP BY cx, cy) GROUP BY 1""", S.BURNT
)


def union_by_key(spark, sf):
    """Area of the union of all daily boxes of each event."""
    cells = box_cells(S.boxes(spark, sf), ["cluster"], S.STEP, 3e6 - 900.0, 2e6 - 900.0)
    return union_cells(cells, ["cluster"]).groupBy("cluster").agg(F.count("*").alias("cells"), (F.count("*") * F.lit(S.STEP * S.STEP) / 1e4).alias("area_ha"))


Q["union_by_key"] = union_by_key
SQL["union_by_key"] = S.with_boxes(
    """SELECT cluster, count(DISTINCT (i, j)) AS cells, count(DISTINCT (i, j)) * 324e4 / 1e4 AS area_ha FROM
  (SELECT cluster, i, unnest(generate_series(CAST((y0 - 1999100)/1.8e3 AS BIGINT), CAST((y1 - 1999100)/1.8e3 AS BIGINT) - 1)) AS j FROM
   (SELECT *, unnest(generate_series(CAST((x0 - 2999100)/1.8e3 AS BIGINT), CAST((x1 - 2999100)/1.8e3 AS BIGINT) - 1)) AS i FROM boxes)) GROUP BY cluster"""
)


def hull_of_parts(spark, sf):
    """Convex hull over all parts of a multi-part shape (the daily boxes of an event)."""
    b = S.boxes(spark, sf)
    corners = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1")])
    pts = b.select("cluster", F.explode(corners).alias("p")).select("cluster", "p.x", "p.y").distinct()
    h = outline.convex_outline(pts, ["cluster"])
    return h.select("cluster", "n_points", F.round("area", 2).alias("area_m2"), F.size("ring").alias("corners"))


Q["hull_of_parts"] = hull_of_parts


def fragmentation_index(spark, sf):
    b = S.burnt(spark, sf).select("burnt_id", "x0", "y0", "x1", "y1")
    return L.fragmentation_index(b, "burnt_id", 900.0, 6000.0).select("burnt_id", F.round("ai", 6).alias("ai"))


Q["fragmentation_index"] = fragmentation_index
SQL["fragmentation_index"] = S.with_hs(
    """SELECT burnt_id, round(max(CASE WHEN area > 8e-1*3600 THEN 1 WHEN area < 1e-1*3600 THEN 0 ELSE 1 - (rim - cmp)/(5e-2*1e4*area*1e-3 - cmp) END), 6) AS ai FROM
  (SELECT *, 2*pi()*sqrt(1e4*area/pi())/1e3 AS cmp FROM (SELECT burnt_id, x, y, sum(w*h)/1e4 AS area, sum(2*(w+h))*1e-3 AS rim FROM
    (SELECT p.burnt_id, x, y, least(b.x1, x+3e3) - greatest(b.x0, x-3e3) AS w, least(b.y1, y+3e3) - greatest(b.y0, y-3e3) AS h FROM
      (SELECT burnt_id, x0 + 9e2*a AS x, y0 + 9e2*c AS y FROM burnt, (VALUES(1),(2),(3)) t(a), (VALUES(1),(2),(3)) u(c)) p JOIN burnt b
      ON b.x0 < x+3e3 AND b.x1 > x-3e3 AND b.y0 < y+3e3 AND b.y1 > y-3e3) GROUP BY burnt_id, x, y)) GROUP BY burnt_id""", S.BURNT
)
