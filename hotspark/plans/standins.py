"""Hotspots, masks, communes, burnt areas and event boxes derived from the given tables.

Every frame here has the SQL twin used by the registered queries' checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hotspark.operators.cluster import cluster_points
from hotspark.session import memo_table, prepare

EPS = 2000.0
GAP_DAYS = 5
RETENTION_DAYS = 10
STEP = 1800.0  # lattice step of the sites


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("hs_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("frp"),
        F.col("event_type").alias("sat"),
        (F.lit(3e6) + F.lit(1.8e3) * F.col("user_id")).alias("x"),
        (F.lit(2e6) + F.lit(1.8e3) * k).alias("y"),
    )


HS = """hs AS (SELECT event_id AS hs_id, ts, value AS frp, event_type AS sat,
       3e6 + 1.8e3 * user_id AS x,
       2e6 + 1.8e3 * CAST(json_extract(props, '$.k') AS INT) AS y FROM events)"""

# distance-connected clusters of the distinct sites, numbered by smallest site
CL = """pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x, y) AS id, x, y,
        CAST(floor(x/2e3) AS BIGINT) AS cx, CAST(floor(y/2e3) AS BIGINT) AS cy
        FROM (SELECT DISTINCT x, y FROM hs)),
 edges AS MATERIALIZED (SELECT a.id AS s, b.id AS d FROM pts a JOIN
        (SELECT p.*, p.cx+t.dx AS gx, p.cy+u.dy AS gy
         FROM pts p, (VALUES(-1),(0),(1)) t(dx), (VALUES(-1),(0),(1)) u(dy)) b
        ON a.cx=b.gx AND a.cy=b.gy
        WHERE a.id<>b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 4e6),
 cc(id, lbl) USING KEY (id) AS (
        SELECT id, id FROM pts
        UNION
        SELECT e.d, min(cc.lbl) FROM cc JOIN edges e ON e.s=cc.id
        JOIN recurring.cc AS cur ON cur.id=e.d WHERE cc.lbl < cur.lbl GROUP BY e.d),
 sites AS MATERIALIZED (SELECT p.x, p.y, dense_rank() OVER (ORDER BY cc.lbl) AS cluster
        FROM cc JOIN pts p USING (id))"""

HSC = "hsc AS (SELECT h.*, s.cluster FROM hs h JOIN sites s ON h.x = s.x AND h.y = s.y)"


def with_hs(body: str, *ctes: str) -> str:
    return "WITH " + ",\n ".join([HS, *ctes]) + "\n" + body


def with_clusters(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n ".join([HS, CL, HSC, *ctes]) + "\n" + body


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """Hotspots with their cluster; kept for the session as an input of later queries."""
    return memo_table(spark, sf, "clustered", lambda: cluster_points(hotspots(spark, sf), EPS))


def masks(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    cx = F.lit(3e6) + F.lit(1.8e3) * F.floor(F.col("s_suppkey") * F.lit(1.5))
    cy = F.lit(2e6) + F.lit(1.8e3) * ((F.col("s_suppkey") * 37) % 100)
    return s.select(
        F.col("s_suppkey").alias("mask_id"),
        (cx - 900.0).alias("x0"), (cy - 900.0).alias("y0"), (cx + 900.0).alias("x1"), (cy + 900.0).alias("y1"),
    )


MASKS = """masks AS (SELECT mask_id, cx - 9e2 AS x0, cy - 9e2 AS y0, cx + 9e2 AS x1, cy + 9e2 AS y1 FROM
  (SELECT s_suppkey AS mask_id, 3e6 + 1.8e3*floor(s_suppkey*1.5e0) AS cx,
   2e6 + 1.8e3*((s_suppkey*37) % 100) AS cy FROM supplier))"""


def communes(spark: SparkSession, sf: str) -> DataFrame:
    """Stripes over the whole width of the hotspots, south to north."""
    span = hotspots(spark, sf).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    n = table(spark, sf, "nation")
    y0 = F.lit(2e6) - 900.0 + F.lit(7.2e3) * F.col("n_nationkey")
    # `span` is one row
    return n.crossJoin(F.broadcast(span)).select(
        F.col("n_nationkey").cast("long").alias("commune_id"), F.col("n_name").alias("name"),
        (F.col("a") - 900.0).alias("x0"), y0.alias("y0"), (F.col("b") + 900.0).alias("x1"), (y0 + 7.2e3).alias("y1"),
    )


COMMUNES = """communes AS (SELECT CAST(n_nationkey AS BIGINT) AS commune_id, n_name AS name,
   2e6 - 9e2 + 7.2e3*n_nationkey AS y0, 2e6 - 9e2 + 7.2e3*n_nationkey + 7.2e3 AS y1 FROM nation)"""


def burnt(spark: SparkSession, sf: str) -> DataFrame:
    h = hotspots(spark, sf).where(F.col("sat") == "purchase")
    cx, cy = F.col("x") + 300.0, F.col("y") + 300.0
    return h.select(
        F.col("hs_id").alias("burnt_id"),
        (F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).alias("firedate"),
        (cx - 1800.0).alias("x0"), (cy - 1800.0).alias("y0"), (cx + 1800.0).alias("x1"), (cy + 1800.0).alias("y1"),
    )


BURNT = """burnt AS (SELECT hs_id AS burnt_id, date_trunc('day', ts) + INTERVAL 1 DAY AS firedate,
   x+3e2-1.8e3 AS x0, y+3e2-1.8e3 AS y0, x+3e2+1.8e3 AS x1, y+3e2+1.8e3 AS y1
   FROM hs WHERE sat = 'purchase')"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Observations: one row per cluster and day with its padded bounding box."""

    def build() -> DataFrame:
        return (
            clustered(spark, sf)
            .groupBy("cluster", F.date_trunc("day", "ts").alias("day"))
            .agg(
                F.count("*").alias("n_hs"),
                F.round(F.sum("frp"), 4).alias("frp"),
                (F.min("x") - 900.0).alias("x0"), (F.min("y") - 900.0).alias("y0"),
                (F.max("x") + 900.0).alias("x1"), (F.max("y") + 900.0).alias("y1"),
                F.min("ts").alias("t0"), F.max("ts").alias("t1"),
            )
            .withColumn("box_id", F.col("cluster") * 100_000 + F.unix_date(F.col("day").cast("date")))
        )

    return memo_table(spark, sf, "boxes", build)


BOXES = """boxes AS MATERIALIZED (SELECT cluster, date_trunc('day', ts) AS day, count(*) AS n_hs, round(sum(frp), 4) AS frp,
   min(x)-9e2 AS x0, min(y)-9e2 AS y0, max(x)+9e2 AS x1, max(y)+9e2 AS y1, min(ts) AS t0, max(ts) AS t1,
   cluster * 100000 + date_diff('day', DATE '1970-01-01', CAST(date_trunc('day', ts) AS DATE)) AS box_id FROM hsc GROUP BY cluster, date_trunc('day', ts))"""


def with_boxes(body: str, *ctes: str) -> str:
    return with_clusters(body, BOXES, *ctes)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Lattice grid in long form: (i, j, arrival seconds, value); empty sites are absent."""
    ev = table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        ev.groupBy(F.col("user_id").alias("i"), F.get_json_object("props", "$.k").cast("long").alias("j"))
        .agg(
            ((F.min(t) - F.lit(1_704_067_200_000_000)) / F.lit(1e6)).alias("arrival"),
            F.round(F.sum("value"), 4).alias("value"),
            F.count("*").alias("n"),
        )
    )


GRID = """grid AS MATERIALIZED (SELECT user_id AS i, CAST(json_extract(props, '$.k') AS BIGINT) AS j,
   (min(epoch_us(ts)) - 1704067200000000) / 1e6 AS arrival, round(sum(value), 4) AS value, count(*) AS n
   FROM events GROUP BY ALL)"""


def with_grid(body: str, *ctes: str) -> str:
    return "WITH " + ",\n ".join([GRID, *ctes]) + "\n" + body
