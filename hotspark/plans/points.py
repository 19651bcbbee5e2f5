"""Hotspot rows: cleaning, time, projection, masks, duplicates, slots, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotspark.functions.proj import BETA0, DD, ECC, E2, LAEA_FE, LAEA_FN, QP, RQ, laea
from hotspark.functions.timefns import lag_label, packed_time, polar_time, slot_label
from hotspark.operators import setops
from hotspark.operators.cluster import distance_pairs
from hotspark.operators.episodes import newest_per_location
from hotspark.operators.tiles import split_by_mask
from hotspark.plans import standins as S
from hotspark.sources.readers import clean_geostationary

Q, SQL = {}, {}


def raw_geo(spark, sf: str) -> DataFrame:
    """Packed-time rows of the events table in the geostationary form, with their slot."""
    ev = S.table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    us = F.unix_micros(ts)
    slot = F.timestamp_micros(F.floor(us / F.lit(600_000_000)).cast("long") * 600_000_000)
    secs = F.floor(F.pmod(us, F.lit(600_000_000)) / 1_000_000).cast("double")
    packed = F.date_format(ts, "yyyyMMddHHmmss").cast("double")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("hs_id"),
        slot.alias("slot"),
        (F.lit(-10.0) + F.col("user_id") * F.lit(0.05)).alias("LONGITUDE"),
        (F.lit(35.0) + k * F.lit(0.1)).alias("LATITUDE"),
        F.when(F.col("event_id") % 101 != 0, F.col("value")).alias("FRP"),
        F.when(F.col("event_id") % 97 == 0, F.lit(99999999999999.0))
        .when(F.col("event_id") % 2 == 0, secs)
        .otherwise(packed)
        .alias("ACQTIME"),
        F.col("event_type").alias("sat"),
    )


RAW_GEO = """rawgeo AS (SELECT event_id AS hs_id, time_bucket(INTERVAL 10 MINUTE, ts) AS slot,
   -10e0 + user_id * 5e-2 AS longitude, 35e0 + CAST(json_extract(props, '$.k') AS INT) * 1e-1 AS latitude,
   CASE WHEN event_id % 101 <> 0 THEN value END AS frp, ts, event_type AS sat FROM events)"""

# time after one trip through seconds or packed digits
GEO_TS = "CASE WHEN hs_id % 97 = 0 THEN NULL ELSE date_trunc('second', ts) END"


def hotspots_clean(spark, sf):
    out = clean_geostationary(raw_geo(spark, sf), (-9.0, 36.0, -4.0, 43.0))
    return out.select(
        "hs_id", "longitude", "latitude", "frp", "ts", slot_label(F.col("slot")).alias("slot_label")
    )


Q["hotspots_clean"] = hotspots_clean
SQL["hotspots_clean"] = f"""WITH {RAW_GEO}
SELECT hs_id, longitude, latitude, frp, {GEO_TS} AS ts, strftime(slot, '%Y-%m-%d_%H%M') AS slot_label FROM rawgeo
WHERE frp IS NOT NULL AND longitude BETWEEN -9 AND -4 AND latitude BETWEEN 36 AND 43"""


def raw_polar(spark, sf):
    ev = S.table(spark, sf, "events")
    return ev.select(
        F.col("event_id").alias("hs_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"),
        (F.hour("ts") * 100 + F.minute("ts")).alias("acq_time"),
    )


def polar_timestamp(spark, sf):
    r = raw_polar(spark, sf)
    return r.select("hs_id", "acq_time", polar_time(F.col("acq_date"), F.col("acq_time")).alias("ts"))


Q["polar_timestamp"] = polar_timestamp
SQL["polar_timestamp"] = """SELECT event_id AS hs_id, CAST(hour(ts)*100 + minute(ts) AS INTEGER) AS acq_time,
 strptime(strftime(ts, '%Y-%m-%d') || ' ' || lpad(CAST(hour(ts)*100 + minute(ts) AS VARCHAR), 4, '0'), '%Y-%m-%d %H%M') AS ts
 FROM events"""


def packed_timestamp(spark, sf):
    return raw_geo(spark, sf).select("hs_id", packed_time(F.col("ACQTIME"), F.col("slot")).alias("ts"))


Q["packed_timestamp"] = packed_timestamp
SQL["packed_timestamp"] = f"WITH {RAW_GEO} SELECT hs_id, {GEO_TS} AS ts FROM rawgeo"


def laea_project(spark, sf):
    r = raw_geo(spark, sf)
    x, y = laea(F.col("LONGITUDE"), F.col("LATITUDE"))
    return r.select("hs_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


Q["laea_project"] = laea_project
SQL["laea_project"] = f"""WITH {RAW_GEO},
 a AS (SELECT hs_id, sin(radians(latitude)) AS s, radians(longitude - 10e0) AS dl FROM rawgeo),
 b AS (SELECT hs_id, dl, asin({1 - E2!r}*(s/(1-{E2!r}*s*s) - ln((1-{ECC!r}*s)/(1+{ECC!r}*s))/{2 * ECC!r})/{QP!r}) AS beta FROM a),
 c AS (SELECT *, {RQ!r}*sqrt(2e0/(1 + sin({BETA0!r})*sin(beta) + cos({BETA0!r})*cos(beta)*cos(dl))) AS r FROM b)
 SELECT hs_id, round({LAEA_FE!r} + r*{DD!r}*cos(beta)*sin(dl), 2) AS x,
  round({LAEA_FN!r} + r/{DD!r}*(cos({BETA0!r})*sin(beta) - sin({BETA0!r})*cos(beta)*cos(dl)), 2) AS y FROM c"""


def mask_kept(spark, sf):
    return split_by_mask(S.hotspots(spark, sf), S.masks(spark, sf), S.STEP, keep=True)


def mask_removed(spark, sf):
    return split_by_mask(S.hotspots(spark, sf), S.masks(spark, sf), S.STEP, keep=False)


Q["mask_kept"], Q["mask_removed"] = mask_kept, mask_removed
_INSIDE = "(SELECT 1 FROM masks m WHERE h.x BETWEEN m.x0 AND m.x1 AND h.y BETWEEN m.y0 AND m.y1)"
SQL["mask_kept"] = S.with_hs(f"SELECT * FROM hs h WHERE NOT EXISTS {_INSIDE}", S.MASKS)
SQL["mask_removed"] = S.with_hs(f"SELECT * FROM hs h WHERE EXISTS {_INSIDE}", S.MASKS)


def slot_log(spark, sf):
    """Per 10-minute slot: fire and static hotspots, and the lag label of the newest one."""
    kept = mask_kept(spark, sf).select("ts", F.lit(0).alias("fix"))
    gone = mask_removed(spark, sf).select("ts", F.lit(1).alias("fix"))
    us = F.unix_micros("ts")
    slot = F.timestamp_micros(F.floor(us / F.lit(600_000_000)).cast("long") * 600_000_000)
    return (
        kept.unionByName(gone)
        .groupBy(slot.alias("timestamp"))
        .agg(F.count_if(F.col("fix") == 0).alias("HSfire"), F.count_if(F.col("fix") == 1).alias("HSfix"), F.max("ts").alias("newest"))
        .select("timestamp", "HSfire", "HSfix", lag_label(F.col("newest"), F.col("timestamp")).alias("lag"))
    )


Q["slot_log"] = slot_log
SQL["slot_log"] = S.with_hs(
    f"""SELECT slot AS "timestamp", count(*) FILTER (NOT fix) AS "HSfire", count(*) FILTER (fix) AS "HSfix",
  CASE WHEN max(ts) > slot THEN '+' ELSE '-' END || ' ' || lpad(CAST((epoch_us(max(ts)) - epoch_us(slot))//3600000000 AS VARCHAR), 2, '0')
  || ':' || lpad(CAST((epoch_us(max(ts)) - epoch_us(slot)) % 3600000000 // 60000000 AS VARCHAR), 2, '0') AS lag
 FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS slot, ts, EXISTS {_INSIDE} AS fix FROM hs h) GROUP BY slot""",
    S.MASKS,
)


def newest(spark, sf):
    return newest_per_location(S.hotspots(spark, sf))


Q["newest_per_location"] = newest
SQL["newest_per_location"] = S.with_hs(
    "SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY ts DESC, hs_id DESC) = 1"
)


def _two_slots(spark, sf):
    h = S.hotspots(spark, sf).select("x", "y", "sat")
    ev = S.hotspots(spark, sf)
    first = ev.where(F.col("ts") < F.lit("2024-01-16")).select("x", "y", "sat")
    second = ev.where(F.col("ts") >= F.lit("2024-01-16")).select("x", "y", "sat")
    return h, first, second


Q["rows_exactly_once"] = lambda spark, sf: setops.rows_once(_two_slots(spark, sf)[0])
SQL["rows_exactly_once"] = S.with_hs("SELECT x, y, sat FROM hs GROUP BY x, y, sat HAVING count(*) = 1")
Q["new_minus_known"] = lambda spark, sf: setops.new_minus_known(*reversed(_two_slots(spark, sf)[1:]))
SQL["new_minus_known"] = S.with_hs(
    "SELECT x, y, sat FROM hs WHERE ts >= TIMESTAMP '2024-01-16' EXCEPT ALL SELECT x, y, sat FROM hs WHERE ts < TIMESTAMP '2024-01-16'"
)
Q["in_both"] = lambda spark, sf: setops.in_both(*_two_slots(spark, sf)[1:])
SQL["in_both"] = S.with_hs(
    "SELECT x, y, sat FROM hs WHERE ts >= TIMESTAMP '2024-01-16' INTERSECT SELECT x, y, sat FROM hs WHERE ts < TIMESTAMP '2024-01-16'"
)


def eps_pairs(spark, sf):
    pts = newest(spark, sf).select(F.col("hs_id").alias("id"), "x", "y")
    return distance_pairs(pts, S.EPS)


Q["eps_pairs"] = eps_pairs
SQL["eps_pairs"] = S.with_hs(
    """SELECT a.id AS a, b.id AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist FROM n a JOIN
  (SELECT n.*, cx + t.dx AS gx, cy + u.dy AS gy FROM n, (VALUES(-1),(0),(1)) t(dx), (VALUES(-1),(0),(1)) u(dy)) b
  ON a.cx = b.gx AND a.cy = b.gy WHERE a.id < b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 4e6""",
    """n AS (SELECT max(hs_id) AS id, x, y, CAST(floor(x/2e3) AS BIGINT) AS cx, CAST(floor(y/2e3) AS BIGINT) AS cy FROM hs
   GROUP BY x, y)""",
)


def backlog_union(spark, sf):
    """Backlog plus slot: indices go on after the backlog, newest per location, old rows out."""
    h = S.hotspots(spark, sf)
    backlog = h.where(F.col("ts") < F.lit("2024-01-20")).withColumn("idx", F.col("hs_id"))
    slot = h.where(F.col("ts") >= F.lit("2024-01-20")).withColumn("version", F.lit("2.0"))
    joined = setops.append_slot(backlog, slot, "idx", ["hs_id"])
    recent = joined.where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp") - F.expr(f"INTERVAL {S.RETENTION_DAYS} DAYS"))
    return newest_per_location(recent).select("idx", "hs_id", "x", "y", "ts", "version")


Q["backlog_union"] = backlog_union
SQL["backlog_union"] = S.with_hs(
    """SELECT idx, hs_id, x, y, ts, version FROM u WHERE ts >= TIMESTAMP '2024-01-20'
    QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY ts DESC, hs_id DESC) = 1""",
    """u AS (SELECT hs_id AS idx, *, CAST(NULL AS VARCHAR) AS version FROM hs WHERE ts < TIMESTAMP '2024-01-20' UNION ALL
     SELECT (SELECT max(hs_id) FROM hs WHERE ts < TIMESTAMP '2024-01-20') + row_number() OVER (ORDER BY hs_id) AS idx, *, '2.0' AS version
     FROM hs WHERE ts >= TIMESTAMP '2024-01-20')""",
)
