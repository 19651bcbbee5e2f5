"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotspark.functions import scalars as X, timefns as T
from hotspark.functions.names import is_true_word
from hotspark.functions import proj as P
from hotspark.functions.proj import utm_zone
from hotspark.plans import standins as S

Q, SQL = {}, {}


def planck_roundtrip(spark, sf):
    """Temperature to radiance and back, 0 included."""
    p = S.table(spark, sf, "events").select(F.col("event_id"), F.when(F.col("event_id") % 50 != 0, 250 + F.col("value") * 10).otherwise(0.0).alias("bt"))
    wl = F.lit(3.8)
    p = p.withColumn("rad", X.radiance(wl, F.col("bt")))
    return p.select("event_id", F.round("rad", 6).alias("rad"), F.round(X.brightness(wl, F.col("rad")), 6).alias("bt"))


Q["planck_roundtrip"] = planck_roundtrip
_C1, _C2 = f"{X._C1!r}", f"{X._C2!r}"
SQL["planck_roundtrip"] = f"""SELECT event_id, round(rad, 6) AS rad,
  round(CASE WHEN rad = 0 THEN 0 ELSE {_C2}/(38e-1*1e-6*ln({_C1}/(pow(38e-1*1e-6, 5)*rad*1e6) + 1)) END, 6) AS bt FROM
 (SELECT event_id, CASE WHEN bt = 0 THEN 0 ELSE {_C1}/(pow(38e-1*1e-6, 5)*(exp({_C2}/(38e-1*1e-6*bt)) - 1))*1e-6 END AS rad FROM
  (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN 250 + value*10 ELSE 0e0 END AS bt FROM events))"""


def fuel_moisture(spark, sf):
    return S.table(spark, sf, "events").select("event_id", F.round(X.fine_fuel_moisture(F.col("value")), 6).alias("moisture"))


Q["fuel_moisture"] = fuel_moisture
SQL["fuel_moisture"] = "SELECT event_id, round(1472e-1*(101 - value)/(595e-1 + value), 6) AS moisture FROM events"


def dms(spark, sf):
    d = S.table(spark, sf, "events").select("event_id", X.dms((F.col("value") - 50) / 7).alias("v"))
    return d.select("event_id", "v.d", "v.m", "v.s")


Q["dms"] = dms
SQL["dms"] = """SELECT event_id, CAST(CASE WHEN v < 0 THEN -floor(abs(v)) ELSE floor(abs(v)) END AS INTEGER) AS d,
  CAST(floor((abs(v) - floor(abs(v)))*60) AS INTEGER) AS m, round(((abs(v) - floor(abs(v)))*60 - floor((abs(v) - floor(abs(v)))*60))*60, 2) AS s
 FROM (SELECT event_id, (value - 50)/7 AS v FROM events)"""

WSEN, LBRT = (-10.0, 35.0, 5.0, 45.0), (0.0, 0.0, 30000.0, 20000.0)


def scalar_misc(spark, sf):
    """Name times, durations, boxes, zones, local coordinates, stretches and words."""
    ev = S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lon, lat = F.lit(-9.5) + F.col("user_id") * 0.05, F.lit(36.0) + F.col("value") / 20
    ev = ev.withColumn("lon", lon).withColumn("lat", lat)
    name = F.concat(F.lit("firEvents-"), T.slot_label(F.col("ts")), F.lit(".geojson"))
    doy = F.concat(F.lit("fci-cm-"), F.date_format("ts", "yyyyDDD.HHmm"), F.lit(".nc"))
    lx, ly = X.lonlat_to_local(F.col("lon"), F.col("lat"), WSEN, LBRT)
    bx, by = X.local_to_lonlat(lx, ly, WSEN, LBRT)
    box = X.half_side_box(F.col("lon"), F.col("lat"), 20.0)
    v = F.col("value")
    day = F.date_trunc("day", "ts")
    return ev.select(
        "event_id", T.slot_from_name(name).alias("name_ts"), T.doy_time(doy).alias("doy_ts"),
        F.round(T.seconds_between(day, F.col("ts")) / 3600, 6).alias("hours"), F.round(T.seconds_between(day, F.col("ts")) / 86400, 6).alias("days"),
        F.round(box.west, 6).alias("west"), F.round(box.north, 6).alias("north"), utm_zone(F.col("lon")).alias("zone"),
        F.round(lx, 4).alias("lx"), F.round(by, 8).alias("lat_back"), F.round(bx, 8).alias("lon_back"),
        X.to_byte(v * 100, F.lit(1000.0), F.lit(8000.0)).alias("byte"), X.stretch(v, F.lit(10.0), F.lit(90.0)).alias("lin"),
        X.stretch(v, F.lit(10.0), F.lit(90.0), "sqrt").alias("root"),
        is_true_word(F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("TRUE"), F.lit("tRUE")), (F.col("event_id") % 4 + 1).cast("int"))).alias("word"),
        T.lag_label(F.col("ts"), F.expr("date_trunc('day', ts) + INTERVAL 12 HOURS")).alias("lag"),
        X.midpoint(day, F.col("ts")).alias("mid"),
    )


Q["scalar_misc"] = scalar_misc
SQL["scalar_misc"] = """SELECT event_id, date_trunc('minute', ts) AS name_ts, date_trunc('minute', ts) AS doy_ts,
  round(us/1e6/3600, 6) AS hours, round(us/1e6/86400, 6) AS days, round(lon - 20/(11132e-2*cos(radians(lat))), 6) AS west, round(lat + 20/11132e-2, 6) AS north,
  CAST(floor((lon + 180)/6) + 1 AS INTEGER) AS zone, round((lon + 10)/15*3e4, 4) AS lx, round(lat, 8) AS lat_back, round(lon, 8) AS lon_back,
  CAST(CASE WHEN value*100 < 1000 THEN 0 WHEN value*100 >= 8000 THEN 255 ELSE floor((value*100 - 1000)*255e0/(6999)) END AS INTEGER) AS byte,
  CAST(floor(256*(least(greatest(value, 10), 90) - 10)/80) AS INTEGER) % 256 AS lin,
  CAST(floor(256*(sqrt(least(greatest(value, 10), 90) - 10)/sqrt(8e1))) AS INTEGER) % 256 AS root,
  event_id % 4 IN (0, 2) AS word,
  CASE WHEN us > 43200000000 THEN '+' ELSE '-' END || ' ' || lpad(CAST(abs(us - 43200000000)//3600000000 AS VARCHAR), 2, '0') || ':' ||
    lpad(CAST(abs(us - 43200000000) % 3600000000 // 60000000 AS VARCHAR), 2, '0') AS lag,
  date_trunc('day', ts) + to_microseconds(us // 2) AS mid
 FROM (SELECT *, -95e-1 + user_id*5e-2 AS lon, 36e0 + value/20 AS lat, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS us FROM events)"""


# per grid: longitude and latitude that the points lie around
_AROUND = {25829: (-9, 36), 6679: (140, 38), 9473: (147, -36), 54034: (10, 30)}


def projections_roundtrip(spark, sf):
    """Places of all events to each grid and back to degrees."""
    ev = S.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    out = None
    for epsg, (lon0, lat0) in _AROUND.items():
        lon, lat = F.lit(float(lon0)) + (F.col("user_id") % 60) * 0.05, F.lit(float(lat0)) + k * 0.1
        there = P.equal_area_cylindrical(lon, lat) if epsg == 54034 else P.project(lon, lat, epsg)
        placed = ev.select("event_id", there[0].alias("x"), there[1].alias("y"))
        x, y = F.col("x"), F.col("y")
        if epsg in P.TRANSVERSE_GRIDS:
            back = P.transverse_mercator_inverse(x, y, *P.TRANSVERSE_GRIDS[epsg])
        elif epsg in P.CONIC_GRIDS:
            back = P.equal_area_conic_inverse(x, y, *P.CONIC_GRIDS[epsg])
        else:
            back = P.equal_area_cylindrical_inverse(x, y)
        part = placed.select("event_id", F.lit(epsg).alias("epsg"), F.round(back[0], 6).alias("lon"), F.round(back[1], 6).alias("lat"))
        out = part if out is None else out.unionByName(part)
    return out


Q["projections_roundtrip"] = projections_roundtrip
SQL["projections_roundtrip"] = (
    """SELECT event_id, epsg, round(CAST(lon0 AS DOUBLE) + (user_id % 60)*5e-2, 6) AS lon,
  round(CAST(lat0 AS DOUBLE) + CAST(json_extract(props, '$.k') AS INT)*1e-1, 6) AS lat FROM events, (VALUES """
    + ", ".join(f"({e}, {a}, {b})" for e, (a, b) in _AROUND.items())
    + ") g(epsg, lon0, lat0)"
)
