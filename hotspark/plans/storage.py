"""Reading and writing: raw files, hourly layout, snapshots, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from hotspark.functions import geom
from hotspark.plans import standins as S
from hotspark.plans.points import GEO_TS, RAW_GEO, raw_geo
from hotspark.session import fresh_path, spread
from hotspark.sources import readers as R, writers as W

Q, SQL = {}, {}

_paths: dict[tuple[str, str, str], str] = {}


def _once(spark, sf: str, name: str, write) -> str:
    """Path of files derived from the given tables, written on first use in the session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _paths:
        path = fresh_path(spark, name)
        write(path)
        _paths[key] = path
    return _paths[key]


def polar_rows(spark, sf) -> DataFrame:
    ev = S.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        (F.lit(35.0) + k * 0.1).alias("latitude"), (F.lit(-10.0) + F.col("user_id") * 0.05).alias("longitude"),
        (F.col("value") + 300).alias("bright_ti4"), F.lit(0.5).alias("scan"), F.lit(0.4).alias("track"),
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), (F.hour("ts") * 100 + F.minute("ts")).alias("acq_time"),
        F.lit("N").alias("satellite"), F.lit("VIIRS").alias("instrument"), F.lit("n").alias("confidence"), F.lit("2.0NRT").alias("version"),
        (F.col("value") + 280).alias("bright_ti5"), F.when(F.col("event_id") % 101 != 0, F.col("value")).alias("frp"),
        F.when(F.hour("ts").between(6, 18), "D").otherwise("N").alias("daynight"), F.col("event_type").alias("sat"),
    )


def raw_read_polar(spark, sf):
    """Polar CSV files written per platform and day, read back by header and harmonised.

    One platform's files have the columns in another order; files of another day's rows carry 0000 in their name.
    """

    def write(path):
        cols = [f.name for f in R.POLAR_SCHEMA.fields]
        rows = polar_rows(spark, sf).withColumn("day", F.col("acq_date"))
        for side, test, order in (("a", F.col("sat") != "click", cols), ("b", F.col("sat") == "click", [*reversed(cols)])):
            spread(rows.where(test).select(*order, "sat", "day"), "sat", "day").write.option("header", True).partitionBy("sat", "day").csv(f"{path}/{side}")

    path = _once(spark, sf, "polar", write)
    raw = R.read_platforms(spark, [f"{path}/a", f"{path}/b"], R.POLAR_SCHEMA, ["latitude", "longitude", "frp", "acq_date", "acq_time"], skip="-0000-")
    clean = R.clean_polar(raw)
    return clean.select("sat", "ts", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"), "frp", "version", "daynight")


Q["raw_read_polar"] = raw_read_polar
SQL["raw_read_polar"] = """SELECT event_type AS sat, date_trunc('minute', ts) AS ts, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, value AS frp,
  '2.0NRT' AS version, CASE WHEN hour(ts) BETWEEN 6 AND 18 THEN 'D' ELSE 'N' END AS daynight
 FROM (SELECT *, -10e0 + user_id*5e-2 AS longitude, 35e0 + CAST(json_extract(props, '$.k') AS INT)*1e-1 AS latitude FROM events)
 WHERE event_id % 101 <> 0"""


def raw_read_geo(spark, sf):
    """Geostationary CSV files per slot folder, read by header and harmonised."""

    def write(path):
        rows = raw_geo(spark, sf).withColumn("FIRE_CONFIDENCE", F.lit(0.9)).withColumn("ABS_LINE", F.col("hs_id").cast("double"))
        cols = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast("double").alias(f.name) for f in R.GEO_SCHEMA.fields]
        text = rows.select(*cols, F.date_format("slot", "yyyyMMdd").alias("day"), F.date_format("slot", "yyyyMMddHHmm").alias("slot"))
        # the slot stands in the file as in a folder name; one folder a day keeps the number of small files low
        text.hint("rebalance", "day").write.option("header", True).partitionBy("day").csv(path)

    path = _once(spark, sf, "geo", write)
    slotted = T.StructType([*R.GEO_SCHEMA.fields, T.StructField("slot", T.StringType())])
    raw = R.read_by_header(spark, path, slotted, [*R.GEO_REQUIRED, "slot"]).withColumn("slot", F.to_timestamp("slot", "yyyyMMddHHmm"))
    clean = R.clean_geostationary(raw, (-9.0, 36.0, -4.0, 43.0)).drop(*R.GEO_DROPPED[1:])
    return clean.select(F.col("ABS_LINE").cast("long").alias("hs_id"), "ts", "frp", F.round("longitude", 6).alias("longitude"), F.col("FIRE_CONFIDENCE").alias("confidence"))


Q["raw_read_geo"] = raw_read_geo
SQL["raw_read_geo"] = f"""WITH {RAW_GEO} SELECT hs_id, {GEO_TS} AS ts, frp, round(longitude, 6) AS longitude, 9e-1 AS confidence FROM rawgeo
 WHERE frp IS NOT NULL AND longitude BETWEEN -9 AND -4 AND latitude BETWEEN 36 AND 43"""


def hourly_layout(spark, sf):
    """Archive rows in the hourly folders, read back and counted by folder."""
    path = _once(spark, sf, "hourly", lambda p: W.write_hourly(polar_rows(spark, sf).drop("sat"), p))
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(F.col("acq_date").cast("string").alias("acq_date"), F.col("acq_hour").cast("int").alias("acq_hour")).agg(
        F.count("*").alias("n"), F.min(F.lpad(F.col("acq_time").cast("string"), 4, "0")).alias("first"), F.round(F.sum(F.col("bright_ti4").cast("double")), 4).alias("bt")
    )


Q["hourly_layout"] = hourly_layout
SQL["hourly_layout"] = """SELECT strftime(ts, '%Y-%m-%d') AS acq_date, CAST(hour(ts)*100 AS INTEGER) AS acq_hour, count(*) AS n,
  min(strftime(ts, '%H%M')) AS first, round(sum(value + 300), 4) AS bt FROM events GROUP BY 1, 2"""


def snapshots(spark, sf) -> DataFrame:
    """Event state per day, as written by a run; partitioned by snapshot time."""

    def write(path):
        b = S.boxes(spark, sf).select("cluster", F.col("day").alias("snapshot_ts"), "n_hs", "frp", "t1", (F.col("n_hs") == 7).alias("merged"))
        W.write_state(b, path)

    return spark.read.parquet(_once(spark, sf, "snapshots", write))


def snapshot_restore(spark, sf):
    """Live events of the newest snapshot at or before the start, and the next free id."""
    s = R.snapshot_at(snapshots(spark, sf), "2024-01-20 12:00:00")
    nxt = s.agg((F.max("cluster") + 1).alias("next_id"))
    # `nxt` is one row
    return s.where(~F.col("merged")).crossJoin(F.broadcast(nxt)).select("cluster", F.col("snapshot_ts").cast("timestamp").alias("snapshot_ts"), "frp", "next_id")


Q["snapshot_restore"] = snapshot_restore
SQL["snapshot_restore"] = S.with_boxes(
    """SELECT cluster, day AS snapshot_ts, frp, max(cluster) OVER () + 1 AS next_id FROM boxes WHERE day = TIMESTAMP '2024-01-20' QUALIFY n_hs <> 7"""
)


def snapshot_scan(spark, sf):
    """Snapshots inside the run window, ended less than 10 days before its end; duplicate ids."""
    s = R.snapshots_between(snapshots(spark, sf), "2024-01-08", "2024-01-25")
    recent = s.where(F.col("t1") > F.lit("2024-01-25").cast("timestamp") - F.expr("INTERVAL 10 DAYS"))
    return recent.groupBy("cluster").agg(F.count("*").alias("n"), F.max(F.col("snapshot_ts").cast("timestamp")).alias("last")).withColumn("duplicate", F.col("n") > 1)


Q["snapshot_scan"] = snapshot_scan
SQL["snapshot_scan"] = S.with_boxes(
    """SELECT cluster, count(*) AS n, max(day) AS last, count(*) > 1 AS duplicate FROM boxes
  WHERE day BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-25' AND t1 > TIMESTAMP '2024-01-15' GROUP BY cluster"""
)


def last_two_days(spark, sf):
    s = R.snapshots_between(snapshots(spark, sf), "2024-01-26 06:00:00", "2024-01-28 06:00:00")
    return s.select("cluster", F.col("snapshot_ts").cast("timestamp").alias("snapshot_ts"), "frp")


Q["last_two_days"] = last_two_days
SQL["last_two_days"] = S.with_boxes(
    "SELECT cluster, day AS snapshot_ts, frp FROM boxes WHERE day BETWEEN TIMESTAMP '2024-01-26 06:00:00' AND TIMESTAMP '2024-01-28 06:00:00'"
)


def latest_snapshot(spark, sf):
    s = R.snapshot_at(snapshots(spark, sf))
    return s.select("cluster", F.col("snapshot_ts").cast("timestamp").alias("snapshot_ts"), "n_hs", "frp")


Q["latest_snapshot"] = latest_snapshot
SQL["latest_snapshot"] = S.with_boxes("SELECT cluster, day AS snapshot_ts, n_hs, frp FROM boxes WHERE day = (SELECT max(day) FROM boxes)")


def polygon_layer(spark, sf):
    """A boundary layer written as GeoJSON lines and read back as rings."""

    def write(path):
        b = S.boxes(spark, sf).withColumn("ring", geom.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
        hole = geom.box_ring(F.col("x0") + 100.0, F.col("y0") + 100.0, F.col("x0") + 300.0, F.col("y0") + 200.0)
        W.write_geojson(b.withColumn("holes", F.array(hole)), path, "ring", F.struct("box_id", F.lit("8").alias("admin_level")), holes="holes")

    p = R.read_feature_lines(spark, _once(spark, sf, "layer", write))
    open_ = lambda r: F.slice(r, F.lit(1), F.size(r) - 1)  # noqa: E731  without the closing corner
    ring, holes = open_(F.col("ring")), F.transform("holes", open_)
    low = F.struct(F.array_min(F.transform(ring, lambda q: q.x)).alias("x"), F.array_min(F.transform(ring, lambda q: q.y)).alias("y"))
    return p.select(
        F.element_at("properties", "box_id").cast("long").alias("box_id"), F.element_at("properties", "admin_level").cast("int").alias("admin_level"),
        "kind", F.size(ring).alias("corners"), F.round(geom.area_with_holes(ring, holes), 3).alias("area"),
        geom.contains_with_holes(ring, holes, low.x + 200.0, low.y + 150.0).alias("holds_hole"),
        geom.contains_with_holes(ring, holes, low.x + 50.0, low.y + 50.0).alias("holds_rim"),
    )


Q["polygon_layer"] = polygon_layer
SQL["polygon_layer"] = S.with_boxes(
    "SELECT box_id, 8 AS admin_level, 'Polygon' AS kind, 4 AS corners, round((x1-x0)*(y1-y0) - 2e4, 3) AS area, false AS holds_hole, true AS holds_rim FROM boxes"
)


def sink_roundtrip(spark, sf):
    """Every sink written and read back: rows and a check sum per sink."""
    base = fresh_path(spark, "sinks")
    h, b = S.hotspots(spark, sf), S.boxes(spark, sf)
    ring = geom.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    shapes = b.withColumn("ring", ring)
    W.write_hotspots(h.withColumn("snapshot_ts", F.date_trunc("day", "ts")), f"{base}/hotspots")
    W.write_state(b.withColumnRenamed("day", "snapshot_ts"), f"{base}/state")
    W.write_merges(b.where("n_hs > 3").select("cluster", "box_id", "t1"), f"{base}/merges")
    log = h.groupBy(F.date_trunc("hour", "ts").alias("timestamp")).agg(F.count("*").alias("HSfire"), F.count_if(F.col("sat") == "error").alias("HSfix"))
    W.write_slot_log(log, f"{base}/log")
    W.write_series(b.select("cluster", F.col("t1").alias("timestamp"), "frp", F.lit(-999.0).alias("fros")), f"{base}/series", ["cluster"], "timestamp")
    area = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / 1e4).alias("area")
    values = b.select(F.extract(F.lit("YEAROFWEEK"), "day").cast("int").alias("year"), F.weekofyear("day").alias("week"), area)
    W.write_weekly(values.groupBy("year", "week").agg(F.count("*").alias("event_count")), values, f"{base}/weekly")
    W.write_geojson(shapes, f"{base}/layer", "ring", F.struct("box_id", "frp"))
    cell = geom.hex_cell((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, 26_000.0)
    hexes = b.groupBy(cell.alias("h")).agg(F.avg("frp").alias("frp_mean"), F.count("*").alias("events"))
    W.write_geojson(hexes.withColumn("ring", geom.hex_ring(F.col("h"), 26_000.0)), f"{base}/hex", "ring", F.struct("events", "frp_mean"))
    W.write_raster(b.select("day", "cluster", "frp"), f"{base}/raster")
    W.write_event_power(h.select(F.col("ts").alias("timestamp"), F.col("frp").alias("FRP")), f"{base}/power")
    bounds = S.communes(spark, sf).withColumn("ring", ring).select(F.col("name").alias("name_en_clean"), F.lit(8).alias("admin_level"), "ring")
    W.write_boundaries(bounds, f"{base}/bounds")

    def row(name: str, df: DataFrame, value):
        return df.agg(F.lit(name).alias("sink"), F.count("*").alias("n"), F.round(F.sum(value), 3).alias("total"))

    power = spark.read.schema("timestamp timestamp, FRP double").option("header", True).csv(f"{base}/power")
    layer = spark.read.text(f"{base}/layer").select(F.get_json_object("value", "$.properties.frp").cast("double").alias("frp"))
    out = [
        row("hotspots", spark.read.parquet(f"{base}/hotspots"), F.col("frp") + F.col("ABS_LINE")),
        row("state", spark.read.parquet(f"{base}/state"), F.col("frp")),
        row("merges", spark.read.parquet(f"{base}/merges"), F.col("box_id").cast("double")),
        row("log", spark.read.schema("timestamp timestamp, HSfire long, HSfix long").option("header", True).csv(f"{base}/log"), (F.col("HSfire") * 2 + F.col("HSfix")).cast("double")),
        row("series", spark.read.schema("cluster long, timestamp timestamp, frp double, fros double").json(f"{base}/series"), F.col("frp") + F.col("fros")),
        row("weekly", spark.read.schema("year int, week int, event_count long").option("header", True).csv(f"{base}/weekly/weekly"), F.col("event_count").cast("double")),
        row("weekly_values", spark.read.parquet(f"{base}/weekly/values"), F.col("area")),
        row("layer", layer, F.col("frp")),
        row("hex_events", spark.read.text(f"{base}/hex").select(F.explode(F.array(F.get_json_object("value", "$.properties.events").cast("double"))).alias("e")).agg(F.sum("e").alias("e")), F.col("e")),
        row("raster", spark.read.parquet(f"{base}/raster"), F.col("frp")),
        row("power", power, F.col("FRP")),
        row("bounds", spark.read.parquet(f"{base}/bounds"), geom.length(F.col("ring")) * 0 + F.col("admin_level")),
    ]
    res = out[0]
    for r in out[1:]:
        res = res.unionByName(r)
    return res


Q["sink_roundtrip"] = sink_roundtrip
SQL["sink_roundtrip"] = S.with_boxes(
    """SELECT 'hotspots' AS sink, count(*) AS n, round(sum(frp - 999), 3) AS total FROM hs
  UNION ALL SELECT 'state', count(*), round(sum(frp), 3) FROM boxes
  UNION ALL SELECT 'merges', count(*), round(sum(box_id)::DOUBLE, 3) FROM boxes WHERE n_hs > 3
  UNION ALL SELECT 'log', count(*), sum(n)::DOUBLE FROM (SELECT count(*)*2 + count(*) FILTER (sat = 'error') AS n FROM hs GROUP BY date_trunc('hour', ts))
  UNION ALL SELECT 'series', count(*), round(sum(frp - 999), 3) FROM boxes
  UNION ALL SELECT 'weekly', count(*), sum(n)::DOUBLE FROM (SELECT count(*) AS n FROM boxes GROUP BY isoyear(day), weekofyear(day))
  UNION ALL SELECT 'weekly_values', count(*), round(sum((x1-x0)*(y1-y0)/1e4), 3) FROM boxes
  UNION ALL SELECT 'layer', count(*), round(sum(frp), 3) FROM boxes
  UNION ALL SELECT 'hex_events', 1, count(*)::DOUBLE FROM boxes
  UNION ALL SELECT 'raster', count(*), round(sum(frp), 3) FROM boxes
  UNION ALL SELECT 'power', count(*), round(sum(frp), 3) FROM hs
  UNION ALL SELECT 'bounds', count(*), count(*)*8e0 FROM communes""", S.COMMUNES
)
