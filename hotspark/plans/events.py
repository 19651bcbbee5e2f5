"""Event tables: layers, weekly statistics, energy, summaries, contours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hotspark.functions import geom
from hotspark.functions.proj import laea_inverse
from hotspark.functions.timefns import floor_to, seconds_between
from hotspark.operators import frontspeed as FS, lineage as LN, overlay as O
from hotspark.plans import standins as S

Q, SQL = {}, {}

STEP_SECONDS = 600.0
HALF_BOX = 1800.0  # box of a single site
FRONT_TILE = 36_000.0


def kind_of_box():
    """A single-site box stands for a point."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return F.when((w <= HALF_BOX) & (h <= HALF_BOX), "Point").otherwise("Polygon")


KIND = "CASE WHEN x1-x0 <= 1.8e3 AND y1-y0 <= 1.8e3 THEN 'Point' ELSE 'Polygon' END"


def _latest(obs: DataFrame, by: str = "day") -> DataFrame:
    rest = [c for c in obs.columns if c != "cluster"]
    return obs.groupBy("cluster").agg(F.max_by(F.struct(*rest), F.col(by)).alias("o")).select("cluster", "o.*")


def latest_per_event(spark, sf):
    """Newest snapshot row of each event inside the run window."""
    b = S.boxes(spark, sf).where(F.col("day").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-25").cast("timestamp")))
    return _latest(b).select("cluster", "day", "n_hs", "frp")


Q["latest_per_event"] = latest_per_event
SQL["latest_per_event"] = S.with_boxes(
    """SELECT cluster, day, n_hs, frp FROM boxes WHERE day BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY day DESC) = 1"""
)


def active_layer(spark, sf):
    """Last observation of each event that is still alive at the given time."""
    now = F.lit("2024-01-21").cast("timestamp")
    b = S.boxes(spark, sf).where(F.col("day") < now)
    last = _latest(b).where(F.col("t1") >= now - F.expr("INTERVAL 2 DAYS"))
    return last.select(
        "cluster", F.col("t1").alias("time"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"),
        "frp", kind_of_box().alias("kind"), "x0", "y0", "x1", "y1",
    )


Q["active_layer"] = active_layer
SQL["active_layer"] = S.with_boxes(
    f"""SELECT cluster, t1 AS time, (x0+x1)/2 AS cx, (y0+y1)/2 AS cy, frp, {KIND} AS kind, x0, y0, x1, y1 FROM
   (SELECT * FROM boxes WHERE day < TIMESTAMP '2024-01-21' QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY day DESC) = 1)
  WHERE t1 >= TIMESTAMP '2024-01-19'"""
)


def event_history(spark, sf) -> DataFrame:
    """One row per event: total power, last area, duration, week of the last snapshot."""
    b = S.boxes(spark, sf)
    per = b.groupBy("cluster").agg(
        F.sum("frp").alias("frp"), F.count("*").alias("n_obs"), F.min("t1").alias("ta"), F.max("t1").alias("tb"),
        F.max_by(F.struct("x0", "y0", "x1", "y1", kind_of_box().alias("kind")), F.col("day")).alias("last"), F.max("day").alias("day"),
    )
    area = F.when(F.col("last.kind") == "Polygon", geom.box_area("last") / 1e4).otherwise(0.0)
    hours = F.when(F.col("n_obs") >= 2, seconds_between(F.col("ta"), F.col("tb")) / 3600).otherwise(0.0)
    return per.select(
        "cluster", "frp", area.alias("area"), hours.alias("hours"), F.extract(F.lit("YEAROFWEEK"), "day").cast("int").alias("year"),
        F.weekofyear("day").alias("week"),
    )


HIST = f"""hist AS (SELECT cluster, sum(frp) AS frp, CASE WHEN arg_max({KIND}, day) = 'Polygon' THEN arg_max((x1-x0)*(y1-y0), day)/1e4 ELSE 0 END AS area,
   CASE WHEN count(*) >= 2 THEN (epoch_us(max(t1)) - epoch_us(min(t1)))/1e6/3600 ELSE 0 END AS hours,
   CAST(isoyear(max(day)) AS INTEGER) AS year, CAST(weekofyear(max(day)) AS INTEGER) AS week FROM boxes GROUP BY cluster)"""


def weekly_stats(spark, sf):
    return event_history(spark, sf).groupBy("year", "week").agg(
        F.round(F.sum("frp"), 3).alias("total_frp"), F.count("*").alias("event_count"),
        F.round(F.avg("area"), 4).alias("mean_area"), F.round(F.stddev_pop("area"), 4).alias("std_area"),
        F.round(F.avg("hours"), 4).alias("mean_duration_h"), F.round(F.stddev_pop("hours"), 4).alias("std_duration_h"),
    )


Q["weekly_stats"] = weekly_stats
SQL["weekly_stats"] = S.with_boxes(
    """SELECT year, week, round(sum(frp), 3) AS total_frp, count(*) AS event_count, round(avg(area), 4) AS mean_area,
  round(stddev_pop(area), 4) AS std_area, round(avg(hours), 4) AS mean_duration_h, round(stddev_pop(hours), 4) AS std_duration_h
  FROM hist GROUP BY year, week""", HIST
)


def weekly_by_observation(spark, sf):
    """The second reading of the weekly table: power counts in the week it was seen."""
    b = S.boxes(spark, sf)
    return b.groupBy(F.extract(F.lit("YEAROFWEEK"), "day").cast("int").alias("year"), F.weekofyear("day").alias("week")).agg(
        F.round(F.sum("frp"), 3).alias("total_frp"), F.count("*").alias("observations"),
    )


Q["weekly_by_observation"] = weekly_by_observation
SQL["weekly_by_observation"] = S.with_boxes(
    """SELECT CAST(isoyear(day) AS INTEGER) AS year, CAST(weekofyear(day) AS INTEGER) AS week, round(sum(frp), 3) AS total_frp,
  count(*) AS observations FROM boxes GROUP BY ALL"""
)


def weekly_quantiles(spark, sf):
    """Box-plot numbers of events of at least 10 ha that lasted."""
    h = event_history(spark, sf).where((F.col("area") >= 10) & (F.col("hours") > 0))
    cols = [F.count("*").alias("n")]
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        cols.append(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY area)").alias(f"area_{name}"))
        cols.append(F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY hours / 24)"), 6).alias(f"days_{name}"))
    return h.groupBy("year", "week").agg(*cols)


Q["weekly_quantiles"] = weekly_quantiles
SQL["weekly_quantiles"] = S.with_boxes(
    "SELECT year, week, count(*) AS n, "
    + ", ".join(
        f"quantile_disc(area, {p}) AS area_{q}, round(quantile_disc(hours/24, {p}), 6) AS days_{q}"
        for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
    )
    + " FROM hist WHERE area >= 10 AND hours > 0 GROUP BY year, week",
    HIST,
)


def event_series(spark, sf) -> DataFrame:
    """Power series of each event: summed by the centre time of the 10-minute step."""
    c = S.clustered(spark, sf)
    tag = floor_to(F.col("ts"), 600) + F.expr("INTERVAL 5 MINUTES")
    return c.groupBy("cluster", tag.alias("tag")).agg(F.sum("frp").alias("frp"))


def event_energy(spark, sf):
    s = event_series(spark, sf)
    return s.groupBy("cluster").agg(
        F.count("*").alias("steps"), F.round(F.sum("frp") * STEP_SECONDS, 2).alias("fre"), F.min("tag").alias("first_tag"),
        F.max("tag").alias("last_tag"),
    )


Q["event_energy"] = event_energy
SERIES = """series AS (SELECT cluster, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 5 MINUTE AS tag, sum(frp) AS frp FROM hsc GROUP BY ALL)"""
SQL["event_energy"] = S.with_clusters(
    """SELECT cluster, count(*) AS steps, round(sum(frp) * 6e2, 2) AS fre, min(tag) AS first_tag, max(tag) AS last_tag
  FROM series GROUP BY cluster""", SERIES
)


def energy_hourly_cum(spark, sf):
    """Hourly energy and its running sum.

    The running sum is taken inside each day and shifted by the energy of the days
    before; the days are ordered as one row each, so no task orders hours at large.
    """
    h = S.hotspots(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg((F.sum("frp") * STEP_SECONDS).alias("fre"))
    h = h.withColumn("day", F.date_trunc("day", "hour"))
    days = h.groupBy("day").agg(F.sum("fre").alias("d"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("day", F.coalesce(F.sum("d").over(earlier), F.lit(0.0)).alias("before"))
    w = Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    run = h.withColumn("inday", F.sum("fre").over(w)).join(before, "day")
    return run.select("hour", F.round("fre", 2).alias("fre"), F.round(F.col("before") + F.col("inday"), 2).alias("fre_cum"))


Q["energy_hourly_cum"] = energy_hourly_cum
SQL["energy_hourly_cum"] = S.with_hs(
    """SELECT hour, round(fre, 2) AS fre, round(sum(fre) OVER (ORDER BY hour), 2) AS fre_cum
  FROM (SELECT date_trunc('hour', ts) AS hour, sum(frp) * 6e2 AS fre FROM hs GROUP BY 1)"""
)


def short_points_removed(spark, sf):
    """Drops point events that lasted at most ten minutes; unknown durations stay."""
    e = event_rows(spark, sf)
    minutes = seconds_between(F.col("time_start"), F.col("time_end")) / 60
    drop = (F.col("kind") == "Point") & minutes.isNotNull() & (minutes <= 10)
    return e.where(~drop).select("cluster", "time_start", "time_end", "kind")


def event_rows(spark, sf) -> DataFrame:
    c = S.clustered(spark, sf)
    g = c.groupBy("cluster").agg(
        F.min("ts").alias("time_start"), F.max("ts").alias("_end"), F.round(F.sum("frp") * STEP_SECONDS, 2).alias("fre"),
        (F.min("x") - 900.0).alias("x0"), (F.min("y") - 900.0).alias("y0"), (F.max("x") + 900.0).alias("x1"), (F.max("y") + 900.0).alias("y1"),
        F.max("hs_id").alias("last_hs"),
    )
    # some events have no end yet
    end = F.when(F.col("last_hs") % 50 != 0, F.col("_end"))
    return g.withColumn("time_end", end).withColumn("kind", kind_of_box())


EVROWS = f"""ev AS (SELECT *, {KIND} AS kind FROM (SELECT cluster, min(ts) AS time_start, CASE WHEN max(hs_id) % 50 <> 0 THEN max(ts) END AS time_end,
  round(sum(frp) * 6e2, 2) AS fre, min(x)-9e2 AS x0, min(y)-9e2 AS y0, max(x)+9e2 AS x1, max(y)+9e2 AS y1 FROM hsc GROUP BY cluster))"""
KEPT = """(kind <> 'Point' OR time_end IS NULL OR epoch_us(time_end) - epoch_us(time_start) > 600000000)"""
Q["short_points_removed"] = short_points_removed
SQL["short_points_removed"] = S.with_clusters(f"SELECT cluster, time_start, time_end, kind FROM ev WHERE {KEPT}", EVROWS)

HEX_EDGE = 26_000.0


def hex_mean_energy(spark, sf):
    """Mean energy and mean duration of the events of each hexagon."""
    e = event_rows(spark, sf).join(short_points_removed(spark, sf).select("cluster"), "cluster")
    cell = geom.hex_cell((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, HEX_EDGE)
    g = e.groupBy(cell.alias("h")).agg(
        F.count("*").alias("events"), F.round(F.avg("fre"), 2).alias("fre_mean"),
        F.round(F.avg(seconds_between(F.col("time_start"), F.col("time_end")) / 3600), 4).alias("duration_mean_h"),
    )
    return g.select(F.col("h.q").alias("q"), F.col("h.r").alias("r"), "events", "fre_mean", "duration_mean_h")


Q["hex_mean_energy"] = hex_mean_energy
SQL["hex_mean_energy"] = S.with_clusters(
    """SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q,
   CAST(CASE WHEN dr >= dq AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r,
   count(*) AS events, round(avg(fre), 2) AS fre_mean, round(avg((epoch_us(time_end) - epoch_us(time_start))/1e6/3600), 4) AS duration_mean_h
  FROM (SELECT *, abs(rq-q) AS dq, abs(rr-r) AS dr, abs(rs-s) AS ds FROM
   (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(s, 0) AS rs FROM
    (SELECT *, -q-r AS s FROM (SELECT *, ((x0+x1)/2*(sqrt(3e0)/3) - (y0+y1)/2/3)/2.6e4 AS q, (y0+y1)/2*(2e0/3)/2.6e4 AS r FROM ev WHERE """
    + KEPT
    + """)))) GROUP BY 1, 2""",
    EVROWS,
)


def subevent_owner(spark, sf):
    """Each sub-event counts once: for the first owner in week order; merged-away owners are out.

    Owners are the clusters, sub-events the lattice rows they touch, merged-away
    owners those with a single hotspot.
    """
    c = S.clustered(spark, sf)
    owners = c.groupBy("cluster").agg(F.max("ts").alias("t"), F.count("*").alias("n"))
    merged = owners.where("n = 1").select("cluster")
    weeks = owners.join(merged, "cluster", "left_anti").select(
        "cluster", F.extract(F.lit("YEAROFWEEK"), "t").cast("int").alias("year"), F.weekofyear("t").alias("week")
    )
    subs = c.select("cluster", ((F.col("y") - 2e6) / 1800).cast("long").alias("sub_id"), "frp").groupBy("cluster", "sub_id").agg(F.sum("frp").alias("frp"))
    own = subs.join(weeks, "cluster").groupBy("sub_id").agg(
        F.min_by(F.struct("cluster", "frp", "year", "week"), F.struct("year", "week", "cluster")).alias("o")
    )
    return own.select("sub_id", F.col("o.cluster").alias("owner"), F.col("o.year").alias("year"), F.col("o.week").alias("week"), F.round("o.frp", 4).alias("frp"))


Q["subevent_owner"] = subevent_owner
SQL["subevent_owner"] = S.with_clusters(
    """SELECT sub_id, cluster AS owner, year, week, round(frp, 4) AS frp FROM
  (SELECT cluster, CAST((y-2e6)/1.8e3 AS BIGINT) AS sub_id, sum(frp) AS frp FROM hsc GROUP BY 1, 2) s JOIN
  (SELECT cluster, CAST(isoyear(max(ts)) AS INTEGER) AS year, CAST(weekofyear(max(ts)) AS INTEGER) AS week FROM hsc GROUP BY cluster HAVING count(*) > 1) w
  USING (cluster) QUALIFY row_number() OVER (PARTITION BY sub_id ORDER BY year, week, cluster) = 1"""
)


def event_summary(spark, sf):
    """One row per event: floored times, energy, the sensors in first-seen order as text.

    Only one row per (event, sensor) reaches the text, so a large event stays small.
    """
    c = S.clustered(spark, sf)
    per = c.groupBy("cluster", "sat").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("frp").alias("frp"),
        F.min_by(F.struct("x", "y"), F.struct("ts", "hs_id")).alias("p"), F.min(F.struct("ts", "hs_id")).alias("o"),
    )
    seen = F.array_sort(F.collect_list(F.struct("first", "sat")))
    g = per.groupBy("cluster").agg(
        F.min("first").alias("t0"), F.max("last").alias("t1"), F.sum("frp").alias("frp"), F.min_by("p", "o").alias("ign"), seen.alias("seen")
    )
    five = F.expr("INTERVAL 5 MINUTES")
    return g.select(
        "cluster", F.col("ign.x").alias("ign_x"), F.col("ign.y").alias("ign_y"),
        floor_to(floor_to(F.col("t0"), 600) + five, 1800).alias("time_start"),
        floor_to(floor_to(F.col("t1"), 600) + five, 1800).alias("time_end"),
        F.round(F.col("frp") * STEP_SECONDS, 2).alias("fre"),
        F.array_join(F.transform("seen", lambda s: s.sat), ";").alias("sensors"),
        F.array_join(F.transform("seen", lambda s: F.date_format(s["first"], "yyyy-MM-dd_HH:mm:ss")), ";").alias("time_include"),
    )


Q["event_summary"] = event_summary
SQL["event_summary"] = S.with_clusters(
    """SELECT cluster, arg_min(px, o) AS ign_x, arg_min(py, o) AS ign_y,
   time_bucket(INTERVAL 30 MINUTE, time_bucket(INTERVAL 10 MINUTE, min(first)) + INTERVAL 5 MINUTE) AS time_start,
   time_bucket(INTERVAL 30 MINUTE, time_bucket(INTERVAL 10 MINUTE, max(last)) + INTERVAL 5 MINUTE) AS time_end,
   round(sum(frp) * 6e2, 2) AS fre, string_agg(sat, ';' ORDER BY first, sat) AS sensors,
   string_agg(strftime(first, '%Y-%m-%d_%H:%M:%S'), ';' ORDER BY first, sat) AS time_include
  FROM (SELECT cluster, sat, min(ts) AS first, max(ts) AS last, sum(frp) AS frp, arg_min(x, (ts, hs_id)) AS px, arg_min(y, (ts, hs_id)) AS py,
    min((ts, hs_id)) AS o FROM hsc GROUP BY cluster, sat) GROUP BY cluster"""
)


def contour_previous(spark, sf):
    """Each observation with the contour before it and the front-speed sentinel.

    An event has one row per day here, so the window stays as short as its life.
    """
    w = Window.partitionBy("cluster").orderBy("day")
    b = S.boxes(spark, sf).withColumn("kind", kind_of_box())
    cur = F.struct("x0", "y0", "x1", "y1", "kind", "t1")
    o = b.withColumn("prev", F.lag(cur).over(w)).withColumn("cur", cur).withColumn("nr", F.row_number().over(w))
    same = (F.col("prev.x0") == F.col("x0")) & (F.col("prev.y0") == F.col("y0")) & (F.col("prev.x1") == F.col("x1")) & (F.col("prev.y1") == F.col("y1"))
    both = (F.col("prev.kind") == "Polygon") & (F.col("kind") == "Polygon")
    fros = F.when(F.col("prev").isNull() | ~both, F.lit(-999.0)).when(same, F.lit(0.0))
    parts = o.select("cluster", "day", "nr", fros.alias("fros"), F.posexplode(F.array("cur", "prev")).alias("part", "g"))
    return parts.where(F.col("g").isNotNull()).select(
        "cluster", "day", "nr", "part", "fros", (geom.box_area("g") / 1e4).alias("area_ha"), F.col("g.kind").alias("kind")
    )


Q["contour_previous"] = contour_previous
SQL["contour_previous"] = S.with_boxes(
    """SELECT cluster, day, nr, 0 AS part, fros, a AS area_ha, kind FROM o UNION ALL
  SELECT cluster, day, nr, 1, fros, pa, pk FROM o WHERE pa IS NOT NULL""",
    f"""b2 AS (SELECT *, {KIND} AS kind, (x1-x0)*(y1-y0)/1e4 AS a FROM boxes)""",
    """o AS (SELECT cluster, day, CAST(row_number() OVER w AS INTEGER) AS nr, a, kind, lag(a) OVER w AS pa, lag(kind) OVER w AS pk,
     CASE WHEN lag(a) OVER w IS NULL OR NOT (lag(kind) OVER w = 'Polygon' AND kind = 'Polygon') THEN -999e0
      WHEN lag(x0) OVER w = x0 AND lag(y0) OVER w = y0 AND lag(x1) OVER w = x1 AND lag(y1) OVER w = y1 THEN 0e0 END AS fros
     FROM b2 WINDOW w AS (PARTITION BY cluster ORDER BY day))""",
)


def live_events(spark, sf):
    """Number of events alive at the end of each day."""
    b = S.boxes(spark, sf)
    days = b.select("day").distinct().withColumnRenamed("day", "at")
    seen = b.select("cluster", "day", F.explode(F.sequence(F.col("day"), F.col("day") + F.expr("INTERVAL 2 DAYS"), F.expr("INTERVAL 1 DAY"))).alias("at"))
    return seen.select("cluster", "at").distinct().join(days, "at").groupBy("at").agg(F.count("*").alias("live"))


Q["live_events"] = live_events
SQL["live_events"] = S.with_boxes(
    """SELECT d.day AS at, count(DISTINCT cluster) AS live FROM (SELECT DISTINCT day FROM boxes) d JOIN boxes b
  ON b.day <= d.day AND b.day >= d.day - INTERVAL 2 DAYS GROUP BY d.day"""
)


def front_speed(spark, sf):
    """Front speed between the two last contours of each event, where the newer one holds the older."""
    w = Window.partitionBy("cluster").orderBy("day")
    b = S.boxes(spark, sf).withColumn("ring", geom.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    o = b.withColumn("kind", kind_of_box()).withColumn("prev", F.lag(F.struct("ring", "kind", "t1", "x0", "y0", "x1", "y1")).over(w))
    holds = (F.col("prev.x0") >= F.col("x0")) & (F.col("prev.y0") >= F.col("y0")) & (F.col("prev.x1") <= F.col("x1")) & (F.col("prev.y1") <= F.col("y1"))
    grown = o.where((F.col("kind") == "Polygon") & (F.col("prev.kind") == "Polygon") & holds)
    pair = F.struct("cluster", "day")
    r = grown.select(pair.alias("pair"), "ring", F.col("prev.ring").alias("old"), seconds_between(F.col("prev.t1"), F.col("t1")).alias("dt"))
    sides = O.polygon_edges(r, ["pair"], FS.OLDER, F.col("old")).unionByName(O.polygon_edges(r, ["pair"], FS.NEWER, F.col("ring")))
    found = FS.front_speed(sides, "pair", r, FRONT_TILE)
    return r.join(found, "pair", "left").select(
        "pair.cluster", "pair.day", F.coalesce("links", F.lit(0)).alias("links"), F.round("speed", 6).alias("fros"), F.round("speed_std", 6).alias("fros_std"),
        *(F.round(c, 2).alias(c) for c in ("fx", "fy", "tx", "ty")))


Q["front_speed"] = front_speed
# between nested boxes a link is free if its ends share no side of the newer box and the newer one lies beyond a side of the older one
SQL["front_speed"] = S.with_boxes(
    """SELECT g.cluster, g.day, coalesce(links, 0) AS links, fros, fros_std, fx, fy, tx, ty FROM g LEFT JOIN
   (SELECT cluster, day, count(*) AS links, round(avg(d/dt), 6) AS fros, round(stddev_pop(d/dt), 6) AS fros_std,
     round(avg(px), 2) AS fx, round(avg(py), 2) AS fy, round(avg(nx), 2) AS tx, round(avg(ny), 2) AS ty
    FROM (SELECT *, sqrt((nx-px)**2 + (ny-py)**2) AS d FROM n JOIN p USING (cluster, day)
     WHERE NOT ((nx = x0 AND px = x0) OR (nx = x1 AND px = x1) OR (ny = y0 AND py = y0) OR (ny = y1 AND py = y1))
      AND ((px = a0 AND nx < a0) OR (px = a1 AND nx > a1) OR (py = b0 AND ny < b0) OR (py = b1 AND ny > b1)))
    WHERE d > 0 AND d/dt <= 10 GROUP BY ALL) USING (cluster, day)""",
    f"""g AS (SELECT * FROM (SELECT cluster, day, x0, y0, x1, y1, {KIND} AS kind, lag({KIND}) OVER w AS pk, lag(x0) OVER w AS a0, lag(y0) OVER w AS b0,
     lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, (epoch_us(t1) - epoch_us(lag(t1) OVER w))/1e6 AS dt FROM boxes WINDOW w AS (PARTITION BY cluster ORDER BY day))
   WHERE kind = 'Polygon' AND pk = 'Polygon' AND a0 >= x0 AND b0 >= y0 AND a1 <= x1 AND b1 <= y1)""",
    """around AS (SELECT least(k, 5)/5e0 * (s = 0)::INT + (s = 1)::INT + (1 - k/5e0) * (s = 2)::INT AS u,
    k/5e0 * (s = 1)::INT + (s = 2)::INT + (1 - k/5e0) * (s = 3)::INT AS v FROM range(4) t(s), range(5) q(k))""",
    "n AS (SELECT cluster, day, x0, y0, x1, y1, a0, b0, a1, b1, dt, CASE u WHEN 1 THEN x1 ELSE x0 + (x1-x0)*u END AS nx, CASE v WHEN 1 THEN y1 ELSE y0 + (y1-y0)*v END AS ny FROM g, around)",
    "p AS (SELECT cluster, day, CASE u WHEN 1 THEN a1 ELSE a0 + (a1-a0)*u END AS px, CASE v WHEN 1 THEN b1 ELSE b0 + (b1-b0)*v END AS py FROM g, around)",
)


def geojson_features(spark, sf):
    """The active layer as GeoJSON features in longitude and latitude."""
    a = active_layer(spark, sf)

    def corner(x: str, y: str):
        lon, lat = laea_inverse(F.col(x), F.col(y))
        return F.struct(F.round(lon, 7).alias("x"), F.round(lat, 7).alias("y"))

    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    props = F.struct("cluster", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_at"), "frp", "kind")
    return a.select("cluster", geom.geojson_polygon(ring, props, z=0.0).alias("feature"))


Q["geojson_features"] = geojson_features


def _sub_events(spark, sf):
    """(hotspots with their sub-event, merges): lattice rows of a cluster; each joins the next lower one when both have been seen."""
    c = S.clustered(spark, sf).withColumn("event", F.col("cluster") * 1000 + ((F.col("y") - 2e6) / 1800).cast("long"))
    seen = c.groupBy("cluster", "event").agg(F.min("ts").alias("born"))
    lower = Window.partitionBy("cluster").orderBy("event")
    both = seen.withColumns({"son": F.lag("event").over(lower), "_b": F.lag("born").over(lower)}).where("son is not null")
    return c, both.select(F.col("event").alias("dad"), "son", F.greatest("born", "_b").alias("ts"))


def lineage_series(spark, sf):
    """Daily power and united ground of every owner: a sub-event counts for itself until it merges, then for its owner."""
    c, merges = _sub_events(spark, sf)
    tables = LN.jumps(merges)
    daily = c.groupBy("event", F.date_trunc("day", "ts").alias("tag")).agg(F.sum("frp").alias("frp"))
    power = LN.merged_series(daily, "event", "tag", tables)
    half = S.STEP / 2
    ring = geom.box_ring(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half)
    sites = c.select("event", F.date_trunc("day", "ts").alias("tag"), "x", "y").distinct()
    rings = LN.merged_shapes(O.polygon_edges(sites, ["event", "tag"], 0, ring), "event", "tag", tables, 20 * S.STEP)
    ground = rings.groupBy("owner", "tag").agg(F.round(F.sum("area"), 2).alias("area"))
    return power.join(ground, ["owner", "tag"]).select("owner", "tag", F.round("frp", 4).alias("frp"), "n_events", "area")


Q["lineage_series"] = lineage_series
FOREST = """sub AS MATERIALIZED (SELECT *, cluster * 1000 + CAST((y - 2e6)/1.8e3 AS BIGINT) AS event FROM hsc),
 merge AS MATERIALIZED (SELECT * FROM (SELECT event AS dad, lag(event) OVER w AS son, greatest(born, lag(born) OVER w) AS ts FROM
   (SELECT cluster, event, min(ts) AS born FROM sub GROUP BY ALL) WINDOW w AS (PARTITION BY cluster ORDER BY event)) WHERE son IS NOT NULL),
 walk(event, owner, since, steps) AS (SELECT DISTINCT event, event, TIMESTAMP '1900-01-01', 0 FROM sub
   UNION ALL SELECT w.event, m.son, greatest(w.since, m.ts), w.steps + 1 FROM walk w JOIN merge m ON m.dad = w.owner)"""
SQL["lineage_series"] = S.with_clusters(
    """SELECT owner, tag, round(sum(frp), 4) AS frp, count(DISTINCT event) AS n_events, count(DISTINCT (x, y)) * 324e4 AS area FROM
  (SELECT s.event, s.tag, s.frp, s.x, s.y, o.owner FROM (SELECT event, date_trunc('day', ts)::TIMESTAMP AS tag, frp, x, y FROM sub) s JOIN
   (SELECT d.event, d.tag, arg_max(w.owner, w.steps) AS owner FROM (SELECT DISTINCT event, date_trunc('day', ts)::TIMESTAMP AS tag FROM sub) d
     JOIN walk w ON w.event = d.event AND w.since <= d.tag GROUP BY ALL) o ON o.event = s.event AND o.tag = s.tag) GROUP BY owner, tag""",
    FOREST,
)


def lineage_events(spark, sf):
    """Every sub-event with its last owner, its son and the time it merged, and its dads as text."""
    c, merges = _sub_events(spark, sf)
    return LN.lineage(c, "event", LN.jumps(merges))


Q["lineage_events"] = lineage_events
SQL["lineage_events"] = S.with_clusters(
    """SELECT l.event, l.owner, m.son, m.ts AS merged, coalesce(d.dads, '') AS dads FROM (SELECT event, arg_max(owner, steps) AS owner FROM walk GROUP BY event) l
  LEFT JOIN merge m ON m.dad = l.event
  LEFT JOIN (SELECT son, string_agg(CAST(dad AS VARCHAR), ';' ORDER BY ts, dad) AS dads FROM merge GROUP BY son) d ON d.son = l.event""",
    FOREST,
)
