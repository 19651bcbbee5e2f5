"""Clusters: components, episodes, summaries, names, footprints, outlines, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotspark.functions.names import event_label, label_parts
from hotspark.operators import episodes, outline
from hotspark.operators.cluster import cluster_points
from hotspark.operators.footprint import cell_sizes, footprint, overlap_cells
from hotspark.operators.tiles import points_in_boxes, split_by_mask
from hotspark.plans import standins as S

Q, SQL = {}, {}

GAP = S.GAP_DAYS * 86400
SLOT = "2024-01-30"


def eps_clusters(spark, sf):
    """Cluster number of every distinct site."""
    return cluster_points(S.hotspots(spark, sf).select("x", "y").distinct(), S.EPS)


Q["eps_clusters"] = eps_clusters
SQL["eps_clusters"] = S.with_clusters("SELECT x, y, cluster FROM sites")


def gap_episodes(spark, sf):
    """Each hotspot with its cluster, episode and global event number."""
    parts = episodes.split_on_gaps(S.clustered(spark, sf), ["cluster"], "ts", GAP)
    numbered = episodes.number_groups(parts.select("hs_id", "cluster", "episode"), ["cluster", "episode"], "event_no")
    return numbered.select("hs_id", "cluster", "episode", "event_no")


Q["gap_episodes"] = gap_episodes
EPISODES = """ep AS (SELECT *, CAST(1 + sum(o) OVER (PARTITION BY cluster ORDER BY ts, hs_id) AS BIGINT) AS episode FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY cluster ORDER BY ts, hs_id) > INTERVAL 5 DAYS THEN 1 ELSE 0 END AS o FROM hsc))"""
SQL["gap_episodes"] = S.with_clusters(
    "SELECT hs_id, cluster, episode, dense_rank() OVER (ORDER BY cluster, episode) AS event_no FROM ep", EPISODES
)


def _summary(points: DataFrame) -> DataFrame:
    return episodes.summarize(points, GAP, F.lit(SLOT).cast("timestamp"))


def cluster_summary(spark, sf):
    s = _summary(S.clustered(spark, sf))
    return s.select(
        "cluster", "episode", "total_hotspots", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "start_time",
        "end_time", F.round("frp", 4).alias("frp"), F.round("duration_days", 6).alias("duration_days"),
    )


Q["cluster_summary"] = cluster_summary
SUMMARY = f"""summ AS (SELECT cluster, episode, count(*) AS total_hotspots, round(avg(x), 3) AS x, round(avg(y), 3) AS y,
  min(ts) AS start_time, max(ts) AS end_time, round(coalesce(sum(frp) FILTER (ts >= TIMESTAMP '{SLOT}'), 0), 4) AS frp,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6, 6) AS duration_days FROM ep GROUP BY cluster, episode)"""
SQL["cluster_summary"] = S.with_clusters("SELECT * FROM summ", EPISODES, SUMMARY)


def top10_power(spark, sf):
    """Flagship: mask, newest per location, clusters, episodes, names, top ten by power."""
    kept = split_by_mask(S.hotspots(spark, sf), S.masks(spark, sf), S.STEP, keep=True)
    newest = episodes.newest_per_location(kept)
    summary = episodes.summarize(cluster_points(newest, S.EPS), GAP, F.lit("2024-01-25").cast("timestamp"))
    top = summary.orderBy(F.desc(F.round("frp", 4)), "cluster", "episode").limit(10)
    named = points_in_boxes(
        top.select("cluster", "episode", "total_hotspots", "frp", "end_time", "start_time", "x", "y"),
        S.communes(spark, sf).select("name", "x0", "y0", "x1", "y1"), 36_000.0,
        (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1")),
    )
    label = event_label(F.col("name"), F.col("start_time"))
    return named.select(
        "cluster", "episode", "total_hotspots", F.round("frp", 4).alias("frp"), "end_time",
        label.alias("fire_name"), label_parts(label).alias("place_day"),
    )


Q["top10_power"] = top10_power
SQL["top10_power"] = S.with_clusters(
    """SELECT cluster, episode, total_hotspots, frp, end_time, 'fire_' || name || '_' || strftime(start_time, '%Y%m%d') AS fire_name,
   split_part(name, '_', 2) || ' ' || strftime(start_time, '%Y%m%d') AS place_day
  FROM top JOIN communes c ON top.y >= c.y0 AND top.y < c.y1""",
    S.COMMUNES,
    """ep AS (SELECT *, CAST(1 + sum(o) OVER (PARTITION BY cluster ORDER BY ts, hs_id) AS BIGINT) AS episode FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY cluster ORDER BY ts, hs_id) > INTERVAL 5 DAYS THEN 1 ELSE 0 END AS o FROM hsc))""",
    """top AS (SELECT cluster, episode, count(*) AS total_hotspots, avg(y) AS y, min(ts) AS start_time, max(ts) AS end_time,
   round(coalesce(sum(frp) FILTER (ts >= TIMESTAMP '2024-01-25'), 0), 4) AS frp
   FROM ep GROUP BY cluster, episode ORDER BY frp DESC, cluster, episode LIMIT 10)""",
).replace(
    S.HS,
    S.HS.replace("hs AS (", "hs0 AS (")
    + ",\n "
    + S.MASKS
    + """,
 hs AS MATERIALIZED (SELECT * FROM hs0 h WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE h.x BETWEEN m.x0 AND m.x1 AND h.y BETWEEN m.y0 AND m.y1)
   QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY ts DESC, hs_id DESC) = 1)""",
)


def ignition_points(spark, sf) -> DataFrame:
    """First hotspot of each cluster episode: where and when it began."""
    eps = episodes.split_on_gaps(S.clustered(spark, sf), ["cluster"], "ts", GAP)
    first = eps.groupBy("cluster", "episode").agg(F.min_by(F.struct("hs_id", "ts", "x", "y"), F.struct("ts", "hs_id")).alias("f"))
    return first.select("cluster", "episode", "f.*")


IGNITION = """ign AS (SELECT cluster, episode, hs_id, ts, x, y FROM ep
  QUALIFY row_number() OVER (PARTITION BY cluster, episode ORDER BY ts, hs_id) = 1)"""


def _commune_of(points: DataFrame, communes: DataFrame) -> DataFrame:
    """Left join of each point with the first commune that holds it."""
    hit = points_in_boxes(
        points, communes.select("commune_id", "name", "x0", "y0", "x1", "y1"), 36_000.0,
        (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1")),
    )
    first = hit.groupBy("cluster", "episode").agg(F.min(F.struct("commune_id", "name")).alias("c"))
    return points.join(first, ["cluster", "episode"], "left").withColumn("name", F.col("c.name")).drop("c")


def commune_join(spark, sf):
    return _commune_of(ignition_points(spark, sf), S.communes(spark, sf)).select("cluster", "episode", "hs_id", "name")


Q["commune_join"] = commune_join
_JOIN = "FROM ign LEFT JOIN communes c ON ign.y >= c.y0 AND ign.y < c.y1"
SQL["commune_join"] = S.with_clusters(
    f"SELECT cluster, episode, hs_id, name {_JOIN}", EPISODES, IGNITION, S.COMMUNES
)


def event_labels(spark, sf):
    """Labels of all events by the commune of their first point ('XX' where none holds it)."""
    j = _commune_of(ignition_points(spark, sf), S.communes(spark, sf))
    return j.select("cluster", "episode", event_label(F.col("name"), F.col("ts")).alias("fire_name"))


Q["event_label"] = event_labels
SQL["event_label"] = S.with_clusters(
    f"""SELECT cluster, episode, 'fire_' || coalesce(name, 'XX') || '_' || strftime(ign.ts, '%Y%m%d') AS fire_name
  {_JOIN}""", EPISODES, IGNITION, S.COMMUNES
)


def commune_counts(spark, sf):
    """Number of events that began in each commune (zero included)."""
    hits = _commune_of(ignition_points(spark, sf), S.communes(spark, sf)).groupBy("name").agg(F.count("*").alias("n"))
    every = S.communes(spark, sf).select("name")
    return every.join(hits, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("nbre_fire"))


Q["commune_counts"] = commune_counts
SQL["commune_counts"] = S.with_clusters(
    "SELECT c.name, count(ign.hs_id) AS nbre_fire FROM communes c LEFT JOIN ign ON ign.y >= c.y0 AND ign.y < c.y1 GROUP BY c.name",
    EPISODES, IGNITION, S.COMMUNES,
)


def cluster_footprint_cells(spark, sf):
    """Footprint of each cluster as lattice cells: count, area, outer edge length."""
    cells = footprint(S.clustered(spark, sf), ["cluster"], S.STEP, 3e6 - 900.0, 2e6 - 900.0)
    return cell_sizes(cells, ["cluster"], S.STEP)


Q["cluster_footprint_cells"] = cluster_footprint_cells
SQL["cluster_footprint_cells"] = S.with_clusters(
    """SELECT s.cluster, count(*) AS cells, count(*) * 1.8e3 * 1.8e3 / 1e4 AS area_ha,
  1.8e3 * (4 * count(*) - coalesce(any_value(k.n), 0)) AS perimeter_m
  FROM sites s LEFT JOIN (SELECT a.cluster, count(*) AS n FROM edges e JOIN pts p ON p.id = e.s JOIN sites a ON a.x = p.x AND a.y = p.y
    GROUP BY a.cluster) k ON k.cluster = s.cluster GROUP BY s.cluster"""
)


def cluster_outline(spark, sf):
    """Convex outline of each cluster, from partial hulls."""
    hulls = outline.convex_outline(S.clustered(spark, sf).select("cluster", "x", "y").distinct(), ["cluster"])
    return hulls.select("cluster", "n_points", "kind", F.round("area", 2).alias("area_m2"), F.to_json("ring").alias("ring"))


Q["cluster_outline"] = cluster_outline


def cluster_alpha_outline(spark, sf):
    """Tight outline (alpha shape) of each cluster: area, edge length, boundary edges."""
    shape = outline.alpha_outline(S.clustered(spark, sf).select("cluster", "x", "y").distinct(), ["cluster"], S.EPS)
    return shape.select("cluster", "n_points", "kind", F.round("area", 2).alias("area_m2"), F.round("length", 2).alias("length_m"), "edges", F.size("rings").alias("rings"))


Q["cluster_alpha_outline"] = cluster_alpha_outline


def _day_cells(spark, sf, day: str) -> DataFrame:
    d = S.clustered(spark, sf).where(F.to_date("ts") <= F.lit(day).cast("date")).where(
        F.to_date("ts") > F.date_sub(F.lit(day).cast("date"), 3)
    )
    return footprint(d, ["cluster"], S.STEP, 3e6 - 900.0, 2e6 - 900.0)


def event_match_cells(spark, sf):
    """Footprints of days 8-10 against those of days 9-11: share of the older one covered."""
    old = _day_cells(spark, sf, "2024-01-10").withColumnRenamed("cluster", "event")
    new = _day_cells(spark, sf, "2024-01-11")
    m = overlap_cells(new, "cluster", old, "event")
    return m.select(
        "cluster", "event", "shared", F.round("ratio", 6).alias("ratio"), (F.col("ratio") > 0.8).alias("matched")
    )


Q["event_match_cells"] = event_match_cells
SQL["event_match_cells"] = S.with_clusters(
    """SELECT n.cluster, o.cluster AS event, count(*) AS shared, round(count(*) / any_value(z.n), 6) AS ratio,
   count(*) / any_value(z.n) > 0.8e0 AS matched
  FROM nw n JOIN old o ON n.x = o.x AND n.y = o.y JOIN (SELECT cluster, count(*) AS n FROM old GROUP BY cluster) z ON z.cluster = o.cluster
  GROUP BY n.cluster, o.cluster""",
    "old AS (SELECT DISTINCT cluster, x, y FROM hsc WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-11')",
    "nw AS (SELECT DISTINCT cluster, x, y FROM hsc WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-12')",
)


def recent_hotspots_of_cluster(spark, sf):
    """Hotspots at the end time of their cluster, for clusters seen since the slot."""
    c = S.clustered(spark, sf)
    ends = c.groupBy("cluster").agg(F.max("ts").alias("end_time")).where(F.col("end_time") >= F.lit(SLOT).cast("timestamp"))
    rows = c.join(ends.withColumnRenamed("end_time", "ts"), ["cluster", "ts"]).select("cluster", "hs_id", "ts", "frp", "x", "y")
    return rows.orderBy("cluster", "ts", "hs_id")


Q["recent_hotspots_of_cluster"] = recent_hotspots_of_cluster
SQL["recent_hotspots_of_cluster"] = S.with_clusters(
    f"""SELECT cluster, hs_id, ts, frp, x, y FROM hsc
  QUALIFY ts = max(ts) OVER (PARTITION BY cluster) AND max(ts) OVER (PARTITION BY cluster) >= TIMESTAMP '{SLOT}'"""
)


def expired_purge(spark, sf):
    """Hotspots left after dropping those under the boxes of events idle for two days."""
    now = F.lit("2024-01-28").cast("timestamp")
    h = S.hotspots(spark, sf).where(F.col("ts") < now)
    b = S.boxes(spark, sf).where(F.col("day") < now)
    last = b.groupBy("cluster").agg(F.max("t1").alias("last")).where(F.col("last") < now - F.expr("INTERVAL 2 DAYS"))
    gone = b.join(last, "cluster", "left_semi").select("x0", "y0", "x1", "y1")
    kept = split_by_mask(h, gone, 4 * S.STEP, keep=True)
    return kept.where(F.col("ts") >= now - F.expr(f"INTERVAL {S.RETENTION_DAYS} DAYS")).select("hs_id", "x", "y", "ts")


Q["expired_purge"] = expired_purge
SQL["expired_purge"] = S.with_boxes(
    """SELECT hs_id, x, y, ts FROM hs h WHERE ts < TIMESTAMP '2024-01-28' AND ts >= TIMESTAMP '2024-01-18'
  AND NOT EXISTS (SELECT 1 FROM gone g WHERE h.x >= g.x0 AND h.x <= g.x1 AND h.y >= g.y0 AND h.y <= g.y1)""",
    """gone AS (SELECT x0, y0, x1, y1 FROM boxes WHERE day < TIMESTAMP '2024-01-28' AND cluster IN
    (SELECT cluster FROM boxes WHERE day < TIMESTAMP '2024-01-28' GROUP BY cluster HAVING max(t1) < TIMESTAMP '2024-01-26'))""",
)


def session_events(spark, sf):
    """Visits of each location: a session ends after a quiet time of five days."""
    w = F.session_window("ts", f"{S.GAP_DAYS} days")
    g = S.hotspots(spark, sf).groupBy("x", "y", w).agg(F.count("*").alias("n"), F.round(F.sum("frp"), 4).alias("frp"))
    return g.select("x", "y", F.col("session_window.start").alias("first_ts"), "n", "frp")


Q["session_events"] = session_events
SQL["session_events"] = S.with_hs(
    """SELECT x, y, min(ts) AS first_ts, count(*) AS n, round(sum(frp), 4) AS frp FROM
  (SELECT *, sum(o) OVER (PARTITION BY x, y ORDER BY ts, hs_id) AS s FROM
   (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY x, y ORDER BY ts, hs_id) >= INTERVAL 5 DAYS THEN 1 ELSE 0 END AS o FROM hs))
  GROUP BY x, y, s"""
)
