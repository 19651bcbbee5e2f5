"""Time episodes of a cluster, and cluster aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hotspark.operators.ranking import number_rows


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def _episode_of_bucket(buckets: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Number the episodes from per-bucket first and last times (_lo, _hi, micros).

    A bucket is as long as the gap, so no gap fits inside one; only the step from
    one used bucket to the next can open an episode. The window therefore sees one
    row per bucket, not the rows of the cluster.
    """
    w = Window.partitionBy(*keys).orderBy("bucket")
    opens = (F.col("_lo") - F.lag("_hi").over(w)) > F.lit(gap * 1_000_000)
    return buckets.withColumn("_open", F.when(opens, 1).otherwise(0)).withColumn(
        "episode", (F.sum("_open").over(w) + 1).cast("long")
    )


def split_on_gaps(df: DataFrame, keys: list[str], ts: str, gap: int) -> DataFrame:
    """Add `episode` (1, 2, ...): a new one starts after a pause longer than `gap` seconds."""
    tagged = df.withColumn("bucket", time_bucket(F.col(ts), gap))
    buckets = tagged.groupBy(*keys, "bucket").agg(F.min(micros(F.col(ts))).alias("_lo"), F.max(micros(F.col(ts))).alias("_hi"))
    numbered = _episode_of_bucket(buckets, keys, gap).select(*keys, "bucket", "episode")
    return tagged.join(numbered, [*keys, "bucket"]).drop("bucket")


def number_groups(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add a gap-free global number of the (sorted) key combination."""
    numbers = number_rows(df.select(*keys).distinct(), keys, out)
    return df.join(numbers, keys)


def summarize(points: DataFrame, gap: int, slot: Column) -> DataFrame:
    """One row per (cluster, episode): size, centre, times, power since `slot`, days.

    Rows collapse to one per (cluster, time bucket) before anything is ordered.
    """
    parts = (
        points.withColumn("bucket", time_bucket(F.col("ts"), gap))
        .groupBy("cluster", "bucket")
        .agg(
            F.count("*").alias("n"),
            F.sum("x").alias("sx"),
            F.sum("y").alias("sy"),
            F.min(micros(F.col("ts"))).alias("_lo"),
            F.max(micros(F.col("ts"))).alias("_hi"),
            F.sum(F.when(F.col("ts") >= slot, F.col("frp"))).alias("recent"),
        )
    )
    eps = _episode_of_bucket(parts, ["cluster"], gap)
    return eps.groupBy("cluster", "episode").agg(
        F.sum("n").alias("total_hotspots"),
        (F.sum("sx") / F.sum("n")).alias("x"),
        (F.sum("sy") / F.sum("n")).alias("y"),
        F.timestamp_micros(F.min("_lo")).alias("start_time"),
        F.timestamp_micros(F.max("_hi")).alias("end_time"),
        F.coalesce(F.sum("recent"), F.lit(0.0)).alias("frp"),
        ((F.max("_hi") - F.min("_lo")) / F.lit(86_400e6)).alias("duration_days"),
    )


def newest_per_location(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest row of each location; on equal times the higher id wins."""
    keys = keys or ["x", "y"]
    rest = [c for c in points.columns if c not in keys]
    best = points.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "hs_id")).alias("_b"))
    return best.select(*keys, "_b.*")
