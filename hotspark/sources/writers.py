"""Writers: snapshots, logs, layers and report tables.

Partitioned writers ask for a rebalance by the partition column first: a large
partition is then split over several tasks and a small one is not scattered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hotspark.functions import geom

# Fixed value: what a missing number is written as.
NODATA = -999
OPTIONAL = {"ABS_LINE": "int", "ABS_SAMP": "int", "LONGITUDE_PARALLAX": "double", "LATITUDE_PARALLAX": "double"}
# Older spellings dropped before writing.
OBSOLETE = ["ABS_line", "ABS_samp"]


def _same_name(df: DataFrame, name: str) -> bool:
    return name in df.columns


def fill_optional(df: DataFrame) -> DataFrame:
    """Obsolete columns out; the optional ones present, NULL as -999, cast."""
    old = [c for c in OBSOLETE if _same_name(df, c)]
    out = df.select([F.col(f"`{c}`") for c in df.columns if c not in old])
    for name, kind in OPTIONAL.items():
        have = F.col(name) if _same_name(df, name) else F.lit(None).cast(kind)
        out = out.withColumn(name, F.coalesce(have.cast(kind), F.lit(NODATA).cast(kind)))
    return out


def _partitioned(df: DataFrame, path: str, column: str, mode: str) -> None:
    balanced = df.hint("rebalance", column)
    balanced.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


#: Rows of a file in folders of text files.
ROWS_PER_FILE = 2_000_000


def write_hotspots(df: DataFrame, path: str, column: str = "snapshot_ts") -> None:
    """Hotspot snapshot (fire or static); writing a snapshot again replaces it."""
    _partitioned(fill_optional(df), path, column, "overwrite")


def write_state(df: DataFrame, path: str, column: str = "snapshot_ts") -> None:
    """Event state of a snapshot; only the snapshots at hand are replaced."""
    _partitioned(df, path, column, "overwrite")


def write_merges(df: DataFrame, path: str, batch: str = "0") -> None:
    """Merges of a batch; a batch that is written again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_slot_log(df: DataFrame, path: str, batch: str = "0") -> None:
    """Log rows of a batch, as write_merges."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{path}/batch={batch}")


def write_series(df: DataFrame, path: str, keys: list[str], order: str) -> None:
    """(timestamp, frp, fros) rows as JSON lines, each event's rows together and in order.

    Range partitions instead of one file per event: with many events the files stay
    large, and an event of any length may span files.
    """
    df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).write.mode("overwrite").json(path)


def write_weekly(weekly: DataFrame, values: DataFrame, path: str) -> None:
    """Weekly table as CSV, and the values behind it as rows."""
    weekly.write.mode("overwrite").option("header", True).csv(f"{path}/weekly")
    values.hint("rebalance", "year", "week").write.mode("overwrite").partitionBy("year", "week").parquet(f"{path}/values")


def write_geojson(df: DataFrame, path: str, ring: str, properties: Column, z: float | None = None, holes: str | None = None) -> None:
    """One GeoJSON feature per line; `holes` names a column with an array of rings."""
    df.select(geom.geojson_polygon(F.col(ring), properties, z, F.col(holes) if holes else None).alias("value")).write.mode("overwrite").text(path)


def write_raster(df: DataFrame, path: str, column: str = "day") -> None:
    """Grid rows (time, i, j, value), partitioned by time."""
    _partitioned(df, path, column, "overwrite")


def write_event_power(df: DataFrame, path: str) -> None:
    """Power series of one event, sorted by time."""
    df.select("timestamp", "FRP").orderBy("timestamp").write.mode("overwrite").option("header", True).csv(path)


def write_hourly(df: DataFrame, path: str) -> None:
    """Archive rows to the hourly layout: acq_date=/acq_hour= with padded times."""
    padded = df.withColumn("acq_time", F.lpad(F.col("acq_time").cast("int").cast("string"), 4, "0")).withColumn(
        "acq_hour", F.concat(F.substring("acq_time", 1, 2), F.lit("00"))
    )
    # the engine splits crowded folders, and files end after so many rows
    balanced = padded.hint("rebalance", "acq_date", "acq_hour")
    balanced.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("acq_date", "acq_hour").csv(path)


def write_boundaries(df: DataFrame, path: str) -> None:
    keep = [c for c in ("name_en_clean", "admin_level", "boundary", "source_pbf", "ring") if c in df.columns]
    df.select(*keep).write.mode("overwrite").parquet(path)
