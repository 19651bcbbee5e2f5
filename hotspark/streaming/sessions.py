"""Visits of places as a stateful stream: they end by event-time timers, and the stream's checkpoint is all that is kept.

A visit of a place ends after a quiet time, and a long one is reported in parts of
the retention's length, counted from its first row. Places are grouped by tile, one
state a tile: rows that the watermark has not passed yet, and the open visits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hotspark.session import fresh_path

VISITS = "x double, y double, part long, first_ts timestamp, last_ts timestamp, n long, power double"
_WAITING = "x double, y double, t long, power double"
_OPEN = "x double, y double, start long, first long, last long, part long, n long, power double"
_COLS = ["x", "y", "start", "first", "last", "part", "n", "power"]
_NEVER = (1 << 63) - 1
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(open_: pd.DataFrame, rows: pd.DataFrame, now: int, gap: int, retention: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(finished parts, open visits) of some places after `rows` (x, y, t, power), when no later row is at or before `now`.

    All times are in microseconds. An open visit is laid before the rows of its place as
    if it were one row at its last time.
    """
    came = pd.DataFrame({"x": rows["x"], "y": rows["y"], "start": rows["t"], "first": rows["t"], "last": rows["t"], "part": -1, "n": 1, "power": rows["power"]})
    d = pd.concat([open_[_COLS], came[_COLS]], ignore_index=True)
    d["old"] = np.arange(len(d)) < len(open_)
    d = d.sort_values(["x", "y", "old", "last"], ascending=[True, True, False, True], kind="stable", ignore_index=True)
    place = (d["x"] != d["x"].shift()) | (d["y"] != d["y"].shift())
    d["visit"] = (place | (d["last"].diff() >= gap)).cumsum()
    d["start"] = d.groupby("visit")["start"].transform("first")
    d["part"] = d["part"].where(d["old"], (d["last"] - d["start"]) // retention)
    parts = d.groupby(["visit", "part"], as_index=False).agg(
        x=("x", "first"), y=("y", "first"), start=("start", "first"), first=("first", "min"), last=("last", "max"), n=("n", "sum"), power=("power", "sum"))
    final = parts["visit"] != parts["visit"].shift(-1)  # the part that a visit is in
    newest = (parts["x"] != parts["x"].shift(-1)) | (parts["y"] != parts["y"].shift(-1))
    going = final & newest & (parts["last"] + gap > now)
    full = going & (parts["start"] + (parts["part"] + 1) * retention <= now)
    done = parts[(~going | full) & (parts["n"] > 0)]
    kept = parts[going].copy()
    emptied = full[going]
    kept.loc[emptied, "part"] = (now - kept["start"]) // retention
    kept.loc[emptied, ["first", "n"]] = [_NEVER, 0]
    kept.loc[emptied, "power"] = 0.0
    return done[_COLS], kept[_COLS]


class Visits(StatefulProcessor):
    """State of a tile: rows ahead of the watermark, open visits, and one timer at the next time that something ends."""

    def __init__(self, gap: int, retention: int):
        self.gap, self.retention = gap * 1_000_000, retention * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [d[["x", "y", "t", "power"]] for d in rows]
        # the tick of a stream has no place
        if key[0] is None or key[1] is None or pd.isna(key[0]) or pd.isna(key[1]):
            return
        yield from self._settle(pd.concat(came), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _settle(self, came: pd.DataFrame | None, watermark: int) -> Iterator[pd.DataFrame]:
        now = watermark * 1000
        rows = pd.DataFrame(list(self.waiting.get()), columns=["x", "y", "t", "power"])
        rows = (rows if came is None else pd.concat([rows, came])).astype({"x": float, "y": float, "t": "int64", "power": float})
        ints = {c: "int64" for c in ("start", "first", "last", "part", "n")}
        open_ = pd.DataFrame(list(self.open.get()), columns=_COLS).astype({"x": float, "y": float, "power": float, **ints})
        ready = rows["t"] <= now
        done, kept = advance(open_, rows[ready], now, self.gap, self.retention)
        ahead = rows[~ready]
        for state, left in ((self.waiting, ahead), (self.open, kept)):
            state.clear()
            if len(left):
                state.put(list(left.astype(object).itertuples(index=False, name=None)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [ahead["t"], kept["last"] + self.gap, kept["start"] + (kept["part"] + 1) * self.retention]
        times = pd.concat(ends)
        if len(times):
            self.handle.registerTimer(-(-int(times.min()) // 1000))
        if len(done):
            yield pd.DataFrame({
                "x": done["x"], "y": done["y"], "part": done["part"], "first_ts": pd.to_datetime(done["first"], unit="us"),
                "last_ts": pd.to_datetime(done["last"], unit="us"), "n": done["n"], "power": done["power"]})


def stream_sessions(
    spark: SparkSession, folder: str, schema: str, gap: int, retention: int, tile: float, lateness: str = "20 minutes", files_per_batch: int = 1,
    path: str | None = None,
) -> str:
    """Follow a folder of files with (ts, x, y, frp) to its end, then stop; the path of the finished parts of visits.

    `gap` and `retention` are seconds. Rows later than the watermark are dropped by the
    stream; rows without a time, or without a place, open no visit, but a row with a time
    and no place moves the watermark (a tick). A place that goes on being seen stays open:
    what is not yet ended is in the state and comes out of a later run with the same
    `path`, which goes on where the checkpoint stands.
    """
    path = path or fresh_path(spark, "sessions")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withWatermark("ts", lateness)
    tiles = [F.floor(F.col(c) / tile).cast("long").alias(f"t{c}") for c in "xy"]
    rows = stream.select("ts", *tiles, "x", "y", F.unix_micros("ts").alias("t"), F.coalesce("frp", F.lit(0.0)).alias("power"))
    found = rows.groupBy("tx", "ty").transformWithStateInPandas(Visits(gap, retention), VISITS, "Append", "EventTime")
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # timers need it
    try:
        query = found.writeStream.format("parquet").option("path", f"{path}/visits").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return f"{path}/visits"


def read_sessions(spark: SparkSession, visits: str) -> DataFrame:
    return spark.read.schema(VISITS).parquet(visits)
