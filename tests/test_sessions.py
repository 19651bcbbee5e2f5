"""Visits by timers: against a plain loop, over a restart, with rows out of order and ticks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hotspark.streaming.sessions import advance, read_sessions, stream_sessions

SCHEMA = "ts timestamp, x double, y double, frp double"
HOUR = 3600
GAP, RETENTION = 5 * HOUR, 24 * HOUR
T0 = 1_704_067_200


def plain(rows):
    """(x, y, part, first, last, n, power) of every part of every visit, seconds from T0."""
    out, state = [], {}
    for t, x, y, f in sorted(rows):
        s = state.get((x, y))
        if s is None or t - s["last"] >= GAP:
            s = state[(x, y)] = {"start": t, "last": t, "parts": {}}
            out.append((x, y, s["parts"]))
        s["last"] = t
        s["parts"].setdefault((t - s["start"]) // RETENTION, []).append((t, f))
    return sorted((x, y, k, p[0][0], p[-1][0], len(p), round(sum(f for _, f in p), 6)) for x, y, parts in out for k, p in parts.items())


def made(n, seed):
    rng = np.random.default_rng(seed)
    return [(int(t), float(x), 0.0, float(f)) for t, x, f in zip(rng.integers(0, 100 * HOUR, n), rng.choice([0, 10, 20, 500], n), rng.integers(1, 9, n))]


def put(spark, folder, rows):
    df = spark.createDataFrame([(T0 + t, x, y, f) for t, x, y, f in rows], "t long, x double, y double, frp double")
    df.select(F.timestamp_seconds("t").alias("ts"), "x", "y", "frp").coalesce(1).write.mode("append").parquet(folder)


def read(spark, path):
    cols = ["x", "y", "part", F.unix_seconds("first_ts") - T0, F.unix_seconds("last_ts") - T0, "n", F.round("power", 6)]
    return sorted(tuple(r) for r in read_sessions(spark, path).select(*cols).collect())


def test_advance_in_steps_equals_a_plain_loop():
    for seed, cuts in ((1, 1), (2, 7), (3, 40), (4, 200)):
        rows = made(150, seed)
        d = pd.DataFrame([(x, y, t * 1_000_000, f) for t, x, y, f in rows], columns=["x", "y", "t", "power"])
        open_ = pd.DataFrame([], columns=["x", "y", "start", "first", "last", "part", "n", "power"]).astype({"x": float, "y": float, "power": float, **dict.fromkeys(["start", "first", "last", "part", "n"], "int64")})
        found, last = [], -1
        for now in [*np.linspace(0, 100 * HOUR, cuts).astype(int).tolist(), 1000 * HOUR]:
            step = d[(d["t"] > last * 1_000_000) & (d["t"] <= now * 1_000_000)]
            done, open_ = advance(open_, step, now * 1_000_000, GAP * 1_000_000, RETENTION * 1_000_000)
            found += [(r.x, r.y, r.part, r.first // 1_000_000, r.last // 1_000_000, r.n, round(r.power, 6)) for r in done.itertuples()]
            last = now
        assert len(open_) == 0 and sorted(found) == plain(rows)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "run")
    rows = sorted(made(120, 5))
    # pairs of neighbours change places between files: out of order, but within the lateness
    first, second = rows[:50] + rows[55:60], rows[50:55] + rows[60:]
    put(spark, folder, first)
    out = stream_sessions(spark, folder, SCHEMA, GAP, RETENTION, 100.0, lateness="30 hours", path=path)
    early = read(spark, out)
    put(spark, folder, second)
    put(spark, folder, [(900 * HOUR, None, None, None)])
    assert stream_sessions(spark, folder, SCHEMA, GAP, RETENTION, 100.0, lateness="30 hours", path=path) == out
    got = read(spark, out)
    assert got == plain(rows) and set(early) < set(got)
    # a row before the watermark is late and changes nothing
    put(spark, folder, [(1, 0.0, 0.0, 1.0), (2000 * HOUR, None, None, None)])
    stream_sessions(spark, folder, SCHEMA, GAP, RETENTION, 100.0, lateness="30 hours", path=path)
    assert read(spark, out) == got
