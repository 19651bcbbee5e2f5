"""Owners over time against walking up the merges one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspark.operators.lineage import jumps, lineage, merged_series, owner_at

MERGES = "dad long, son long, t long"


def table(spark, merges):
    return spark.createDataFrame(merges, MERGES).select("dad", "son", F.timestamp_seconds("t").alias("ts"))


def up(merges, event, time):
    first = {}
    for d, s, t in merges:
        if None not in (d, s, t) and d != s:
            first[d] = min(first.get(d, (t, s)), (t, s))
    while event in first and first[event][0] <= time:
        event = first[event][1]
    return event


def test_owner_at_every_time(spark):
    rng = np.random.default_rng(6)
    # a forest (sons are lower), one long chain whose times do not rise, repeated and broken rows
    merges = [(d, int(rng.integers(0, d)), int(rng.integers(1, 100))) for d in range(1, 120) if d % 7]
    merges += [(d, d - 1, int(rng.integers(1, 100))) for d in range(1001, 1100)]
    merges += [merges[3], (5, 2, 3), (9, 9, 1), (None, 1, 1), (1, None, 1), (7, 3, None)]
    tables = jumps(table(spark, merges))
    assert len(tables) == 7
    rows = [(int(e), int(t)) for e in [*range(0, 130, 3), *range(1000, 1100, 4)] for t in (0, 20, 60, 99)]
    df = spark.createDataFrame(rows, "e long, t long").withColumn("at", F.timestamp_seconds("t"))
    got = {(r["e"], r["t"]): r["owner"] for r in owner_at(df, "e", "at", tables).collect()}
    assert got == {(e, t): up(merges, e, t) for e, t in rows}


def test_lineage_rows_and_series(spark):
    merges = [(2, 1, 10), (3, 1, 5), (1, 0, 20), (5, 4, 7)]
    tables = jumps(table(spark, merges))
    events = spark.createDataFrame([(e,) for e in range(7)], "event long")
    got = {r["event"]: (r["owner"], r["son"], r["dads"]) for r in lineage(events, "event", tables).collect()}
    assert got == {0: (0, None, "1"), 1: (0, 0, "3;2"), 2: (0, 1, ""), 3: (0, 1, ""), 4: (4, None, "5"), 5: (4, 4, ""), 6: (6, None, "")}
    series = spark.createDataFrame([(e, t, 1.0) for e in (0, 1, 2, 3) for t in (4, 6, 12, 20)], "event long, t long, frp double")
    sums = merged_series(series.withColumn("tag", F.timestamp_seconds("t")).drop("t"), "event", "tag", tables)
    got = sorted((r["owner"], r["t"], r["frp"], r["n_events"]) for r in sums.select("*", F.unix_seconds("tag").alias("t")).collect())
    assert got == [(0, 4, 1.0, 1), (0, 6, 1.0, 1), (0, 12, 1.0, 1), (0, 20, 4.0, 4), (1, 4, 1.0, 1), (1, 6, 2.0, 2), (1, 12, 3.0, 3), (2, 4, 1.0, 1), (2, 6, 1.0, 1), (3, 4, 1.0, 1)]
    none = jumps(table(spark, merges).limit(0))
    assert none == [] and {r["owner"] for r in lineage(events, "event", none).collect()} == set(range(7))


def test_a_circle_is_an_error(spark):
    with pytest.raises(ValueError, match="circle"):
        jumps(table(spark, [(1, 2, 1), (2, 3, 1), (3, 1, 1), (8, 9, 1)]))
