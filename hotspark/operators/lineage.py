"""Merge forests over time: who owns an event at a time, and what an owner's series is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotspark.operators import overlay as O
from hotspark.session import materialize


def jumps(merges: DataFrame) -> list[DataFrame]:
    """Jump tables (event, ancestor, since) of 1, 2, 4, ... merges, from (dad, son, ts).

    `since` is the latest time on the way: from then on the ancestor owns the event. Each
    table joins the one before with itself, so a chain of a million merges takes twenty
    rounds and no table has more rows than there are events. Of several merges of one
    event the earliest counts, then the lowest son; merges with a null or into oneself
    are left out. A circle of merges is an error.
    """
    first = merges.where("dad is not null and son is not null and ts is not null and dad <> son")
    first = first.groupBy(F.col("dad").alias("event")).agg(F.min(F.struct("ts", "son")).alias("m"))
    level = materialize(first.select("event", F.col("m.son").alias("ancestor"), F.col("m.ts").alias("since")), "jump")
    most = level.count().bit_length()
    out = []
    while not level.isEmpty():
        if len(out) > most:
            raise ValueError("merges run in a circle")
        out.append(level)
        on = level.select(F.col("event").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("since").alias("_since"))
        level = materialize(level.join(on, "ancestor").select("event", F.col("_next").alias("ancestor"), F.greatest("since", "_since").alias("since")), "jump")
    return out


def owner_at(rows: DataFrame, event: str, time: str, tables: list[DataFrame], out: str = "owner") -> DataFrame:
    """Rows with the event that owns theirs at their time (a null time: at the end of all merges).

    The farthest ancestor whose merges all happened by then, found by the longest jumps
    first; one join for each table, none of which multiplies rows.
    """
    found = rows.withColumn(out, F.col(event))
    for level in reversed(tables):
        step = level.select(F.col("event").alias("_event"), F.col("ancestor").alias("_up"), F.col("since").alias("_since"))
        by_then = found[time].isNull() | (step["_since"] <= found[time])
        found = found.join(step, (found[out] == step["_event"]) & by_then, "left")
        found = found.withColumn(out, F.coalesce("_up", out)).drop("_event", "_up", "_since")
    return found


def lineage(events: DataFrame, event: str, tables: list[DataFrame]) -> DataFrame:
    """(event, owner, son, merged, dads) of each event: last owner, whom it joined and when, and who joined it, as text.

    `dads` lists the direct ones by time, then id, with ';' between them.
    """
    ends = owner_at(events.select(event).distinct().withColumn("_at", F.lit(None).cast("timestamp")), event, "_at", tables).drop("_at")
    if not tables:
        return ends.select(event, "owner", F.lit(None).cast("long").alias("son"), F.lit(None).cast("timestamp").alias("merged"), F.lit("").alias("dads"))
    first = tables[0]
    sons = first.select(F.col("event").alias(event), F.col("ancestor").alias("son"), F.col("since").alias("merged"))
    listed = F.array_sort(F.collect_list(F.struct("since", "event")))
    dads = first.groupBy(F.col("ancestor").alias(event)).agg(F.array_join(F.transform(listed, lambda d: d.event.cast("string")), ";").alias("dads"))
    return ends.join(sons, event, "left").join(dads, event, "left").select(event, "owner", "son", "merged", F.coalesce("dads", F.lit("")).alias("dads"))


def merged_series(series: DataFrame, event: str, tag: str, tables: list[DataFrame]) -> DataFrame:
    """(owner, tag, frp, n_events) summed over the events that an owner has at a tag's time, from (event, tag, frp)."""
    owned = owner_at(series, event, tag, tables)
    return owned.groupBy("owner", tag).agg(F.sum("frp").alias("frp"), F.count_distinct(event).alias("n_events"))


def merged_shapes(edges: DataFrame, event: str, tag: str, tables: list[DataFrame], tile: float) -> DataFrame:
    """Rings of the united shapes of an owner's events at each tag; `edges` has (event, tag, layer, x0, y0, x1, y1)."""
    owned = owner_at(edges, event, tag, tables).drop(event)
    return O.overlay(owned, ["owner", tag], ["any"], tile)
