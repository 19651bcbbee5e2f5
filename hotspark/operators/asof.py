"""Time joins: newest at or before, strictly before, and nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hotspark.operators.episodes import micros
from hotspark.session import materialize

#: Most time ranges that both sides are cut into; the borders are a list of as many numbers.
MOST_PARTS = 4096
_LAST = (1 << 63) - 1


def _borders(times: DataFrame, parts: int) -> list[int]:
    """Times that cut all rows into `parts` equal ranges; a time that fills several ranges stands there several times."""
    cuts = F.percentile_approx("_t", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))
    return (times.agg(cuts.alias("b")).first()["b"] or []) if parts > 1 else []


def _below(borders: list[int], t: Column, equal: bool) -> Column:
    """How many borders lie before a time (`equal`: or at it), by halving."""
    steps = len(borders).bit_length()
    padded = F.lit(borders + [_LAST] * ((1 << steps) - len(borders)))

    def half(at: Column, step: Column) -> Column:
        border = F.get(padded, (at + step - 1).cast("int"))
        return F.when((border < t) | (F.lit(equal) & (border == t) & (border < _LAST)), at + step).otherwise(at)

    return F.aggregate(F.lit([1 << k for k in reversed(range(steps))]), F.lit(0), half) if steps else F.lit(0)


def _carried(left: DataFrame, right: DataFrame, keys: list[str], strict: bool, parts: int | None) -> DataFrame:
    """Rows of `left` (keys, _t, _l) with `_r`, the newest (row, at) of `right` (keys, _t, _r) before them.

    Both sides are cut at the same times, so a key and range is one piece of work and
    left rows are moved and sorted once. The last right row before a range comes in as a
    row of the range; there is one for each key and range, whatever the number of rows.
    A time that is a border several times has several ranges: its left rows are spread
    over them by hash, and its right row stands in the first (strict: the last), so each
    of them still finds what it must.
    """
    spark = left.sparkSession
    parts = min(parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_PARTS)
    borders = _borders(left.select("_t").unionByName(right.select("_t")), parts)
    lo, hi = _below(borders, F.col("_t"), False), _below(borders, F.col("_t"), True)
    ranged = left.withColumns({"_lo": lo, "_hi": hi})
    plain = [F.col(f"_l.`{f.name}`") for f in left.schema["_l"].dataType.fields if f.dataType.typeName() not in ("map", "variant")]
    spread = F.pmod(F.xxhash64(*plain), F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))).cast("int")
    at_border = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo") + 1 + spread).otherwise(F.col("_hi"))
    # rows without a time find nothing, and are dealt to ranges of their own
    timeless = -1 - F.pmod(F.xxhash64(*plain), F.lit(parts)).cast("int")
    probe = ranged.withColumn("_part", F.when(F.col("_t").isNull(), timeless).otherwise(at_border)).drop("_lo", "_hi")
    given = right.withColumn("_part", hi if strict else F.when(hi > lo, lo + 1).otherwise(hi))
    given = materialize(given, "asof-right")

    # at most one row for each key and range goes through this window
    newest = given.groupBy(*keys, "_part").agg(F.max_by("_r", "_t").alias("_r"))
    used = probe.where("_part >= 0").select(*keys, "_part").distinct().withColumn("_r", F.lit(None).cast(right.schema["_r"].dataType))
    ends = used.unionByName(newest).groupBy(*keys, "_part").agg(F.first("_r", ignorenulls=True).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(before).alias("_r")).where("_r is not null")

    none_l = F.lit(None).cast(left.schema["_l"].dataType)
    none_r = F.lit(None).cast(right.schema["_r"].dataType)
    # at equal times the right row comes first, unless it must be strictly before
    rows = probe.withColumns({"_r": none_r, "_turn": F.lit(1)})
    rows = rows.unionByName(given.withColumns({"_l": none_l, "_turn": F.lit(2 if strict else 0)}))
    rows = rows.unionByName(carry.withColumns({"_t": F.lit(None).cast("long"), "_l": none_l, "_turn": F.lit(-1)}))
    order = Window.partitionBy(*keys, "_part").orderBy(F.col("_t").asc_nulls_first(), "_turn").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_turn = 1")


def _sides(left: DataFrame, right: DataFrame, lt: Column, rt: Column, payload: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    probe = left.select(*keys, lt.alias("_t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"))
    given = right.select(*keys, rt.alias("_t"), F.struct(*payload).alias("row")).where("_t is not null")
    given = given.groupBy(*keys, "_t").agg(F.max("row").alias("row"))
    return probe, given.select(*keys, "_t", F.struct("row", F.col("_t").alias("at")).alias("_r"))


def asof(
    left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, payload: list[str], out: str, keys: list[str] | None = None,
    strict: bool = False, parts: int | None = None,
) -> DataFrame:
    """Left join with the newest right row at or before (or strictly before) each left time.

    `out` is a struct of the payload (`row`) and the right time in microseconds (`at`),
    null where there is none. Of right rows with equal keys and time the greatest payload
    counts; right rows without a time are nothing; null keys equal each other. Times are
    cut into `parts` ranges (by default four a shuffle partition), see `_carried`.
    """
    keys = keys or []
    probe, given = _sides(left, right, micros(F.col(left_ts)), micros(F.col(right_ts)), payload, keys)
    return _carried(probe, given, keys, strict, parts).select("_l.*", F.col("_r").alias(out))


def nearest_in_time(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, payload: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Left join with the right row nearest in time; on a tie the earlier one.

    Each right row first learns its successor (the same carry, backwards in time), so
    the left side is moved once. Left rows before all right rows take the first of them.
    """
    probe, given = _sides(left, right, micros(F.col(left_ts)), micros(F.col(right_ts)), payload, [])
    given = materialize(given, "asof-given")
    back = given.select((-F.col("_t")).alias("_t"), "_r")
    after = _carried(back.select("_t", F.struct("_r").alias("_l")), back, [], True, parts)
    linked = after.select((-F.col("_t")).alias("_t"), F.struct(F.col("_l._r").alias("own"), F.col("_r").alias("next")).alias("_r"))
    first = given.agg(F.min_by("_r", "_t").alias("_first"))
    found = _carried(probe, linked, [], False, parts).crossJoin(F.broadcast(first))  # `first` is one row
    own, following = F.col("_r.own"), F.when(F.col("_r").isNull(), F.col("_first")).otherwise(F.col("_r.next"))
    earlier = following.isNull() | (F.col("_t") - own["at"] <= following["at"] - F.col("_t"))
    pick = F.when(F.col("_t").isNotNull(), F.when(own.isNotNull() & earlier, own["row"]).otherwise(following["row"]))
    return found.select("_l.*", pick.alias(out))
