"""Time parsing, flooring and formatting as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SLOT_FORMAT = "yyyy-MM-dd_HHmm"
# Seconds below this are counted from the slot, else digits yyyyMMddHHmmss.
SLOT_SECONDS_LIMIT = 600


def polar_time(acq_date: Column, acq_time: Column) -> Column:
    """Date text plus HHMM without leading zeros."""
    hhmm = F.lpad(acq_time.cast("int").cast("string"), 4, "0")
    return F.try_to_timestamp(F.concat_ws(" ", acq_date, hhmm), F.lit("yyyy-MM-dd HHmm"))


def packed_time(value: Column, slot: Column) -> Column:
    """Seconds after the slot, or packed digits; anything unreadable is NULL."""
    secs = F.timestamp_micros(F.unix_micros(slot.cast("timestamp")) + F.round(value * 1e6).cast("long"))
    digits = F.lpad(value.cast("long").cast("string"), 14, "0")
    return F.when(value < SLOT_SECONDS_LIMIT, secs).otherwise(F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))


def floor_to(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds)


def slot_label(ts: Column) -> Column:
    return F.date_format(ts, SLOT_FORMAT)


def slot_from_name(name: Column) -> Column:
    """Slot time inside a file or folder name."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}_\d{4})", 1), F.lit(SLOT_FORMAT))


def doy_time(text: Column) -> Column:
    """YYYYDOY.HHMM inside a name."""
    return F.try_to_timestamp(F.regexp_extract(text, r"(\d{7}\.\d{4})", 1), F.lit("yyyyDDD.HHmm"))


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def lag_label(newest: Column, slot: Column) -> Column:
    """Signed hh:mm from the slot to its newest hotspot."""
    d = (F.unix_micros(newest.cast("timestamp")) - F.unix_micros(slot.cast("timestamp"))) / F.lit(1_000_000)
    secs = F.floor(F.abs(d)).cast("long")
    sign = F.when(d > 0, "+").otherwise("-")
    return F.format_string("%s %02d:%02d", sign, F.floor(secs / 3600).cast("long"), F.floor((secs % 3600) / 60).cast("long"))
