"""Observation-window arithmetic on whole UTC seconds (plain column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN_2019 = 1_546_300_800  # 2019-01-01 00:00:00 UTC
STEP = 300


def unix_time(ts: Column) -> Column:
    """Whole seconds of a timestamp, with or without a time zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def parse_time(text: Column, pattern: str = "yyyy/MM/dd HH:mm:ss") -> Column:
    """Text to unix seconds; null where the text does not fit."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(pattern)))


def time_bin(t: Column, origin: int = ORIGIN_2019, step: int = STEP) -> Column:
    """Right-closed window number; the ten seconds up to the origin belong to window 0."""
    index = F.ceil((t - origin) / F.lit(step)) - 1
    return F.when(t > origin - 10, F.greatest(index, F.lit(0).cast("long")))


def bin_edge(index: Column, origin: int = ORIGIN_2019, step: int = STEP) -> Column:
    """Right edge of a window: the first second at which its features may be used."""
    return (index + 1) * step + origin


def elapsed_days(t: Column, origin: int = ORIGIN_2019) -> Column:
    return F.floor((t - origin) / F.lit(86_400))


def elapsed_hours(t: Column, origin: int = ORIGIN_2019) -> Column:
    return F.floor((t - origin) / F.lit(3_600))


def calendar_fields(t: Column) -> dict[str, Column]:
    ts = F.timestamp_seconds(t)
    return {
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
    }


def digitize(x: Column, step: int, limit: int) -> Column:
    """Slot of x among the edges 0, step, 2·step, … below ``limit``; 0 below the first edge."""
    edges = -(-limit // step)
    slot = F.floor(x / F.lit(step)) + 1
    return F.when(x < 0, F.lit(0).cast("long")).otherwise(F.least(slot, F.lit(edges).cast("long")))


def fixed_width_bin(x: Column, low: int, high: int, bins: int) -> Column:
    """``ceil(x / width)`` with a whole-number width; null for an impossible range."""
    width = int((high - low + 1) / bins) if bins else 0
    if low >= high or width == 0:
        return F.lit(None).cast("long")
    return F.ceil(x / F.lit(width))
