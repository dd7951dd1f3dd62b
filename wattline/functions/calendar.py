"""Calendar expressions. Weeks start on Monday = 0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS_PER_DAY = 96


def slot_of(ts: Column) -> Column:
    """Quarter hour of the day, 0..95."""
    return (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15)).cast("long")


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def weekday0(ts: Column) -> Column:
    return F.weekday(ts)


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 by the clock of the zone-less value, whatever the session's time zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def micros(ts: Column) -> Column:
    """The same in microseconds."""
    part = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long") % 1_000_000
    return seconds(ts) * 1_000_000 + part


def from_seconds(sec: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=sec)
