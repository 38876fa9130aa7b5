"""Time arithmetic on naive timestamps, as whole microseconds since 1970 (session zone UTC)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND
LAST_US = (2**63 - 1) // 1000

_UNITS = {"s": 1, "min": 60, "h": 3600, "d": 86_400}


def freq_us(freq: str) -> int:
    """Microseconds of a grid step such as ``1h``, ``30min``, ``15min``, ``1d``."""
    match = re.fullmatch(r"(\d*)(s|min|h|d)", freq.lower())
    if not match:
        raise ValueError(f"unknown frequency {freq!r}")
    return int(match.group(1) or 1) * _UNITS[match.group(2)] * SECOND


def steps_ahead(days: int, freq: str) -> int:
    """Number of grid steps in a horizon of ``days`` days."""
    return days * DAY // freq_us(freq)


def to_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_us(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_us(us: Column, step_us: int) -> Column:
    return us - F.pmod(us, F.lit(step_us))


def plus_days(ts: Column, days: Column) -> Column:
    """Add a fractional number of days; NULL beyond the year 2262, the end of 64-bit nanoseconds."""
    ahead = F.floor(F.when(F.abs(days) < LAST_US / DAY, days) * float(DAY)).cast("bigint")
    us = to_us(ts) + ahead
    return F.when(us <= LAST_US, from_us(us))


def calendar_features(ts: Column) -> list[Column]:
    """The fifteen calendar features of a timestamp; Monday is weekday 0."""
    hour = F.hour(ts).cast("double")
    weekday = F.weekday(ts).cast("double")
    day = F.dayofmonth(ts).cast("double")
    month = F.month(ts).cast("double")

    def cycle(position: Column, period: float, name: str) -> list[Column]:
        angle = position * F.lit(2 * math.pi) / F.lit(period)
        return [F.sin(angle).alias(f"sin_{name}"), F.cos(angle).alias(f"cos_{name}")]

    return [
        hour.alias("hour"), *cycle(hour, 24.0, "hour"),
        weekday.alias("day_of_week"), *cycle(weekday, 7.0, "dow"),
        *cycle(weekday * 24 + hour, 168.0, "week"),
        day.alias("day_of_month"), *cycle(day, 30.5, "month"),
        month.alias("month"), *cycle(month, 12.0, "year"),
        F.when(weekday >= 5, 1.0).otherwise(0.0).alias("is_weekend"),
    ]


CALENDAR_NAMES = [
    "hour", "sin_hour", "cos_hour", "day_of_week", "sin_dow", "cos_dow", "sin_week", "cos_week",
    "day_of_month", "sin_month", "cos_month", "month", "sin_year", "cos_year", "is_weekend",
]
