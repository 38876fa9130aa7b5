"""Series scans: raw ranges, grid aggregates and grid interpolation."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import DAY, floor_us, freq_us, from_us, to_us
from pulsegrid.operators.joins import SeriesProfile, attach, profile
from pulsegrid.operators.rate import last_timestamps

SLICE_BINS = 4096  # bins of a tag that one task puts in order
AGGREGATES = {"average": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def as_series(table: DataFrame, tag: str | Column, ts: str | Column, value: str | Column) -> DataFrame:
    """Normalise any table to ``(tag, ts, value)``; NaN becomes NULL."""
    def column(c):
        return F.col(c) if isinstance(c, str) else c

    number = column(value).cast("double")
    return table.select(
        column(tag).cast("string").alias("tag"),
        column(ts).cast("timestamp_ntz").alias("ts"),
        F.when(~F.isnan(number), number).alias("value"),
    )


def relative_time(text: str, as_of: dt.datetime) -> dt.datetime:
    """``now`` or ``{n}{unit}-ago`` (weeks, days, hours, minutes, seconds) before ``as_of``."""
    if text == "now":
        return as_of
    match = re.fullmatch(r"(\d+)([wdhms])-ago", text)
    if not match:
        raise ValueError(f"unknown time {text!r}")
    unit = {"w": "weeks", "d": "days", "h": "hours", "m": "minutes", "s": "seconds"}[match[2]]
    return as_of - dt.timedelta(**{unit: int(match[1])})


def scan_range(
    series: DataFrame,
    start: dt.datetime | str,
    end: dt.datetime | str,
    tags: list[str] | None = None,
) -> DataFrame:
    """Readings with ``start <= ts < end``, optionally of some tags; pushed down to the files."""
    picked = series.where(
        (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    )
    return picked if tags is None else picked.where(F.col("tag").isin(tags))


def scan_trailing(
    series: DataFrame, days: int, size: SeriesProfile | None = None,
    as_of: dt.datetime | str | None = None,
) -> DataFrame:
    """The last ``days`` days up to ``as_of``, or up to each tag's own last reading.

    A given ``as_of`` is a constant range that prunes files; without one each tag's end is looked up.
    """
    if as_of is not None:
        until = F.lit(as_of).cast("timestamp_ntz")
        since = from_us(to_us(until) - days * DAY)
        return series.where((F.col("ts") >= since) & (F.col("ts") <= until))
    ended = attach(series, last_timestamps(series), size or profile(series))
    return ended.where(to_us(F.col("ts")) >= to_us(F.col("end_ts")) - days * DAY).drop("end_ts")


def scan_aggregate(series: DataFrame, freq: str, how: str = "average") -> DataFrame:
    """One value per tag and grid bin, stamped with the bin's start; empty bins give no row."""
    bins = from_us(floor_us(to_us(F.col("ts")), freq_us(freq)))
    return (
        series.groupBy("tag", bins.alias("ts"))
        .agg(AGGREGATES[how]("value").cast("double").alias("value"))
    )


def scan_aggregates(series: DataFrame, freq: str) -> DataFrame:
    """All aggregates in one pass, a row for each in ``how``."""
    bins = from_us(floor_us(to_us(F.col("ts")), freq_us(freq)))
    wide = series.groupBy("tag", bins.alias("ts")).agg(
        *[f("value").cast("double").alias(how) for how, f in AGGREGATES.items()]
    )
    return wide.unpivot(["tag", "ts"], list(AGGREGATES), "how", "value")


def with_previous(bins: DataFrame, at: str, carried: list[str], width: int, slice_bins: int) -> DataFrame:
    """``bins`` with ``_prev``, the tag's bin before each one, as a struct of ``at`` and ``carried``.

    Time is cut into slices of ``slice_bins`` bins, which are put in order separately; the first bin
    of a slice gets the last one of the tag's slice before, from a table of one row per slice.  So
    no task orders more than a slice of a tag, however long or dense the tag is.
    """
    held = F.struct(at, *carried)
    sliced = bins.withColumn("_slice", F.floor(F.col(at) / (width * slice_bins)))
    ends = sliced.groupBy("tag", "_slice").agg(F.max_by(held, F.col(at)).alias("_end"))
    carry = ends.select(
        "tag", "_slice", F.lag("_end").over(Window.partitionBy("tag").orderBy("_slice")).alias("_carry")
    )
    inside = Window.partitionBy("tag", "_slice").orderBy(at)
    return (
        sliced.withColumn("_own", F.lag(held).over(inside)).join(carry, ["tag", "_slice"])
        .withColumn("_prev", F.coalesce("_own", "_carry")).drop("_own", "_carry", "_slice")
    )


def explode_grid(rows: DataFrame, first: Column, last: Column, width: int, slice_bins: int, name: str) -> DataFrame:
    """A row for each grid point from ``first`` to ``last``, by slices: no array is longer than a slice."""
    span = width * slice_bins
    part = F.explode(F.sequence(F.floor(first / span), F.floor(last / span)))
    cut = rows.where(first <= last).withColumn("_part", part)
    low = F.greatest(first, F.ceil(F.col("_part") * F.lit(span) / width) * width)
    high = F.least(last, (F.col("_part") + 1) * span - width)
    return cut.where(low <= high).withColumn(name, F.explode(F.sequence(low, high, F.lit(width)))).drop("_part")


def scan_interpolate(
    series: DataFrame, freq: str, step: bool | Column = False, slice_bins: int = SLICE_BINS
) -> DataFrame:
    """The value at every grid point between a tag's first and last reading, linearly interpolated.

    Step series (``step``) keep the previous value instead.  Readings are first reduced to the
    first and last one per bin, with partial aggregation; only these bins are put in order, slice
    by slice.  Each pair of consecutive non-empty bins then yields the grid points between its
    neighbouring readings.
    """
    width = freq_us(freq)
    us = to_us(F.col("ts"))
    edges = (
        series.where(F.col("value").isNotNull())
        .groupBy("tag", floor_us(us, width).alias("bin"))
        .agg(
            F.min(us).alias("first_us"), F.min_by("value", us).alias("first_value"),
            F.max(us).alias("last_us"), F.max_by("value", us).alias("last_value"),
            *([F.max(step).alias("_step")] if isinstance(step, Column) else []),
        )
    )
    paired = with_previous(edges, "bin", ["last_us", "last_value"], width, slice_bins)
    on_grid = F.col("first_us") == F.col("bin")
    start = F.when(F.col("_prev").isNotNull(), F.col("_prev.bin") + width).when(on_grid, F.col("bin"))
    ratio = (F.col("g") - F.col("_prev.last_us")) / (F.col("first_us") - F.col("_prev.last_us"))
    linear = F.col("_prev.last_value") + (F.col("first_value") - F.col("_prev.last_value")) * ratio
    held = F.col("_step") if isinstance(step, Column) else F.lit(step)
    value = F.when(F.col("first_us") == F.col("g"), F.col("first_value")).otherwise(
        F.when(held, F.col("_prev.last_value")).otherwise(linear)
    )
    points = explode_grid(paired, start, F.col("bin"), width, slice_bins, "g")
    return points.select("tag", from_us(F.col("g")).alias("ts"), value.alias("value"))
