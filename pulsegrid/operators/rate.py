"""Rates of change: least-squares slopes over trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import SECOND, to_us
from pulsegrid.operators.joins import SeriesProfile, attach, profile

PERIODS = (365, 180, 90, 60, 30, 14)
MIN_POINTS = 10
UNIT_SECONDS = {"per_day": 86_400.0, "per_hour": 3_600.0, "per_second": 1.0}
DAY_SECONDS = 86_400.0


def _unit(convert_to: str) -> float:
    if convert_to not in UNIT_SECONDS:
        raise ValueError(f"convert_to must be one of {', '.join(UNIT_SECONDS)}")
    return UNIT_SECONDS[convert_to]


def last_timestamps(series: DataFrame) -> DataFrame:
    return series.groupBy("tag").agg(F.max("ts").alias("end_ts"))


def from_end(series: DataFrame, size: SeriesProfile) -> DataFrame:
    """Readings with ``x``, their distance in seconds from the tag's last timestamp (<= 0).

    Measuring from the end keeps x small and the regression well conditioned.
    """
    ended = attach(series, last_timestamps(series), size)
    return ended.withColumn("x", (to_us(F.col("ts")) - to_us(F.col("end_ts"))) / float(SECOND))


def latest_value(series: DataFrame, size: SeriesProfile | None = None) -> DataFrame:
    """Each tag's value at its last timestamp; the smallest one should there be several."""
    size = size or profile(series)
    return from_end(series, size).where(F.col("x") == 0).groupBy("tag").agg(
        F.max("ts").alias("last_ts"), F.min("value").alias("last_value")
    )


def window_fits(
    series: DataFrame,
    size: SeriesProfile | None = None,
    periods: tuple[int, ...] = PERIODS,
    convert_to: str = "per_day",
    min_points: int = MIN_POINTS,
) -> DataFrame:
    """All trailing windows in one aggregation: one wide row per tag.

    For every period: ``slope_{d}d`` (NULL below ``min_points``), ``intercept_{d}d`` at the last
    timestamp, ``points_{d}d``.  Also ``last_ts`` and ``last_value``.
    """
    factor = _unit(convert_to)
    size = size or profile(series)
    x = F.col("x")
    outputs = [F.max("ts").alias("last_ts"), F.min(F.when(x == 0, F.col("value"))).alias("last_value")]
    for days in periods:
        y = F.when(x >= -days * DAY_SECONDS, F.col("value"))
        points = F.count(y)
        enough = points >= min_points
        outputs += [
            F.when(enough, F.regr_slope(y, x) * factor).alias(f"slope_{days}d"),
            F.when(enough, F.regr_intercept(y, x)).alias(f"intercept_{days}d"),
            points.alias(f"points_{days}d"),
        ]
    return from_end(series, size).groupBy("tag").agg(*outputs)


def rates_long(fits: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """``(tag, period, slope, note)``: a window that is too short has no slope, and says why."""
    entries = F.array(*[
        F.struct(
            F.lit(f"{d}d").alias("period"),
            F.col(f"slope_{d}d").alias("slope"),
            F.when(F.col(f"points_{d}d") < MIN_POINTS, F.lit(f"Not enough data for {d}-day window."))
            .alias("note"),
        )
        for d in periods
    ])
    return fits.select("tag", F.inline(entries))


def rate_lines(
    series: DataFrame, size: SeriesProfile, periods: tuple[int, ...] = (365, 180, 90, 60, 30)
) -> DataFrame:
    """The fitted line of every window, evaluated at the window's readings."""
    fits = window_fits(series, size, periods, "per_second")
    lines = F.array(*[
        F.struct(
            F.lit(d).alias("days"),
            F.col(f"slope_{d}d").alias("slope"),
            F.col(f"intercept_{d}d").alias("intercept"),
        )
        for d in periods
    ])
    per_tag = fits.select("tag", "last_ts", lines.alias("lines"))
    x = (to_us(F.col("ts")) - to_us(F.col("last_ts"))) / float(SECOND)
    placed = attach(series, per_tag, size, rows_per_key=len(periods)).withColumn("x", x)
    return (
        placed.select("tag", "ts", "value", "x", F.inline("lines"))
        .where((F.col("x") >= -F.col("days") * DAY_SECONDS) & F.col("slope").isNotNull())
        .select(
            "tag", F.concat(F.col("days"), F.lit("d")).alias("period"), "ts",
            (F.col("intercept") + F.col("slope") * F.col("x")).alias("fitted"),
        )
    )
