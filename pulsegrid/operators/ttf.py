"""Time to failure: when a forecast or a slope first reaches a sigma threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import DAY, SECOND, plus_days, to_us
from pulsegrid.operators.joins import SeriesProfile, attach

LEVELS = (1, 2, 3)
SLOPE_PERIODS = (14, 30, 60)
SLOPE_LEVEL = 5


def first_breach_wide(
    forecast: DataFrame, summary: DataFrame, size: SeriesProfile,
    keys: tuple[str, ...] = ("tag",), levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """Per key: ``pos_{k}`` / ``neg_{k}``, the first forecast time at or beyond each threshold."""
    names = [f"{side}{k}" for side in "pn" for k in levels]
    joined = attach(forecast, summary.select("tag", *names), size)
    return joined.groupBy(*keys).agg(
        *[F.min(F.when(F.col("yhat") >= F.col(f"p{k}"), F.col("ds"))).alias(f"pos_{k}") for k in levels],
        *[F.min(F.when(F.col("yhat") <= F.col(f"n{k}"), F.col("ds"))).alias(f"neg_{k}") for k in levels],
    )


def breaches_long(
    wide: DataFrame, keys: tuple[str, ...] = ("tag",), levels: tuple[int, ...] = LEVELS
) -> DataFrame:
    """``(keys, breach_type, predicted_ts)``; thresholds that are never reached keep a NULL row."""
    entries = [
        F.struct(F.lit(f"{word} {k}σ").alias("breach_type"), F.col(f"{side}_{k}").alias("predicted_ts"))
        for word, side in (("Positive", "pos"), ("Negative", "neg")) for k in levels
    ]
    return wide.select(*keys, F.inline(F.array(*entries)))


def _days_to(threshold: Column, slope: Column, upward: bool) -> Column:
    """Days until the line through the last value reaches the threshold, if it heads there."""
    days = (threshold - F.col("last_value")) / F.when(slope != 0, slope)
    heading = slope > 0 if upward else slope < 0
    return F.when(heading & (days > 0), days)


def slope_sides(
    fits: DataFrame, summary: DataFrame, size: SeriesProfile,
    periods: tuple[int, ...] = SLOPE_PERIODS,
) -> DataFrame:
    """``(tag, period, upper_ts, lower_ts)``: when each window's slope hits the 5-sigma thresholds."""
    upper, lower = F.col(f"p{SLOPE_LEVEL}"), F.col(f"n{SLOPE_LEVEL}")
    joined = attach(fits, summary.select("tag", f"p{SLOPE_LEVEL}", f"n{SLOPE_LEVEL}"), size)
    entries = [
        F.struct(
            F.lit(d).alias("period"),
            plus_days(F.col("last_ts"), _days_to(upper, F.col(f"slope_{d}d"), True)).alias("upper_ts"),
            plus_days(F.col("last_ts"), _days_to(lower, F.col(f"slope_{d}d"), False)).alias("lower_ts"),
        )
        for d in periods
    ]
    return joined.select("tag", F.inline(F.array(*entries)))


def slope_sides_long(sides: DataFrame) -> DataFrame:
    def entry(side: str, column: str) -> Column:
        label = F.concat(F.lit("TTF ROC "), F.col("period"), F.lit(f"d ({side} 5σ)"))
        return F.struct(label.alias("breach_type"), F.col(column).alias("predicted_ts"))

    return sides.select("tag", F.inline(F.array(entry("Upper", "upper_ts"), entry("Lower", "lower_ts"))))


def slope_ttf(sides: DataFrame) -> DataFrame:
    """The earlier of the two sides for each window."""
    return sides.select(
        "tag", F.concat(F.lit("TTF ROC "), F.col("period"), F.lit("d")).alias("breach_type"),
        F.least("upper_ts", "lower_ts").alias("predicted_ts"),
    )


def countdown(breaches: DataFrame, as_of: Column) -> DataFrame:
    """Text ``{d}d {h}h {m}m`` from ``as_of`` to each predicted breach."""
    seconds = F.floor((to_us(F.col("predicted_ts")) - to_us(as_of)) / SECOND)
    day = DAY // SECOND
    rest = F.pmod(seconds, F.lit(day))
    text = F.concat(
        F.floor(seconds / day).cast("string"), F.lit("d "),
        F.floor(rest / 3600).cast("string"), F.lit("h "),
        F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("string"), F.lit("m"),
    )
    return breaches.where(F.col("predicted_ts").isNotNull()).select(
        "tag", "breach_type", "predicted_ts",
        F.date_format("predicted_ts", "dd MMMM yyyy - HH:mm").alias("threshold_time"),
        text.alias("time_to_threshold"),
    )
