"""History statistics, damped trend projection, blending, clipping and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENT_POINTS = 7 * 24
DAMPING = 0.99
PADDING = 0.2
INTERVAL_Z = 1.96
STD_FLOOR = 0.1


def history_stats(
    positioned: DataFrame, keys: tuple[str, ...] = ("tag",), recent_points: int = RECENT_POINTS
) -> DataFrame:
    """Mean, population deviation, extremes and recent trend of each tag, in one aggregation.

    The trend is the slope per step over the last ``recent_points`` points, if there are more than
    that; it is anchored at the last value.
    """
    recent = F.when(F.col("i") >= F.col("n") - recent_points, F.col("y"))
    step = (F.col("i") - F.col("n")).cast("double")
    slope = F.when(F.max("n") > recent_points, F.regr_slope(recent, step)).otherwise(0.0)
    return positioned.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("std"),
        F.min("y").alias("min"),
        F.max("y").alias("max"),
        slope.alias("trend_slope"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("y"))).alias("trend_intercept"),
    )


def calendar_pattern(prepared: DataFrame, by: str = "hour") -> DataFrame:
    """Mean by hour of day (``hour``) or by weekday, Monday first (``weekday``)."""
    part = {"hour": F.hour, "weekday": F.weekday}[by]
    return prepared.groupBy("tag", part("ds").alias("slot")).agg(F.avg("y").alias("mean"))


def projected_trend(i: Column | None = None) -> Column:
    """The trend line pulled back to the mean, by one percent per step."""
    i = F.col("i") if i is None else i
    line = F.col("trend_intercept") + F.col("trend_slope") * (i + 1)
    return F.col("mean") + (line - F.col("mean")) * F.pow(F.lit(DAMPING), i)


def horizon_blend(model: Column, trend: Column, weight: float, steps: int, i: Column | None = None) -> Column:
    """Shift linearly from the model at the first step to ``weight`` of trend at the last."""
    i = F.col("i") if i is None else i
    share = i * F.lit(weight) / F.lit(float(max(1, steps - 1)))
    return (1.0 - share) * model + share * trend


def soft_clip(value: Column) -> Column:
    """Limit to the historic range plus a fifth of it on either side."""
    margin = (F.col("max") - F.col("min")) * PADDING
    return F.least(F.greatest(value, F.col("min") - margin), F.col("max") + margin)


def interval_width(residual_std: Column, steps: int, i: Column | None = None) -> Column:
    """Half width of the interval; it doubles over the horizon."""
    i = F.col("i") if i is None else i
    return INTERVAL_Z * residual_std * (1.0 + F.sqrt((i + 1) / F.lit(float(steps))))


def floored_std(residual_std: Column, std: Column) -> Column:
    return F.greatest(residual_std, std * STD_FLOOR)
