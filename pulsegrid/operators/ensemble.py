"""Combining models: average of all, or the best one of each tag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.joins import SeriesProfile, attach

AVERAGE_NAME = "ensemble_average"


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def average_forecast(forecasts: DataFrame) -> DataFrame:
    """Mean of the models at each time; models without a value there are left out."""
    return forecasts.groupBy("tag", "ds").agg(
        *[F.avg(c).alias(c) for c in ("yhat", "lower", "upper")]
    ).select("tag", F.lit(AVERAGE_NAME).alias("model"), "ds", "yhat", "lower", "upper")


def average_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("mae").isNotNull()).groupBy("tag").agg(
        *[F.avg(c).alias(c) for c in ("mae", "rmse", "mape")]
    ).select("tag", F.lit(AVERAGE_NAME).alias("model"), "mae", "rmse", "mape")


def best_forecast(forecasts: DataFrame, winners: DataFrame, size: SeriesProfile) -> DataFrame:
    """The forecast rows of each tag's winning model."""
    chosen = winners.select("tag", F.col("model").alias("_best"))
    return attach(forecasts, chosen, size).where(F.col("model") == F.col("_best")).drop("_best")
