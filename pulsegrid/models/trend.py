"""The damped trend as a model of its own: history statistics and nothing else."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.models.frames import KEYS
from pulsegrid.operators.joins import SeriesProfile, attach
from pulsegrid.operators.trend import RECENT_POINTS, history_stats, projected_trend


@dataclass(frozen=True)
class TrendConfig:
    recent_points: int = RECENT_POINTS
    trend_blend_weight: float = 0.0


def fit_predict(
    train: DataFrame, future: DataFrame, size: SeriesProfile, freq: str, config: TrendConfig = TrendConfig()
) -> DataFrame:
    stats = history_stats(train, KEYS, config.recent_points).drop("n")
    return attach(future, stats, size, KEYS).select(
        *future.columns, projected_trend().alias("yhat"), F.col("std").alias("residual_std")
    )
