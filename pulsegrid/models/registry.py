"""The models by name, with one way to forecast and one way to evaluate for all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.models import additive, autoregressive, kernel, trees, trend
from pulsegrid.models.frames import full_frames, holdout_frames
from pulsegrid.operators.joins import SeriesProfile, attach
from pulsegrid.operators.trend import (
    floored_std, history_stats, horizon_blend, interval_width, projected_trend, soft_clip,
)


@dataclass(frozen=True)
class ModelSpec:
    name: str
    config: Any
    fit_predict: Callable[..., DataFrame] | None
    eval_mode: str = "full_horizon"


# In order of preference when scores tie.
MODELS: dict[str, ModelSpec] = {
    spec.name: spec
    for spec in [
        ModelSpec("boosted_trees", trees.BoostedConfig(), trees.fit_predict),
        ModelSpec("random_forest", trees.ForestConfig(), trees.fit_predict),
        ModelSpec("kernel", kernel.KernelConfig(), kernel.fit_predict),
        ModelSpec("autoregressive", autoregressive.AutoregressiveConfig(), None, "one_step"),
        ModelSpec("additive", additive.AdditiveConfig(), additive.fit_predict),
        ModelSpec("trend", trend.TrendConfig(), trend.fit_predict),
    ]
}


def spec_of(name: str) -> ModelSpec:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known are {', '.join(MODELS)}")
    return MODELS[name]


def _settings_of(name: str, settings: DataFrame | None) -> dict[str, Any]:
    """Arguments that give every tag its own settings."""
    if settings is None:
        return {}
    if name != "additive":
        return {"trials": settings}
    most = settings.agg(F.max("n_changepoints")).first()[0]
    return {"trials": settings, "changepoints": int(most or 0)}


def forecast(
    name: str, positioned: DataFrame, steps: int, freq: str, size: SeriesProfile,
    config: Any = None, label: str | None = None, settings: DataFrame | None = None,
) -> DataFrame:
    """``(tag, model, ds, i, yhat, lower, upper)``, ``steps`` rows per tag.

    The additive model brings its own interval.  The others are blended with the damped trend
    over the horizon, softly clipped to the historic range, and get a widening interval.
    """
    spec = spec_of(name)
    config = config or spec.config
    if spec.fit_predict is None:
        raw = autoregressive.forecast(positioned, steps, size, freq, config)
    else:
        train, future = full_frames(positioned, steps, freq)
        raw = spec.fit_predict(train, future, size, freq, config, **_settings_of(name, settings))
    model = F.lit(label or name).alias("model")
    if name == "additive":
        half = F.col("residual_std") * NormalDist().inv_cdf(0.5 + config.interval_width / 2)
        return raw.select(
            "tag", model, "ds", "i", "yhat",
            (F.col("yhat") - half).alias("lower"), (F.col("yhat") + half).alias("upper"),
        )
    recent = getattr(config, "recent_points", trend.RECENT_POINTS)
    stats = history_stats(positioned, recent_points=recent).drop("n")
    joined = attach(raw.select("tag", "ds", "i", "yhat", "residual_std"), stats, size)
    value = soft_clip(horizon_blend(F.col("yhat"), projected_trend(), config.trend_blend_weight, steps))
    half = interval_width(floored_std(F.col("residual_std"), F.col("std")), steps)
    return joined.select("tag", model, "ds", "i", value.alias("yhat"), half.alias("half")).select(
        "tag", "model", "ds", "i", "yhat",
        (F.col("yhat") - F.col("half")).alias("lower"), (F.col("yhat") + F.col("half")).alias("upper"),
    )


def holdout(
    name: str, positioned: DataFrame, freq: str, size: SeriesProfile,
    config: Any = None, label: str | None = None, test_size: float = 0.2,
    settings: DataFrame | None = None,
) -> DataFrame:
    """``(tag, model, ds, actual, predicted, residual, absolute_error)`` on the last part of each tag."""
    spec = spec_of(name)
    config = config or spec.config
    if spec.fit_predict is None:
        rows = autoregressive.holdout(positioned, size, freq, config)
    else:
        train, future = holdout_frames(positioned, test_size)
        found = spec.fit_predict(train, future, size, freq, config, **_settings_of(name, settings))
        rows = found.withColumnRenamed("yhat", "predicted")
    residual = F.col("actual") - F.col("predicted")
    return rows.select(
        "tag", F.lit(label or name).alias("model"), "ds", "actual", "predicted",
        residual.alias("residual"), F.abs(residual).alias("absolute_error"),
    )
