"""A recurrent model of the last 72 values, scaled to 0-1.

A window's values pass one after another through a fixed nonlinear recursion (an echo state, after
Jaeger, 2001), whose last state is read out, beside the values themselves, by ridge regression.  A
window starts from rest, so a row's state follows from its window alone: rows are reduced to
moments wherever they lie, and no tag is run through in one task.  Holdout predictions are one step
ahead and use the actual previous values; forecasts feed their own predictions back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import freq_us, from_us, to_us
from pulsegrid.models.ridge import _matrix, clustered, moments, predict_lifted, solve
from pulsegrid.operators.features import (
    holdout_split, lag_sequences, minmax_inverse, minmax_scale,
)
from pulsegrid.operators.joins import SeriesProfile, attach

REACH = 0.2  # how far a recursive prediction may leave the range 0-1


@dataclass(frozen=True)
class AutoregressiveConfig:
    lookback: int = 72
    penalty: float = 1.0
    units: int = 64
    memory: float = 0.9  # largest modulus of an eigenvalue of the recursion
    seed: int = 42
    test_size: float = 0.2
    trend_blend_weight: float = 0.3


def state_lift(config: AutoregressiveConfig):
    """``[1, the window, the state after the window]`` for a matrix of windows, oldest value first."""
    rng = np.random.default_rng(config.seed)
    within = rng.normal(size=(config.units, config.units))
    within *= config.memory / np.abs(np.linalg.eigvals(within)).max()
    entry, bias = rng.normal(0, 1.0, config.units), rng.uniform(-1.0, 1.0, config.units)

    def lift(x: np.ndarray, pdf=None) -> np.ndarray:
        state = np.zeros((len(x), config.units))
        for j in range(x.shape[1]):
            state = np.tanh((2.0 * x[:, j : j + 1] - 1.0) * entry + state @ within + bias)
        return np.hstack([np.ones((len(x), 1)), x, state])

    return lift


def _fit(sequences: DataFrame, size: SeriesProfile, config: AutoregressiveConfig) -> DataFrame:
    rows = clustered(sequences.select("tag", "x", F.col("scaled").alias("z")), ["tag"], size.largest)
    parts = moments(rows, ["tag"], state_lift(config), largest=size.largest)
    weights = F.array(F.lit(1e-6), *[F.lit(config.penalty)] * (config.lookback + config.units))
    return solve(parts.withColumn("penalty", weights), ["tag"])


def holdout(
    positioned: DataFrame, size: SeriesProfile, freq: str,
    config: AutoregressiveConfig = AutoregressiveConfig(),
) -> DataFrame:
    """One-step predictions of the last part of every tag; tags shorter than the lookback have none."""
    scaled = minmax_scale(holdout_split(positioned, config.test_size), size)
    sequences = lag_sequences(scaled, config.lookback, "scaled")
    fitted = _fit(sequences.where(~F.col("is_test")), size, config)
    keep = ["tag", "ds", "y", "y_min", "y_max"]
    scored = predict_lifted(sequences.where("is_test"), fitted, ["tag"], state_lift(config), keep, size)
    value = minmax_inverse(F.col("score"), F.col("y_min"), F.col("y_max"))
    return scored.select("tag", "ds", F.col("y").alias("actual"), value.alias("predicted"))


def forecast(
    positioned: DataFrame, steps: int, size: SeriesProfile, freq: str,
    config: AutoregressiveConfig = AutoregressiveConfig(),
) -> DataFrame:
    """Recursive forecast from the last ``lookback`` values: one row of state per tag.

    Predictions that are fed back stay within the training range and ``REACH`` of its width beyond.
    """
    whole = positioned.withColumn("is_test", F.lit(False))
    scaled = minmax_scale(whole, size)
    fitted = _fit(lag_sequences(scaled, config.lookback, "scaled"), size, config)
    tail = (
        scaled.where(F.col("i") >= F.col("n") - config.lookback)
        .groupBy("tag", "y_min", "y_max")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("i", "scaled"))), lambda s: s["scaled"]
            ).alias("x"),
            F.max(to_us(F.col("ds"))).alias("last_us"),
        )
        .where(F.size("x") == config.lookback)
    )
    state = tail.join(fitted, "tag")
    schema = "tag string, y_min double, y_max double, noise double, last_us bigint, path array<double>"

    def extend(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            window, coef, lift = _matrix(pdf["x"]), _matrix(pdf["coef"]), state_lift(config)
            path = np.empty((len(pdf), steps))
            for step in range(steps):
                value = np.einsum("ij,ij->i", lift(window), coef)
                path[:, step] = np.clip(value, -REACH, 1.0 + REACH)
                window = np.hstack([window[:, 1:], path[:, step : step + 1]])
            pdf["path"] = list(path)
            yield pdf[["tag", "y_min", "y_max", "noise", "last_us", "path"]]

    width = freq_us(freq)
    return (
        state.mapInPandas(extend, schema)
        .select("*", F.posexplode("path").alias("i", "scaled"))
        .select(
            "tag", from_us(F.col("last_us") + (F.col("i") + 1) * width).alias("ds"),
            F.col("i").cast("bigint").alias("i"),
            minmax_inverse(F.col("scaled"), F.col("y_min"), F.col("y_max")).alias("yhat"),
            (F.col("noise") * (F.col("y_max") - F.col("y_min"))).alias("residual_std"),
        )
    )
