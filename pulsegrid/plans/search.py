"""Hyper-parameter search: seeded random trials, scored on a time-ordered validation part.

All trials of a model are fitted in one job, a trial being one more key beside the tag.
"""

from __future__ import annotations

import math
import random
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.score import error_metrics
from pulsegrid.models import additive, kernel, trees
from pulsegrid.models.frames import fit_size, holdout_frames
from pulsegrid.operators.ensemble import union
from pulsegrid.operators.features import train_length
from pulsegrid.operators.joins import SeriesProfile
from pulsegrid.session import stage

# The search space of each model.  A tuple is (low, high, kind), a list a choice.
SPACES = {
    "boosted_trees": {
        "n_estimators": (100, 1000, "int50"), "max_depth": (2, 10, "int"),
        "learning_rate": (0.005, 0.3, "log"), "subsample": (0.5, 1.0, "float"),
        "colsample_bytree": (0.5, 1.0, "float"), "min_child_weight": (1, 10, "int"),
    },
    "random_forest": {
        "n_estimators": (100, 1000, "int50"), "max_depth": (4, 24, "int"),
        "min_samples_leaf": (1, 6, "int"), "max_features": (0.4, 1.0, "float"),
        "bootstrap": [True, False],
    },
    "kernel": {
        "kernel": ["rbf", "linear", "poly"], "degree": (2, 4, "int"), "c": (0.1, 100.0, "log"), "epsilon": (1e-4, 1.0, "log"),
        "gamma": [0.5, 1.0, 2.0],
    },
    "additive": {
        "changepoint_prior_scale": (0.001, 0.5, "log"),
        "seasonality_prior_scale": (0.01, 10.0, "log"),
        "seasonality_mode": ["additive", "multiplicative"],
        "n_changepoints": (3, 25, "int"), "changepoint_range": (0.7, 0.95, "float"),
        "daily_seasonality": ["true", "false", "auto"], "weekly_seasonality": ["true", "false", "auto"],
    },
}
METRICS = ("rmse", "mae", "mape")
TREE_CONFIGS = {"boosted_trees": trees.BoostedConfig(), "random_forest": trees.ForestConfig()}


def sample_trials(model: str, trials: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """``trials`` settings drawn from the model's space."""
    rng = random.Random(seed)

    def draw(bounds):
        if isinstance(bounds, list):
            return rng.choice(bounds)
        low, high, kind = bounds
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        if kind == "float":
            return rng.uniform(low, high)
        step = int(kind[3:] or 1)
        return low + step * rng.randint(0, (high - low) // step)

    return [{k: draw(b) for k, b in (space or SPACES[model]).items()} for _ in range(trials)]


def trial_table(spark: SparkSession, model: str, settings: list[dict]) -> DataFrame:
    """The settings as a table keyed by ``fold``; as many rows as there are trials."""
    fixed = {"interval_width": 0.9} if model == "additive" else {}
    rows = [{"fold": f"{k:04d}"} | s | fixed for k, s in enumerate(settings)]
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], names)


def fit_trials(
    model: str, train: DataFrame, test: DataFrame, freq: str, size: SeriesProfile, trials: DataFrame, space: dict,
) -> DataFrame:
    """Fit and predict frames that have one ``fold`` per trial, with the settings table ``trials``."""
    if model == "additive":
        if "interval_width" not in trials.columns:
            trials = trials.withColumn("interval_width", F.lit(0.9))
        top = space["n_changepoints"][1]
        return additive.fit_predict(train, test, size, freq, trials=trials, changepoints=top)
    if model == "kernel":
        return kernel.fit_predict(train, test, size, freq, trials=trials)
    return trees.fit_predict(train, test, size, freq, TREE_CONFIGS[model], trials)


def _validated(model, positioned, freq, size, settings, space) -> DataFrame:
    train, test = holdout_frames(positioned, clamp=True)
    trials = trial_table(positioned.sparkSession, model, settings)
    folds = F.explode(F.array(*[F.lit(f"{k:04d}") for k in range(len(settings))]))
    train, test = train.withColumn("fold", folds), test.withColumn("fold", folds)
    return fit_trials(model, train, test, freq, size.with_groups(len(settings)), trials, space)


def search(
    model: str, positioned: DataFrame, freq: str, size: SeriesProfile, trials: int = 50,
    metric: str = "rmse", seed: int = 42, space: dict | None = None,
) -> DataFrame:
    """Score of every trial for every tag, best first by ``place``; failed fits come last."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    settings = sample_trials(model, trials, seed, space)
    size = fit_size(positioned, size)
    predicted = _validated(model, positioned, freq, size, settings, space or SPACES[model])
    scores = predicted.groupBy("tag", "fold").agg(*error_metrics(F.col("actual"), F.col("yhat")))
    value = F.col(metric)
    loss = F.when(value.isNull() | F.isnan(value), float("inf")).otherwise(value)
    order = Window.partitionBy("tag").orderBy("loss", "fold")
    texts = positioned.sparkSession.createDataFrame(
        [(f"{k:04d}", str(dict(sorted(s.items())))) for k, s in enumerate(settings)], "fold string, params string"
    )
    return (
        scores.withColumn("loss", loss).withColumn("place", F.row_number().over(order))
        .join(F.broadcast(texts), "fold")
        .select("tag", F.lit(model).alias("model"), "fold", "place", "mae", "rmse", "mape", "loss", "params")
    )


def best_params(results: DataFrame) -> DataFrame:
    return results.where(F.col("place") == 1)


def searchable(positioned: DataFrame, test_size: float = 0.2) -> DataFrame:
    """The part of every tag that a search may use: what comes before the rows that score the winner."""
    return positioned.withColumn("n", train_length(F.col("n"), test_size)).where("i < n")


def tune(
    model: str, positioned: DataFrame, freq: str, size: SeriesProfile, trials: int,
    metric: str = "rmse", seed: int = 42,
) -> tuple[Any, DataFrame | None]:
    """The searched ``(config, settings)`` of a model; models without a space keep their defaults.

    Trials are fitted and validated within the training part of the holdout, so the rows on which the
    winner is scored play no part in choosing it.  Every tag gets its own best trial, as a settings table.
    """
    if model not in SPACES:
        return None, None
    results = stage(search(model, searchable(positioned), freq, size, trials, metric, seed), "search")
    table = trial_table(positioned.sparkSession, model, sample_trials(model, trials, seed))
    winners = best_params(results).select("tag", "fold")
    return None, stage(winners.join(F.broadcast(table), "fold").drop("fold"), "settings")
