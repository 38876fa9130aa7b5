"""Model evaluation: metrics, scores, comparison, ranges and rolling-origin folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.score import category, colour, composite_score, error_metrics, nmse
from pulsegrid.operators import origins
from pulsegrid.operators.joins import SeriesProfile, attach
from pulsegrid.session import stage


def forecast_metrics(holdout: DataFrame, keys: tuple[str, ...] = ("tag", "model")) -> DataFrame:
    return holdout.groupBy(*keys).agg(*error_metrics(F.col("actual"), F.col("predicted")))


def data_std(clean: DataFrame) -> DataFrame:
    return clean.groupBy("tag").agg(F.stddev_samp("value").alias("data_std"))


def scored(metrics: DataFrame, spreads: DataFrame, size: SeriesProfile) -> DataFrame:
    """Metrics with the composite score, its category and colour, and the normalised error."""
    joined = attach(metrics, spreads, size)
    score = composite_score(F.col("mape"), F.col("rmse"), F.col("mae"), F.col("data_std"))
    return joined.withColumn("score", score).select(
        *metrics.columns, "data_std",
        nmse(F.col("rmse"), F.coalesce(F.col("data_std"), F.lit(0.0))).alias("nmse"),
        "score", category(F.col("score")).alias("category"), colour(F.col("score")).alias("color"),
    )


def model_comparison(scores: DataFrame) -> DataFrame:
    """One row per tag and model that could be evaluated, with display rounding."""
    return scores.where(F.col("mae").isNotNull()).select(
        "tag", "model",
        F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"),
        F.round(F.col("mape") * 100, 3).alias("mape_percent"),
        F.round("nmse", 4).alias("nmse"), F.round("score", 1).alias("score"),
        F.col("category").alias("performance"),
    )


def best_model(scores: DataFrame, order: list[str]) -> DataFrame:
    """The best-scored model of each tag; a missing score counts as 0, ties follow ``order``."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    points = F.coalesce(F.when(F.col("mape").isNotNull(), F.col("score")), F.lit(0.0))
    first = Window.partitionBy("tag").orderBy(F.desc("_points"), "_rank")
    return (
        scores.select("*", points.alias("_points"), rank.alias("_rank"))
        .withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") == 1)
        .select(*scores.columns)
    )


def forecast_summary(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("tag", "model").agg(
        F.min("yhat").alias("forecast_min"), F.max("yhat").alias("forecast_max"),
        F.avg("yhat").alias("forecast_mean"),
        (F.avg(F.col("upper") - F.col("lower")) / 2).alias("half_width"),
    )


def series_range(values: DataFrame, padding: float = 0.10) -> DataFrame:
    """Extremes of ``value`` per tag with padding on both sides."""
    room = (F.col("v_max") - F.col("v_min")) * padding
    return values.groupBy("tag").agg(F.min("value").alias("v_min"), F.max("value").alias("v_max")).select(
        "tag", "v_min", "v_max",
        (F.col("v_min") - room).alias("range_min"), (F.col("v_max") + room).alias("range_max"),
    )


def parity_range(holdout: DataFrame, padding: float = 0.05) -> DataFrame:
    """Common range of actual and predicted values; a flat range is opened by 5 % or 1."""
    low = F.least(F.min("actual"), F.min("predicted"))
    high = F.greatest(F.max("actual"), F.max("predicted"))
    room = (F.col("v_max") - F.col("v_min")) * padding
    opened = F.when(room == 0, F.greatest(F.abs(F.col("v_max")) * padding, F.lit(1.0))).otherwise(room)
    return holdout.groupBy("tag", "model").agg(low.alias("v_min"), high.alias("v_max")).select(
        "tag", "model", "v_min", "v_max",
        (F.col("v_min") - opened).alias("range_min"), (F.col("v_max") + opened).alias("range_max"),
    )


def cv_frames(
    positioned: DataFrame, freq: str, size: SeriesProfile, initial_days: int = 30,
    period_days: int = 7, horizon_days: int = 7,
) -> tuple[DataFrame, DataFrame, SeriesProfile]:
    """Training and test frames of the rolling-origin folds, and the profile of their groups.

    ``fold`` is the cutoff's timestamp.  For models that must see the rows of each fold: a row is copied into
    every later fold.  Models that are fitted from sums need no copies; see ``origins``.
    """
    spacing = origins.Origins(initial_days, period_days, horizon_days)
    ends = stage(origins.fold_ends(positioned, spacing), "ends")
    train = origins.fold_trains(positioned, ends, freq, size, spacing)
    test = origins.fold_tests(positioned, ends, freq, size, spacing)
    return train, test, size.with_groups(origins.fold_count(ends))


def cv_metrics(predictions: DataFrame, z: float = 1.6448536269514722) -> DataFrame:
    """Mean and deviation over the folds of each error metric, and the coverage of the interval."""
    half = F.col("residual_std") * z
    covered = F.abs(F.col("actual") - F.col("yhat")) <= half
    per_fold = predictions.groupBy("tag", "fold").agg(
        *error_metrics(F.col("actual"), F.col("yhat")),
        F.avg(covered.cast("double")).alias("coverage"),
    )
    return per_fold.groupBy("tag").agg(
        F.count("*").alias("folds"),
        *[f(m).alias(f"{m}_{n}") for m in ("mae", "rmse", "mape")
          for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
        F.avg("coverage").alias("coverage"),
    )
