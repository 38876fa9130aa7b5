"""Training and prediction frames shared by the models.

A *fold* is one fit of one tag: the whole history, the training part of a holdout, a
cross-validation cutoff, or a search trial.  Models take

* ``train(tag, fold, ds, y, i, n)`` - ``i`` counts from the start, ``n`` is the training length,
* ``future(tag, fold, ds, i, n, ...)`` - ``i`` counts from the first step after training,

and return ``future`` with ``yhat`` and the fit's ``residual_std``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.models.ridge import SLICE_ROWS
from pulsegrid.operators.features import train_length
from pulsegrid.operators.joins import SeriesProfile, attach
from pulsegrid.operators.resample import future_grid

KEYS = ("tag", "fold")


def full_frames(positioned: DataFrame, steps: int, freq: str) -> tuple[DataFrame, DataFrame]:
    """Train on everything, predict ``steps`` grid points beyond the end."""
    train = positioned.select("tag", F.lit("full").alias("fold"), "ds", "y", "i", "n")
    future = future_grid(positioned, steps, freq)
    return train, future.select("tag", F.lit("full").alias("fold"), "ds", "i", "n")


def holdout_frames(
    positioned: DataFrame, test_size: float = 0.2, clamp: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Train on the first part of every tag, predict the rest, whose ``actual`` is kept."""
    split = positioned.withColumn("_train", train_length(F.col("n"), test_size, clamp))
    fold = F.lit("holdout").alias("fold")
    train = split.where(F.col("i") < F.col("_train"))
    test = split.where(F.col("i") >= F.col("_train"))
    return (
        train.select("tag", fold, "ds", "y", "i", F.col("_train").alias("n")),
        test.select(
            "tag", fold, "ds", (F.col("i") - F.col("_train")).alias("i"),
            F.col("_train").alias("n"), F.col("y").alias("actual"),
        ),
    )


def fit_size(train: DataFrame, size: SeriesProfile) -> SeriesProfile:
    """``size`` with the rows of the longest fit in place of the readings of the largest tag.

    Readings of a tag may be many for each grid point, but a fit has the grid points only.  Costs one
    narrow scan, and only if the readings would not be one slice.
    """
    if size.largest <= SLICE_ROWS:
        return size
    return replace(size, largest=train.agg(F.max("n")).first()[0] or 0)


def setting_keys(settings: DataFrame) -> list[str]:
    """The keys of a settings table: ``fold`` (a search trial), ``tag``, or both (a tag's own trials)."""
    return [k for k in KEYS if k in settings.columns]


def with_settings(frame: DataFrame, settings: DataFrame, size: SeriesProfile) -> DataFrame:
    """Join settings; those that differ by tag may be as many as the groups that ``size`` tells of."""
    keys = setting_keys(settings)
    if "tag" in keys:
        return attach(frame, settings, size, tuple(keys))
    return frame.join(F.broadcast(settings), "fold")
