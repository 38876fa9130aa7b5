"""Rolling-origin evaluation that reads every row once, however many folds there are.

Cutoffs of a tag are evenly spaced, so the folds that a row belongs to are arithmetic.  A row is training
data of all later folds; it is counted once, in the segment between two cutoffs, and running sums over the
segments give the moments of every fold.  Only test rows are copied, as often as horizons overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.score import MAPE_EPSILON
from pulsegrid.functions.timeops import DAY, freq_us, from_us, to_us
from pulsegrid.operators.joins import SeriesProfile, attach
from pulsegrid.operators.trend import RECENT_POINTS, projected_trend
from pulsegrid.session import stage

Z90 = 1.6448536269514722


@dataclass(frozen=True)
class Origins:
    """Spacing of the folds: first training period, distance of cutoffs, and length of a test part."""

    initial_days: int = 30
    period_days: int = 7
    horizon_days: int = 7

    @property
    def period(self) -> int:
        return self.period_days * DAY

    @property
    def horizon(self) -> int:
        return self.horizon_days * DAY


def fold_ends(positioned: DataFrame, origins: Origins) -> DataFrame:
    """``(tag, lo, hi, latest, last_fold, origin)`` of tags that are long enough for a fold.

    Fold 0 has the latest cutoff, ``latest``; fold ``last_fold`` the earliest.  ``origin`` is the mean value.
    """
    us = to_us(F.col("ds"))
    ends = positioned.groupBy("tag").agg(F.min(us).alias("lo"), F.max(us).alias("hi"), F.avg("y").alias("origin"))
    ends = ends.withColumn("latest", F.col("hi") - origins.horizon)
    room = F.col("latest") - F.col("lo") - origins.initial_days * DAY
    return ends.where(room >= 0).withColumn("last_fold", F.floor(room / origins.period))


def fold_count(ends: DataFrame) -> int:
    """The most folds that a tag has."""
    return (ends.agg(F.max("last_fold")).first()[0] or 0) + 1


def _cutoff(k: Column, origins: Origins) -> Column:
    return F.col("latest") - k * origins.period


def _fold_name(k: Column, origins: Origins) -> Column:
    return F.date_format(from_us(_cutoff(k, origins)), "yyyy-MM-dd HH:mm:ss")


def _length(k: Column, origins: Origins, freq: str) -> Column:
    return (F.floor((_cutoff(k, origins) - F.col("lo")) / freq_us(freq)) + 1).cast("bigint")


def fold_tests(positioned: DataFrame, ends: DataFrame, freq: str, size: SeriesProfile, origins: Origins) -> DataFrame:
    """``(tag, fold, ds, i, n, actual)``: the rows behind each cutoff, up to the horizon."""
    us = to_us(F.col("ds"))
    rows = attach(positioned.select("tag", "ds", "y", "i"), ends, size)
    first = F.greatest(F.lit(0), F.floor((F.col("latest") - us) / origins.period) + 1)
    last = F.least(F.col("last_fold"), F.floor((F.col("hi") - us) / origins.period))
    folds = F.when(first <= last, F.sequence(first, last))
    placed = rows.withColumn("k", F.explode(folds)).withColumn("n", _length(F.col("k"), origins, freq))
    return placed.select(
        "tag", _fold_name(F.col("k"), origins).alias("fold"), "ds", (F.col("i") - F.col("n")).alias("i"), "n",
        F.col("y").alias("actual"),
    )


def fold_trains(positioned: DataFrame, ends: DataFrame, freq: str, size: SeriesProfile, origins: Origins) -> DataFrame:
    """``(tag, fold, ds, y, i, n)``: the rows up to each cutoff, once for every fold that trains on them."""
    rows = attach(positioned.select("tag", "ds", "y", "i"), ends, size)
    last = F.least(F.col("last_fold"), F.floor((F.col("latest") - to_us(F.col("ds"))) / origins.period))
    folds = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last))
    placed = rows.withColumn("k", F.explode(folds))
    return placed.select(
        "tag", _fold_name(F.col("k"), origins).alias("fold"), "ds", "y", "i", _length(F.col("k"), origins, freq).alias("n"),
    )


def trend_states(
    positioned: DataFrame, ends: DataFrame, freq: str, size: SeriesProfile, origins: Origins,
    recent_points: int = RECENT_POINTS,
) -> DataFrame:
    """``(tag, fold, n, mean, std, trend_slope, trend_intercept)`` of the training part of every fold.

    A row is counted in the segment told by two numbers: the earliest fold that trains on it, and the
    earliest fold whose recent window begins behind it.  Sums from the far end over the first give the fold's
    moments; what sums over the second give is taken off for the recent window.  Values count from the
    tag's mean.  Equals ``history_stats`` of each fold's rows.
    """
    us, width = to_us(F.col("ds")), freq_us(freq)
    rows = attach(positioned.select("tag", "ds", "y", "i"), ends, size)
    trained = F.least(F.floor((F.col("latest") - us) / origins.period), F.col("last_fold"))
    passed = F.least(F.floor((F.col("latest") - us - recent_points * width) / origins.period), F.col("last_fold"))
    y = F.col("y") - F.col("origin")
    sums = {"rows": F.lit(1), "sy": y, "syy": y * y, "siy": F.col("i") * y}
    segments = stage(
        rows.withColumn("trained", trained).withColumn("passed", passed).where("trained >= 0").groupBy("tag", "trained", "passed")
        .agg(*[F.sum(v).alias(c) for c, v in sums.items()], F.max(F.struct("i", "y")).alias("newest")), "segments",
    )
    folds = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_fold"))))
    later = Window.partitionBy("tag").orderBy(F.desc("k"))

    def running(by: str, mark: str) -> DataFrame:
        parts = segments.where(F.col(by) >= 0).groupBy("tag", F.col(by).alias("k")).agg(
            *[F.sum(c).alias(c) for c in sums], F.max("newest").alias("newest"),
        )
        every = folds.select("tag", "k").join(parts, ["tag", "k"], "left")
        return every.select("tag", "k", *[F.coalesce(F.sum(c).over(later), F.lit(0.0)).alias(mark + c) for c in sums],
                            F.max("newest").over(later).alias(mark + "newest"))

    told = folds.join(running("trained", ""), ["tag", "k"]).join(running("passed", "old_"), ["tag", "k"])
    n = _length(F.col("k"), origins, freq)
    m = float(recent_points)
    middle = n - (m + 1) / 2
    tilt = (F.col("siy") - F.col("old_siy")) - middle * (F.col("sy") - F.col("old_sy"))
    slope = F.when(n > recent_points, tilt / (m * (m * m - 1) / 12) if m > 1 else F.lit(None)).otherwise(0.0)
    mean = F.col("sy") / F.col("rows")
    spread = F.sqrt(F.greatest(F.col("syy") / F.col("rows") - mean * mean, F.lit(0.0)))
    return told.select(
        "tag", _fold_name(F.col("k"), origins).alias("fold"), n.alias("n"), (F.col("origin") + mean).alias("mean"),
        spread.alias("std"), slope.alias("trend_slope"), F.col("newest.y").alias("trend_intercept"),
    )


def trend_predictions(
    positioned: DataFrame, freq: str, size: SeriesProfile, origins: Origins = Origins(), recent_points: int = RECENT_POINTS,
) -> DataFrame:
    """``(tag, fold, ds, i, n, actual, yhat, residual_std)`` of the damped trend in every fold."""
    ends = stage(fold_ends(positioned, origins), "ends")
    states = trend_states(positioned, ends, freq, size, origins, recent_points).drop("n")
    tests = fold_tests(positioned, ends, freq, size, origins)
    joined = attach(tests, states, size, ("tag", "fold"), rows_per_key=fold_count(ends))
    return joined.select(*tests.columns, projected_trend().alias("yhat"), F.col("std").alias("residual_std"))


def horizon_errors(predictions: DataFrame, window: float = 0.1, z: float = Z90) -> DataFrame:
    """``(tag, i, points, mae, rmse, mape, coverage)``: errors at each step ahead, smoothed over near steps.

    A tag's residuals of all folds are put in order of their step ``i``.  Each step gets the mean over the
    last ``window`` share of them that ends with it; the earliest step of that window counts in part, so that
    it holds the same number everywhere.  Steps before a full window have no row.  Residuals are added up
    by step before anything is put in order, so a tag holds one row per step of the horizon.
    """
    error = F.col("yhat") - F.col("actual")
    told = predictions.where(error.isNotNull() & ~F.isnan(error))
    inside = (F.abs(error) <= F.col("residual_std") * z).cast("double")
    terms = {
        "mae": F.abs(error), "rmse": error * error, "coverage": inside,
        "mape": F.abs(error) / F.greatest(F.abs("actual"), F.lit(MAPE_EPSILON)),
    }
    steps = told.groupBy("tag", "i").agg(F.count("*").alias("points"), *[F.sum(v).alias(c) for c, v in terms.items()])
    every = Window.partitionBy("tag")
    upto = every.orderBy("i")
    steps = steps.select(
        "tag", "i", "points", *terms, F.sum("points").over(upto).alias("_n"), F.sum("points").over(every).alias("_all"),
        *[F.sum(c).over(upto).alias(f"_{c}") for c in terms],
    ).withColumn("_w", F.greatest(F.lit(1), F.floor(F.col("_all") * window)))
    marks = steps.groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("_n", "points", *terms, *[f"_{c}" for c in terms]))).alias("_marks"))
    started = steps.where(F.col("_n") >= F.col("_w")).withColumn("_from", F.col("_n") - F.col("_w")).join(marks, "tag")
    entered = started.withColumn("_at", F.get(F.filter("_marks", lambda s: s["_n"] > F.col("_from")), F.lit(0)))
    left_out = F.col("_from") - (F.col("_at._n") - F.col("_at.points"))

    def mean(c):
        before = F.col(f"_at._{c}") - F.col(f"_at.{c}") + left_out * F.col(f"_at.{c}") / F.col("_at.points")
        return (F.col(f"_{c}") - before) / F.col("_w")

    return entered.select(
        "tag", "i", "points", mean("mae").alias("mae"), F.sqrt(F.greatest(mean("rmse"), F.lit(0.0))).alias("rmse"),
        mean("mape").alias("mape"), mean("coverage").alias("coverage"),
    )


def horizon_summary(errors: DataFrame) -> DataFrame:
    """Mean and deviation of each error over the steps ahead, and the mean coverage."""
    return errors.groupBy("tag").agg(
        F.count("*").alias("steps"),
        *[f(m).alias(f"{m}_{n}") for m in ("mae", "rmse", "mape") for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
        F.avg("coverage").alias("coverage"),
    )
