"""Additive trend-and-seasonality regression (after Taylor & Letham, 2018).

A piecewise linear trend with evenly spaced changepoints plus Fourier series for day, week and
month, fitted as the most likely coefficients under normal priors and a Laplace prior on the changes
of slope, most of which it sets to exactly zero.  The interval widens with the changes that may yet
come.  All settings are columns, so one job can fit every tag under many settings at once.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import DAY, freq_us, to_us
from pulsegrid.models.frames import KEYS, fit_size, with_settings
from pulsegrid.models.ridge import clustered, dot, moments, optimality, solve
from pulsegrid.operators.joins import SeriesProfile, attach

# Name, period in days, Fourier order.
SEASONS = [("daily", 1.0, 4), ("weekly", 7.0, 3), ("monthly", 30.5, 8)]
TREND_PRIOR = 5.0


@dataclass(frozen=True)
class AdditiveConfig:
    seasonality_mode: str = "additive"
    changepoint_prior_scale: float = 0.1
    seasonality_prior_scale: float = 10.0
    n_changepoints: int = 6
    changepoint_range: float = 0.9
    daily_seasonality: str = "auto"  # "auto", "true" or "false"
    weekly_seasonality: str = "auto"
    interval_width: float = 0.90


def _settings(
    frame: DataFrame, config: AdditiveConfig, trials: DataFrame | None, size: SeriesProfile
) -> DataFrame:
    """Put the settings beside the rows: constants, those of the trial ``fold``, or of the tag."""
    if trials is not None:
        return with_settings(frame, trials, size)
    return frame.select("*", *[F.lit(v).alias(k) for k, v in asdict(config).items()])


def _season_flags(freq: str) -> dict[str, Column]:
    """Which seasonal terms a fit has: they need a span of two periods and a finer grid."""
    step = freq_us(freq) / DAY
    span = F.col("n") * step

    def choose(setting: str, days: float) -> Column:
        auto = (span >= 2 * days) & F.lit(step < days)
        return (F.col(setting) == "true") | ((F.col(setting) == "auto") & auto)

    return {
        "daily": choose("daily_seasonality", 1.0),
        "weekly": choose("weekly_seasonality", 7.0),
        "monthly": F.col("n") > F.greatest(F.lit(500), F.floor(F.col("n") * 0.3)),
    }


def _trend_terms(t: Column, changepoints: int) -> list[Column]:
    terms = [F.lit(1.0), t]
    for j in range(1, changepoints + 1):
        place = F.col("changepoint_range") * j / F.col("n_changepoints")
        active = F.lit(j) <= F.col("n_changepoints")
        terms.append(F.when(active, F.greatest(F.lit(0.0), t - place)).otherwise(0.0))
    return terms


def _season_terms(flags: dict[str, Column]) -> list[Column]:
    days = to_us(F.col("ds")) / float(DAY)
    terms = []
    for name, period, order in SEASONS:
        on = F.when(flags[name], 1.0).otherwise(0.0)
        for k in range(1, order + 1):
            angle = F.pmod(days, F.lit(period)) * (2 * math.pi * k / period)
            terms += [F.sin(angle) * on, F.cos(angle) * on]
    return terms


SEASONAL = 2 * sum(order for _, _, order in SEASONS)


def _penalty(changepoints: int) -> Column:
    """Precisions of the normal priors; changes of slope have none."""
    trend = F.lit(1.0 / TREND_PRIOR**2)
    season = 1.0 / (F.col("seasonality_prior_scale") * F.col("seasonality_prior_scale"))
    return F.array(trend, trend, *[F.lit(0.0)] * changepoints, *[season] * SEASONAL)


def _price(changepoints: int) -> Column:
    """Inverse scales of the Laplace priors on the changes of slope."""
    hinge = 1.0 / F.col("changepoint_prior_scale")
    return F.array(F.lit(0.0), F.lit(0.0), *[hinge] * changepoints, *[F.lit(0.0)] * SEASONAL)


def _change_size(changepoints: int) -> Column:
    """Sum of the absolute changes of slope of a fit."""
    changes = F.slice("coef", 3, changepoints)
    return F.aggregate(changes, F.lit(0.0), lambda total, change: total + F.abs(change))


def _position(frame: DataFrame, after_training: bool) -> Column:
    last = F.greatest(F.lit(1), F.col("n") - 1)
    return (F.col("i") + F.col("n")) / last if after_training else F.col("i") / last


@dataclass
class AdditiveFit:
    coefficients: DataFrame  # tag, fold, coef, noise, variance, center, scale, logged
    changepoints: int
    rows: DataFrame  # tag, fold, x, z: the design that was fitted
    priors: DataFrame  # tag, fold, penalty, price


def fit(
    train: DataFrame, size: SeriesProfile, freq: str,
    config: AdditiveConfig = AdditiveConfig(), trials: DataFrame | None = None,
    changepoints: int | None = None,
) -> AdditiveFit:
    changepoints = changepoints or config.n_changepoints
    rows = _settings(train, config, trials, size)
    # Multiplicative seasonality is additive in the logarithm; it needs positive values.
    ranges = rows.groupBy(*KEYS).agg(
        ((F.min("y") > 0) & (F.first("seasonality_mode") == "multiplicative")).alias("logged"),
        F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"),
        F.avg(F.when(F.col("y") > 0, F.ln("y"))).alias("_lm"),
        F.stddev_pop(F.when(F.col("y") > 0, F.ln("y"))).alias("_ls"),
        F.max(F.abs("y")).alias("_a"), F.max(F.abs(F.when(F.col("y") > 0, F.ln("y")))).alias("_la"),
        F.first(_penalty(changepoints)).alias("penalty"), F.first(_price(changepoints)).alias("price"),
    )
    spread = F.when(F.col("logged"), F.col("_ls")).otherwise(F.col("_s"))
    ranges = ranges.select(
        *KEYS, "logged", "penalty", "price", F.when(F.col("logged"), F.col("_la")).otherwise(F.col("_a")).alias("reach"),
        F.when(F.col("logged"), F.col("_lm")).otherwise(F.col("_m")).alias("center"),
        F.when(spread > 0, spread).otherwise(1.0).alias("scale"),
    )
    target = F.when(F.col("logged"), F.ln("y")).otherwise(F.col("y"))
    t = _position(train, False)
    design = _trend_terms(t, changepoints) + _season_terms(_season_flags(freq))
    # Changes of slope are priced in units of the largest absolute value, rows are in units of the deviation.
    unit = F.when(F.col("reach") > 0, F.col("reach") / F.col("scale")).otherwise(1.0)
    priors = ranges.select(*KEYS, "penalty", unit.alias("unit"), "price").select(
        *KEYS, "penalty", F.transform("price", lambda p: p / F.col("unit")).alias("price"),
    )
    ranges = ranges.drop("penalty", "price", "reach")
    prepared = attach(rows, ranges, size, KEYS).select(
        *KEYS, F.array(*design).alias("x"),
        ((target - F.col("center")) / F.col("scale")).alias("z"),
    )
    longest = fit_size(train, size).largest
    parts = moments(clustered(prepared, list(KEYS), longest), list(KEYS), largest=longest)
    solved = solve(attach(parts, priors, size, KEYS, rows_per_key=60), list(KEYS), price="price")
    return AdditiveFit(solved.join(ranges, list(KEYS)), changepoints, prepared, priors)


def predict(
    fitted: AdditiveFit, future: DataFrame, size: SeriesProfile, freq: str,
    config: AdditiveConfig = AdditiveConfig(), trials: DataFrame | None = None,
) -> DataFrame:
    t = _position(future, True)
    design = _trend_terms(t, fitted.changepoints) + _season_terms(_season_flags(freq))
    joined = attach(
        _settings(future, config, trials, size), fitted.coefficients, size, KEYS, rows_per_key=20
    )
    linear = dot(design, F.col("coef")) * F.col("scale") + F.col("center")
    # Changes of slope go on at the fitted rate and mean size; their sum over a time h has this variance.
    mean_change = _change_size(fitted.changepoints) / F.greatest(F.col("n_changepoints"), F.lit(1))
    beyond = t - 1.0
    drift = F.lit(2.0 / 3.0) * F.col("n_changepoints") * mean_change * mean_change * beyond * beyond * beyond
    noise = F.sqrt(F.col("noise") * F.col("noise") + F.greatest(drift, F.lit(0.0))) * F.col("scale")
    level = F.when(F.col("logged"), F.exp(linear)).otherwise(linear)
    return joined.select(
        *future.columns, level.alias("yhat"),
        F.when(F.col("logged"), noise * level).otherwise(noise).alias("residual_std"),
    )


def fit_predict(
    train: DataFrame, future: DataFrame, size: SeriesProfile, freq: str,
    config: AdditiveConfig = AdditiveConfig(), trials: DataFrame | None = None,
    changepoints: int | None = None,
) -> DataFrame:
    fitted = fit(train, size, freq, config, trials, changepoints)
    return predict(fitted, future, size, freq, config, trials)


def fit_optimality(fitted: AdditiveFit, size: SeriesProfile) -> DataFrame:
    """``(tag, fold, j, coef, residual)``: distance of each coefficient from its optimality condition."""
    told = fitted.coefficients.select(*KEYS, "coef", "variance").join(fitted.priors, list(KEYS))
    return optimality(fitted.rows, told, list(KEYS), size, "price")


def diagnostics(
    train: DataFrame, size: SeriesProfile, freq: str, config: AdditiveConfig = AdditiveConfig()
) -> DataFrame:
    """Trend strength, changepoints and seasonal components of every fit."""
    fitted = fit(train, size, freq, config)
    rows = attach(_settings(train, config, None, size), fitted.coefficients, size, KEYS, rows_per_key=20)
    terms = _trend_terms(_position(train, False), fitted.changepoints)
    trend = dot(terms, F.col("coef")) * F.col("scale")
    flags = _season_flags(freq)
    components = F.array_compact(F.array(*[F.when(flags[n], F.lit(n)) for n, _, _ in SEASONS]))
    last_place = F.floor((F.col("n") - 1) * config.changepoint_range)
    live = F.size(F.filter(F.slice("coef", 3, fitted.changepoints), lambda change: change != 0))
    return rows.select("*", trend.alias("trend"), components.alias("parts"), live.alias("live")).groupBy("tag").agg(
        F.first("n_changepoints").alias("num_changepoints"), F.first("live").alias("live_changepoints"),
        F.try_divide(F.max("trend") - F.min("trend"), F.stddev_samp("y")).alias("trend_strength"),
        F.max(F.when(F.col("i") <= last_place, F.col("ds"))).alias("last_changepoint"),
        F.first(F.array_join("parts", ",")).alias("seasonality_components"),
        F.first("changepoint_prior_scale").alias("changepoint_prior_scale"),
        F.first("seasonality_mode").alias("seasonality_mode"),
        F.first("interval_width").alias("interval_width"),
    )
