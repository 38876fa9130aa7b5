"""The whole analysis of all tags in one job."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import DAY, freq_us, steps_ahead
from pulsegrid.models.registry import MODELS, forecast, holdout, spec_of
from pulsegrid.operators import ensemble
from pulsegrid.operators.evaluate import best_model, data_std, forecast_metrics, scored
from pulsegrid.operators.joins import SeriesProfile, attach, profile
from pulsegrid.operators.rate import rates_long
from pulsegrid.operators.sigma import sigma_counts, sigma_events
from pulsegrid.operators.ttf import breaches_long, first_breach_wide, slope_sides, slope_ttf
from pulsegrid.plans import tables
from pulsegrid.plans.adaptive import SearchPlan, tune_adaptively
from pulsegrid.plans.search import tune
from pulsegrid.plans.stages import SeriesStages
from pulsegrid.session import stage
from pulsegrid.sources import sinks
from pulsegrid.sources.series import scan_interpolate, scan_trailing
from pulsegrid.sources.store import Store


COMBINATIONS = (None, "average", "best")


@dataclass(frozen=True)
class Analysis:
    """What to run; the presets below are the usual choices."""

    models: tuple[str, ...] = ("additive",)
    combine: str | None = None  # None, "average" or "best"
    training_days: int = 365
    horizon_days: int = 84
    freq: str = "1h"
    search_trials: int = 0
    search_plan: SearchPlan | None = None  # an adaptive search, used if there are no random trials
    configs: dict[str, Any] = field(default_factory=dict)


# Model choice, combination and search trials of each mode.
PRESETS = {
    "Fast": Analysis(("random_forest",), None, 365, 60, "1h", 30),
    "Balanced": Analysis(("random_forest", "boosted_trees"), "best", 365, 60, "1h", 50),
    "Performance": Analysis(("autoregressive",), None, 365, 60, "1h", 0),
}


def preset_name(analysis: Analysis) -> str:
    """The mode a set of options amounts to, or ``Custom``."""
    for name, known in PRESETS.items():
        same = all(
            getattr(analysis, f) == getattr(known, f)
            for f in ("training_days", "horizon_days", "freq", "search_trials")
        )
        chosen = set(analysis.models) == set(known.models) and len(analysis.models) == len(known.models)
        combined = len(known.models) == 1 or analysis.combine == known.combine
        if same and chosen and combined:
            return name
    return "Custom"


@dataclass
class Health:
    """The tables of one analysis."""

    counts: DataFrame  # tag, total_count, removed_count, percent_removed
    summary: DataFrame  # sigma thresholds
    crossings: DataFrame  # exceedance counts
    events: DataFrame
    fits: DataFrame  # wide slopes
    rates: DataFrame
    metrics: DataFrame  # tag, model, metrics of every model
    scores: DataFrame  # tag, model, ... of the reported model
    forecast: DataFrame  # of the reported model
    breaches: DataFrame  # long, forecast and slope breaches
    read: DataFrame  # tags with a reading
    faults: DataFrame  # tag, error: tags set aside before the models, with stage and cause
    attempted: DataFrame  # tags for which a model gave any forecast row, sound or not


LARGEST = 1e150  # squares of larger values are beyond what sums of them can hold


def _finite(value: Column) -> Column:
    """False for NaN and infinities; NULL counts as finite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(True))


def unusable(grid: DataFrame) -> DataFrame:
    """``(tag, error)``: tags whose values no later stage can square and add up."""
    worst = F.max(F.when(F.isnan("value"), float("inf")).otherwise(F.abs("value")))
    told = grid.groupBy("tag").agg(worst.alias("_worst")).where(F.col("_worst") > LARGEST)
    return told.select("tag", F.lit("grid: values too large").alias("error"))


def grid_profile(size: SeriesProfile, days: int, freq: str) -> SeriesProfile:
    """A tag on a grid has no more points than its time span has steps."""
    return SeriesProfile(size.tags, days * DAY // freq_us(freq) + 1, size.tag_bytes)


def analyse(
    series: DataFrame, analysis: Analysis = Analysis(),
    as_of: dt.datetime | str | None = None, size: SeriesProfile | None = None,
) -> Health:
    """Raw readings to result tables.

    Readings are scanned once and reduced to the grid meanwhile; from there on a tag has at
    most ``training_days / freq`` points, however many readings it has.  The grid, the prepared
    series and the per-tag tables are staged, since several results are derived from them.

    A tag that cannot be analysed holds up no other: values too large to be squared set it aside, and what a
    model's failed fit gives is left out of scores and forecasts.  ``failures`` names cause and stage.
    """
    for name in analysis.models:
        spec_of(name)
    if analysis.combine not in COMBINATIONS:
        raise ValueError(f"combine must be one of {COMBINATIONS}, not {analysis.combine!r}")
    if len(analysis.models) > 1 and analysis.combine is None:
        raise ValueError("several models need a combination")
    freq = analysis.freq
    if as_of is not None:
        series = scan_trailing(series, analysis.training_days, size, as_of)
    read = series.where(F.col("value").isNotNull()).select("tag").distinct()
    grid = stage(scan_interpolate(series, freq), "grid")
    size = size or profile(grid)
    faults = stage(unusable(grid), "faults")
    if not faults.isEmpty():
        grid = attach(grid, faults.select("tag"), size, how="left_anti")
    if as_of is None:
        grid = scan_trailing(grid, analysis.training_days, size)
    size = grid_profile(size, analysis.training_days, freq)
    shared = SeriesStages(grid, size)
    clean, summary, fits = shared.clean, shared.summary, shared.fits
    prepared = shared.prepared(freq)

    steps = steps_ahead(analysis.horizon_days, freq)
    chosen = {m: (analysis.configs.get(m), None) for m in analysis.models}
    if analysis.search_trials:
        for m in analysis.models:
            config, settings = tune(m, prepared, freq, size, analysis.search_trials)
            chosen[m] = (config or chosen[m][0], settings)
    elif analysis.search_plan:
        for m in analysis.models:
            chosen[m] = (chosen[m][0], tune_adaptively(m, prepared, freq, size, analysis.search_plan))
    holdouts = ensemble.union([
        holdout(m, prepared, freq, size, c, settings=s) for m, (c, s) in chosen.items()
    ])
    forecasts = stage(ensemble.union([
        forecast(m, prepared, steps, freq, size, c, settings=s).drop("i")
        for m, (c, s) in chosen.items()
    ]), "forecasts")
    attempted = forecasts.select("tag").distinct()
    forecasts = forecasts.where(_finite(F.col("yhat")))
    holdouts = holdouts.where(_finite(F.col("predicted")))
    metrics = stage(forecast_metrics(holdouts), "metrics")
    spreads = data_std(clean)
    scores = scored(metrics, spreads, size)
    if len(analysis.models) > 1:
        if analysis.combine == "average":
            forecasts = ensemble.average_forecast(forecasts)
            scores = scored(ensemble.average_metrics(metrics), spreads, size)
        else:
            scores = best_model(scores, list(MODELS))
            forecasts = ensemble.best_forecast(forecasts, scores, size)

    breaches = breaches_long(first_breach_wide(forecasts, summary, size)).unionByName(
        slope_ttf(slope_sides(fits, summary, size))
    )
    return Health(
        counts=shared.counts, summary=summary, crossings=sigma_counts(clean, summary, size),
        events=sigma_events(clean, summary, size), fits=fits, rates=rates_long(fits),
        metrics=metrics, scores=scores, forecast=forecasts, breaches=breaches,
        read=read, faults=faults, attempted=attempted,
    )


def asset_health(health: Health) -> DataFrame:
    """One row per tag with a reading: cleaning, thresholds, exceedances, slopes, model score and breaches.

    A tag without a grid point, or set aside, has its row, and NULL in it.
    """
    slopes = health.fits.select("tag", "last_ts", "last_value", "slope_14d", "slope_30d", "slope_60d")
    crossings = health.crossings.select(
        "tag", F.col("above1").alias("above_1s"), F.col("above3").alias("above_3s"),
        F.col("below1").alias("below_1s"), F.col("below3").alias("below_3s"),
    )
    scores = health.scores.select("tag", "model", "mae", "rmse", "mape", "score", "category")
    table = health.read.join(health.counts.drop("kept_count"), "tag", "left")
    for part in (
        health.summary.select("tag", "median", "mad", "sigma", "p3", "n3"), crossings, slopes,
        scores, tables.breaches_wide(health.breaches),
    ):
        table = table.join(part, "tag", "left")
    return table


def result_tables(health: Health, as_of: Column) -> dict[str, DataFrame]:
    """The five result tables."""
    return {
        "sigma_crossing_event": tables.event_table(health.events),
        "sigma_summary": tables.sigma_table(health.summary),
        "ttf_summary": tables.ttf_summary(health.scores, health.breaches, as_of),
        "forecast": tables.forecast_table(health.forecast),
        "rate_change": tables.rate_table(health.rates, as_of),
    }


def export_csv(health: Health, as_of: Column, folder: str) -> None:
    """Write every result table as CSV below ``folder``."""
    for name, table in result_tables(health, as_of).items():
        sinks.write_csv(table, f"{folder}/{name}")


def failures(requested: DataFrame, health: Health) -> DataFrame:
    """``(tag, error)``: the requested tags that have no forecast, each with the stage and the cause."""
    done = health.forecast.where(F.col("yhat").isNotNull()).select("tag").distinct()
    missing = requested.select("tag").distinct().join(done, "tag", "left_anti")
    marks = (
        health.read.select("tag", F.lit(True).alias("_read")), health.counts.select("tag", F.lit(True).alias("_grid")),
        health.attempted.select("tag", F.lit(True).alias("_fit")), health.faults.withColumnRenamed("error", "_fault"),
    )
    for mark in marks:
        missing = missing.join(mark, "tag", "left")
    cause = F.when(F.col("_read").isNull(), "No data").when(F.col("_fault").isNotNull(), F.col("_fault"))
    cause = cause.when(F.col("_grid").isNull(), "grid: no point").when(F.col("_fit").isNull(), "forecast: too few points")
    return missing.select("tag", cause.otherwise("fit: singular or not finite").alias("error"))


def publish(
    health: Health, requested: DataFrame, looked_up: DataFrame, as_of: Column, folder: str, horizon: str,
) -> DataFrame:
    """Write an analysis as tables of the store at ``folder`` and report on every requested tag.

    ``series`` holds the metadata of the forecast series (of the tags ``looked_up``), ``points`` the
    forecast values and ``nodes`` the records of the five result tables.  They become valid together,
    and tags are replaced, so publishing twice is harmless.  A tag without a forecast gets nothing written, but a row in the
    report with the reason; it holds up no other tag.  The report is derived from staged tables, so it
    says what was written.
    """
    failed = stage(failures(requested, health), "failures")
    model = health.scores.select("tag", F.col("model").alias("_model"))
    found = looked_up.join(failed, "tag", "left_anti").join(model, "tag")
    own = sinks.forecast_series(found, F.col("_model"), horizon)
    change = Store(own.sparkSession, folder).begin()
    change.replace_by_tag("series", own.withColumn("tag", F.col("metadata")["base_tag"]))
    points = sinks.forecast_points(health.forecast.join(failed, "tag", "left_anti"))
    change.replace_by_tag("points", points)
    results = result_tables(health, as_of)
    nodes = tables.node_records(
        results["forecast"], results["rate_change"], health.summary, results["ttf_summary"], health.events, as_of,
    )
    nodes = stage(nodes.join(failed, "tag", "left_anti"), "nodes")
    change.upsert_nodes("nodes", nodes).commit()
    return tables.run_report(requested.select("tag").distinct(), nodes, failed)
