"""Every registered query: ``name -> callable(spark, folder)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.catalog.inputs import (
    AS_OF, cleaned, events_by_type, events_by_user, lineitem_daily, orders_daily, part_meta, table,
)
from pulsegrid.functions.timeops import CALENDAR_NAMES
from pulsegrid.models import additive, kernel, registry, trees
from pulsegrid.models.frames import full_frames, holdout_frames
from pulsegrid.models.trend import TrendConfig
from pulsegrid.operators import clean, ensemble, evaluate, features, origins, rate, resample, sigma, trend, ttf
from pulsegrid.operators.joins import attach, profile
from pulsegrid.plans import adaptive
from pulsegrid.plans import health as plan
from pulsegrid.plans import search as parameter_search
from pulsegrid.plans import tables
from pulsegrid.session import configure, scratch_folder, stage
from pulsegrid.sources import meta, series, sinks
from pulsegrid.sources.store import Store

Query = Callable[..., DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results do not depend on the order of additions."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


def _sound(value):
    """Neither NULL nor NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def _all(*conditions):
    held = F.lit(True)
    for condition in conditions:
        held = held & F.coalesce(condition, F.lit(False))
    return held


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# Scans ---------------------------------------------------------------------------------------


@query
def scan_range(spark, folder):
    return series.scan_range(
        events_by_type(spark, folder), "2024-01-05 00:00:00", "2024-01-20 00:00:00",
        ["click", "purchase", "view"],
    )


@query
def scan_trailing(spark, folder):
    daily = orders_daily(spark, folder)
    return rounded(series.scan_trailing(daily, 90, profile(daily)))


@query
def scan_aggregate(spark, folder):
    events = events_by_type(spark, folder)
    return rounded(series.scan_aggregates(events, "1h"))


@query
def scan_interpolate(spark, folder):
    return rounded(series.scan_interpolate(events_by_type(spark, folder), "1h"))


@query
def scan_interpolate_slices(spark, folder):
    """The same with slices of a day, as on a long series."""
    return rounded(series.scan_interpolate(events_by_type(spark, folder), "1h", slice_bins=24))


@query
def scan_interpolate_step(spark, folder):
    return rounded(series.scan_interpolate(events_by_user(spark, folder), "1d", step=True))


@query
def meta_lookup(spark, folder):
    line = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    own = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), "l_partkey")
    tags = line.select("l_partkey").distinct().join(part, "l_partkey", "left").select(
        F.coalesce(own, F.concat(F.lit("unknown_"), "l_partkey")).alias("tag")
    )
    return meta.lookup(tags, part_meta(spark, folder))


@query
def forecast_series(spark, folder):
    parts = part_meta(spark, folder)
    found = meta.lookup(parts.select(F.col("external_id").alias("tag")), parts)
    made = sinks.forecast_series(found, "additive", "12_weeks")
    facts = F.array_join(F.transform(
        F.array_sort(F.map_entries("metadata")),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))),
    ), ";")
    return made.select("external_id", "name", "description", "unit", facts.alias("facts"))


@query
def meta_unpivot(spark, folder):
    chosen = {"selected_start_time": "365d-ago", "selected_end_time": "now", "selected_granularity": "1h"}
    rows = meta.unpivot(part_meta(spark, folder), chosen)
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query
def meta_search(spark, folder):
    found = meta.search(part_meta(spark, folder), ' "Large" ', limit=100)
    return found.select("id", "external_id", "name", F.col("match_rank").cast("bigint").alias("match_rank"))


@query
def meta_search_words(spark, folder):
    found = meta.search(part_meta(spark, folder), "ring small", limit=None)
    return found.select("id", "external_id", "name", F.col("match_rank").cast("bigint").alias("match_rank"))


@query
def meta_search_fuzzy(spark, folder):
    """The entries nearest to misspelt names of parts: every hundredth part's name without its third letter."""
    parts = part_meta(spark, folder)
    index = stage(meta.trigram_index(parts), "trigrams")
    asked = parts.where(F.col("id") % 100 == 0).select(
        F.col("id").alias("query_id"), F.concat(F.substring("name", 1, 6), F.expr("substring(name, 8)")).alias("query"),
    )
    found = meta.search_fuzzy(index, asked)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round(F.round("overlap", 9), 6).alias("overlap"))


@query
def meta_field_filter(spark, folder):
    found = meta.search(part_meta(spark, folder), "", limit=None)
    kept = meta.field_filter(found, "Field A", {"Field A": "Brand1", "Field B": "Brand2"})
    return kept.select("id", "external_id", "description")


@query
def meta_display_name(spark, folder):
    return meta.selection_list(meta.search(part_meta(spark, folder), "", limit=None))


# Cleaning and sigma --------------------------------------------------------------------------


@query
def outlier_bounds(spark, folder):
    return rounded(clean.outlier_bounds(events_by_type(spark, folder)), 6)


@query
def outlier_bounds_large(spark, folder):
    """The bracketed path of exact quantiles, with a limit that every event type is above."""
    return rounded(clean.outlier_bounds(events_by_type(spark, folder), exact_limit=100, accuracy=50), 6)


@query
def sigma_summary_large(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    return rounded(sigma.sigma_summary(c.clean, c.size, exact_limit=100))


@query
def outlier_clean_large(spark, folder):
    """The salted join that is used beyond the broadcast bound."""
    events = events_by_user(spark, folder)
    bounds = clean.outlier_bounds(events)
    joined = attach(events, bounds.select("tag", "lower_bound", "upper_bound"), profile(events), bound=0)
    return joined.where(F.col("value").between(F.col("lower_bound"), F.col("upper_bound"))).select("tag", "ts", "value")


@query
def outlier_clean(spark, folder):
    return clean.remove_outliers(events_by_user(spark, folder))


@query
def outlier_counts(spark, folder):
    return rounded(clean.outlier_counts(events_by_type(spark, folder)))


@query
def sigma_summary(spark, folder):
    return rounded(cleaned(events_by_type(spark, folder)).summary)


@query
def sigma_flags(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    return sigma.sigma_flags(c.clean, c.summary, c.size)


@query
def sigma_counts(spark, folder):
    c = cleaned(events_by_user(spark, folder))
    return sigma.sigma_counts(c.clean, c.summary, c.size)


@query
def sigma_events(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    return sigma.sigma_events(c.clean, c.summary, c.size)


@query
def sigma_event_table(spark, folder):
    c = cleaned(events_by_user(spark, folder))
    return tables.event_table(sigma.sigma_events(c.clean, c.summary, c.size))


@query
def sigma_table(spark, folder):
    return rounded(tables.sigma_table(cleaned(events_by_user(spark, folder)).summary))


# Rates ---------------------------------------------------------------------------------------


@query
def latest_value(spark, folder):
    return rate.latest_value(events_by_user(spark, folder))


@query
def rate_of_change(spark, folder):
    c = cleaned(orders_daily(spark, folder))
    rates = rate.rates_long(rate.window_fits(c.clean, c.size))
    return rounded(rates.select("tag", "period", F.col("slope").alias("slope_per_day"), "note"))


@query
def rate_units(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    fits = [
        rate.window_fits(c.clean, c.size, (14, 30), unit)
        .select("tag", F.lit(unit).alias("unit"), "slope_14d", "slope_30d")
        for unit in rate.UNIT_SECONDS
    ]
    scale = F.when(F.col("unit") == "per_second", 1e6).otherwise(1e2)
    return rounded(ensemble.union(fits).select(
        "tag", "unit", *[(F.col(s) * scale).alias(s) for s in ("slope_14d", "slope_30d")]
    ))


@query
def rate_fit_line(spark, folder):
    c = cleaned(orders_daily(spark, folder))
    return rounded(rate.rate_lines(c.clean, c.size), 3)


# Grids and features --------------------------------------------------------------------------


@query
def resample_mean(spark, folder):
    return rounded(series.scan_aggregate(events_by_user(spark, folder), "1d"))


@query
def resample_ffill(spark, folder):
    return rounded(resample.prepare(cleaned(events_by_type(spark, folder)).clean, "1h"))


@query
def resample_ffill_slices(spark, folder):
    clean_events = cleaned(events_by_type(spark, folder)).clean
    return rounded(resample.resample_grid(clean_events, "1h", slice_bins=24).select("tag", "ds", "y"))


@query
def prepared_as_is_large(spark, folder):
    c = cleaned(events_by_user(spark, folder))
    return resample.with_position(resample.prepare(c.clean, auto_resample=False), c.size, limit=20)


@query
def prepared_as_is(spark, folder):
    c = cleaned(events_by_user(spark, folder))
    return resample.with_position(resample.prepare(c.clean, auto_resample=False), c.size)


@query
def future_grid(spark, folder):
    pos = cleaned(events_by_type(spark, folder)).prepared("30min")
    return resample.future_grid(pos, 336, "30min")


@query
def time_features(spark, folder):
    pos = cleaned(events_by_type(spark, folder)).prepared("1h")
    return rounded(features.feature_frame(pos).select("tag", "ds", *CALENDAR_NAMES, "time_idx"), 6)


@query
def holdout_split(spark, folder):
    pos = cleaned(events_by_type(spark, folder)).prepared("1h")
    plain = features.holdout_split(pos)
    clamped = features.holdout_split(pos, clamp=True).select("tag", "ds", F.col("is_test").alias("is_validation"))
    return plain.join(clamped, ["tag", "ds"]).select("tag", "ds", "i", "n", "is_test", "is_validation")


@query
def even_subsample(spark, folder):
    pos = cleaned(events_by_type(spark, folder)).prepared("1h")
    return features.even_subsample(pos, 100).select("tag", "ds", "i")


def _lags(spark, folder, **options):
    pos = cleaned(events_by_type(spark, folder)).prepared("1h")
    lags = features.lag_sequences(pos, **options)
    x = F.col("x")
    weighted = F.aggregate(
        F.transform(x, lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, b: a + b
    )
    return rounded(lags.select(
        "tag", "ds", "y", x[0].alias("oldest"), x[71].alias("newest"),
        F.size(x).cast("bigint").alias("length"), weighted.alias("weighted"),
    ))


@query
def lag_sequences(spark, folder):
    return _lags(spark, folder)


@query
def lag_sequences_large(spark, folder):
    return _lags(spark, folder, chunk=100)


@query
def minmax_scale(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    scaled = features.minmax_scale(features.holdout_split(c.prepared("1h")), c.size)
    back = features.minmax_inverse(F.col("scaled"), F.col("y_min"), F.col("y_max")).alias("restored")
    return rounded(scaled.select("tag", "ds", "y", "is_test", "scaled", back))


@query
def standard_scale(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    pos = features.holdout_split(features.feature_frame(c.prepared("1h")))
    scaled = features.standard_scale(pos, ["y", "hour", "time_idx"], c.size)
    return rounded(scaled.select("tag", "ds", "y_scaled", "hour_scaled", "time_idx_scaled"))


# Trend forecast ------------------------------------------------------------------------------


@query
def history_stats(spark, folder):
    return rounded(trend.history_stats(cleaned(events_by_user(spark, folder)).prepared("1h")))


@query
def recent_trend(spark, folder):
    stats = trend.history_stats(cleaned(lineitem_daily(spark, folder)).prepared("1d"))
    return rounded(stats.select("tag", "n", "trend_slope", "trend_intercept"), 3)


@query
def calendar_pattern(spark, folder):
    pos = cleaned(events_by_type(spark, folder)).prepared("1h")
    parts = [
        trend.calendar_pattern(pos, by).select("tag", F.lit(by).alias("by"), F.col("slot").cast("bigint").alias("slot"), "mean")
        for by in ("hour", "weekday")
    ]
    return rounded(ensemble.union(parts))


MEMBERS = {f"trend_{k}": TrendConfig(recent_points=k) for k in (168, 72, 24)}
STEPS = 336


def _forecasts(c, names=tuple(MEMBERS), freq="1h", steps=STEPS):
    pos = c.prepared(freq)
    return ensemble.union([
        registry.forecast("trend", pos, steps, freq, c.size, MEMBERS[m], m) for m in names
    ])


def _holdouts(c, names=tuple(MEMBERS), freq="1h"):
    pos = c.prepared(freq)
    return ensemble.union([registry.holdout("trend", pos, freq, c.size, MEMBERS[m], m) for m in names])


def _scores(c, names=tuple(MEMBERS)):
    metrics = evaluate.forecast_metrics(_holdouts(c, names))
    return evaluate.scored(metrics, evaluate.data_std(c.clean), c.size)


@query
def trend_projection(spark, folder):
    c = cleaned(lineitem_daily(spark, folder))
    train, future = full_frames(c.prepared("1d"), 180, "1d")
    spec = registry.MODELS["trend"]
    return rounded(spec.fit_predict(train, future, c.size, "1d").select("tag", "ds", "yhat"), 3)


@query
def horizon_blend(spark, folder):
    """The mean by hour of day as the model, blended with the trend and softly clipped."""
    c = cleaned(events_by_type(spark, folder))
    pos = c.prepared("1h")
    hours = trend.calendar_pattern(pos, "hour").select("tag", "slot", F.col("mean").alias("level"))
    stats = trend.history_stats(pos).drop("n")
    future = resample.future_grid(pos, STEPS, "1h").withColumn("slot", F.hour("ds"))
    rows = attach(attach(future, hours, c.size, ("tag", "slot"), rows_per_key=24), stats, c.size)
    value = trend.soft_clip(trend.horizon_blend(F.col("level"), trend.projected_trend(), 0.3, STEPS))
    return rounded(rows.select("tag", "ds", value.alias("yhat")))


@query
def forecast_interval(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    return rounded(_forecasts(c, ("trend_168",)).select("tag", "ds", "yhat", "lower", "upper"))


@query
def forecast_table(spark, folder):
    c = cleaned(lineitem_daily(spark, folder))
    return rounded(tables.forecast_table(_forecasts(c, ("trend_168",), "1d", 84)), 2)


@query
def forecast_rebased(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    at = F.lit("2024-03-01 10:47:12").cast("timestamp_ntz")
    return rounded(tables.forecast_table(_forecasts(c, ("trend_72",)), at, "1h"))


@query
def forecast_summary(spark, folder):
    return rounded(evaluate.forecast_summary(_forecasts(cleaned(events_by_type(spark, folder)))))


@query
def forecast_points(spark, folder):
    """Timestamps arrive as text here; that of every 24th row is unreadable and skipped."""
    c = cleaned(events_by_type(spark, folder))
    text = F.when(F.col("i") % 24 == 5, F.lit("not a time")).otherwise(F.col("ds").cast("string"))
    return rounded(sinks.forecast_points(_forecasts(c, ("trend_168",)), text))


# Evaluation ----------------------------------------------------------------------------------


@query
def holdout_residuals(spark, folder):
    return rounded(_holdouts(cleaned(events_by_type(spark, folder)), ("trend_168",)).drop("model"))


@query
def forecast_metrics(spark, folder):
    return rounded(evaluate.forecast_metrics(_holdouts(cleaned(lineitem_daily(spark, folder)), freq="1d")), 3)


@query
def model_score(spark, folder):
    scores = _scores(cleaned(events_by_type(spark, folder)))
    return rounded(scores.select("tag", "model", "data_std", "score", "category", "color"))


@query
def model_comparison(spark, folder):
    return evaluate.model_comparison(_scores(cleaned(events_by_type(spark, folder))))


@query
def best_model(spark, folder):
    scores = _scores(cleaned(events_by_user(spark, folder)))
    return rounded(evaluate.best_model(scores, list(MEMBERS)).select("tag", "model", "score"))


@query
def value_range(spark, folder):
    return rounded(evaluate.series_range(cleaned(events_by_user(spark, folder)).clean))


def _faulty_report(spark, folder):
    """The report of an analysis in which each tag has three companions that cannot be analysed."""
    events = events_by_type(spark, folder)
    huge = events.select(F.concat("tag", F.lit(".huge")).alias("tag"), "ts", (F.col("value") * 1e200).alias("value"))
    off = F.min(F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.expr("INTERVAL '7' MINUTE"))
    single = events.groupBy(F.concat("tag", F.lit(".single")).alias("tag")).agg(off.alias("ts"), F.first("value").alias("value"))
    health = plan.analyse(events.unionByName(huge).unionByName(single), plan.Analysis(models=("trend",), horizon_days=14))
    names = [F.col("tag"), *[F.concat("tag", F.lit(end)) for end in (".huge", ".single", ".missing")]]
    asked = stage(events.select("tag").distinct().select(F.explode(F.array(*names)).alias("tag")), "asked")
    found = meta.lookup(asked, part_meta(spark, folder))
    return plan.publish(health, asked, found, as_of(), _folder(spark, "faulty"), "2_weeks")


@query
def fault_report(spark, folder):
    return _faulty_report(spark, folder)


@query
def run_totals(spark, folder):
    return tables.run_totals(_faulty_report(spark, folder))


@query
def parity_range(spark, folder):
    return rounded(evaluate.parity_range(_holdouts(cleaned(events_by_type(spark, folder)))))


ORIGINS = origins.Origins(365, 90, 30)


@query
def cv_folds(spark, folder):
    c = cleaned(orders_daily(spark, folder))
    train, test, _ = evaluate.cv_frames(c.prepared("1d"), "1d", c.size, 365, 90, 30)
    parts = [
        frame.groupBy("tag", "fold").agg(
            F.count("*").alias("rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds")
        ).withColumn("part", F.lit(part))
        for part, frame in (("train", train), ("test", test))
    ]
    return ensemble.union(parts)


@query
def cv_trend(spark, folder):
    c = cleaned(orders_daily(spark, folder))
    train, test, many = evaluate.cv_frames(c.prepared("1d"), "1d", c.size, 365, 90, 30)
    spec = registry.MODELS["trend"]
    predicted = spec.fit_predict(train, test, many, "1d")
    return rounded(evaluate.cv_metrics(predicted), 3)


@query
def cv_trend_sums(spark, folder):
    """``cv_trend`` without copies of training rows: moments of every fold from running sums."""
    c = cleaned(orders_daily(spark, folder))
    return rounded(evaluate.cv_metrics(origins.trend_predictions(c.prepared("1d"), "1d", c.size, ORIGINS)), 3)


@query
def cv_horizon(spark, folder):
    """Errors of the damped trend by days ahead, over all folds."""
    c = cleaned(orders_daily(spark, folder))
    return rounded(origins.horizon_errors(origins.trend_predictions(c.prepared("1d"), "1d", c.size, ORIGINS)), 3)


@query
def cv_horizon_summary(spark, folder):
    c = cleaned(lineitem_daily(spark, folder))
    predicted = origins.trend_predictions(c.prepared("1d"), "1d", c.size, ORIGINS)
    return rounded(origins.horizon_summary(origins.horizon_errors(predicted)), 3)


@query
def cv_metrics(spark, folder):
    c = cleaned(orders_daily(spark, folder))
    train, test, many = evaluate.cv_frames(c.prepared("1d"), "1d", c.size, 365, 90, 30)
    found = evaluate.cv_metrics(additive.fit_predict(train, test, many, "1d"))
    errors = [f"{m}_{n}" for m in ("mae", "rmse", "mape") for n in ("mean", "std")]
    return found.select("tag", "folds", _all(
        *[_sound(F.col(e)) & (F.col(e) >= 0) for e in errors], F.col("mae_mean") <= F.col("rmse_mean"),
        F.col("coverage").between(0.5, 1),
    ).alias("sound"))


# Time to failure and result tables -----------------------------------------------------------


@query
def ttf_first_breach(spark, folder):
    c = cleaned(lineitem_daily(spark, folder))
    wide = ttf.first_breach_wide(_forecasts(c, ("trend_168",), "1d", 180), c.summary, c.size)
    return ttf.breaches_long(wide)


@query
def ttf_wide(spark, folder):
    c = cleaned(lineitem_daily(spark, folder))
    return ttf.first_breach_wide(_forecasts(c, ("trend_72",), "1d", 180), c.summary, c.size)


def _slope_sides(c):
    return ttf.slope_sides(c.fits, c.summary, c.size)


def _to_minute(df, column):
    return df.withColumn(column, F.date_trunc("minute", column).cast("timestamp_ntz"))


@query
def ttf_slope_sides(spark, folder):
    sides = ttf.slope_sides_long(_slope_sides(cleaned(orders_daily(spark, folder))))
    return _to_minute(sides, "predicted_ts")


@query
def ttf_slope(spark, folder):
    return _to_minute(ttf.slope_ttf(_slope_sides(cleaned(events_by_user(spark, folder)))), "predicted_ts")


@query
def ttf_countdown(spark, folder):
    breaches = ttf.slope_ttf(_slope_sides(cleaned(events_by_type(spark, folder))))
    return ttf.countdown(_to_minute(breaches, "predicted_ts"), as_of())


def _breaches(c, model="trend_168"):
    wide = ttf.first_breach_wide(_forecasts(c, (model,)), c.summary, c.size)
    return ttf.breaches_long(wide).unionByName(ttf.slope_ttf(_slope_sides(c)))


@query
def ttf_breach_times(spark, folder):
    table_rows = tables.breach_table(_breaches(cleaned(events_by_type(spark, folder))))
    return _to_minute(table_rows, "Predicted_Timestamp")


@query
def ttf_summary(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    breaches = _to_minute(_breaches(c), "predicted_ts")
    return tables.ttf_summary(_scores(c, ("trend_168",)), breaches, as_of())


def _nodes(c):
    rates = tables.rate_table(rate.rates_long(c.fits), as_of())
    summary = c.summary
    return tables.node_records(
        tables.forecast_table(_forecasts(c, ("trend_168",))), rates, summary,
        tables.ttf_summary(_scores(c, ("trend_168",)), _breaches(c), as_of()),
        sigma.sigma_events(c.clean, summary, c.size), as_of(),
    )


@query
def node_records(spark, folder):
    """Ids and one number out of each record's properties."""
    nodes = _nodes(cleaned(events_by_type(spark, folder)))
    number = F.coalesce(*[
        F.get_json_object("properties", f"$.{f}") for f in ("Forecast", "Slope_per_day", "Median", "Score", "Value")
    ])
    return rounded(nodes.select("external_id", "view", "tag", number.cast("double").alias("number")), 3)


@query
def run_report(spark, folder):
    """Every event type and one unknown tag are requested."""
    events = events_by_type(spark, folder)
    c = cleaned(events)
    asked = events.select(F.explode(F.array("tag", F.concat("tag", F.lit(".missing")))).alias("tag")).distinct()
    return tables.run_report(asked, _nodes(c))


# Sinks: results as read back -----------------------------------------------------------------


def _folder(spark, name):
    return f"{scratch_folder(configure(spark))}/{name}-{uuid.uuid4().hex}"


@query
def sink_csv_roundtrip(spark, folder):
    events = clean.remove_outliers(events_by_type(spark, folder))
    path = _folder(spark, "csv")
    sinks.write_csv(events, path)
    return spark.read.option("header", True).schema(events.schema).csv(path)


@query
def sink_replace_tag(spark, folder):
    """Daily points of all tags, then twice the hourly points of two tags over them."""
    events = events_by_type(spark, folder)
    path = _folder(spark, "points")
    sinks.replace_by_tag(series.scan_aggregate(events, "1d", "count"), path)
    again = series.scan_aggregate(events.where(F.col("tag").isin("click", "view")), "1h", "count")
    sinks.replace_by_tag(again, path)
    sinks.replace_by_tag(again, path)
    return sinks.read_rows(spark, path).select("tag", "ts", "value")


@query
def store_change(spark, folder):
    """Points and node records before a change, after one that broke off between two tables, and after its rerun."""
    events = events_by_type(spark, folder)
    results = Store(spark, _folder(spark, "store"))
    points = {freq: series.scan_aggregate(events, freq, "count") for freq in ("1d", "12h")}

    def nodes(rows):
        return rows.select(F.concat("tag", F.lit("_"), F.date_format("ts", "yyyyMMddHH")).alias("external_id"), F.lit("forecast").alias("view"), "tag")

    results.begin().replace_by_tag("points", points["1d"]).upsert_nodes("nodes", nodes(points["1d"])).commit()
    results.begin().replace_by_tag("points", points["12h"])  # ends here: never valid

    def counted(when):
        parts = [
            results.read(name).groupBy("tag").count().select(F.lit(when).alias("phase"), F.lit(name).alias("name"), "tag", F.col("count").alias("rows"))
            for name in ("points", "nodes")
        ]
        return stage(ensemble.union(parts), "counted")

    broken = counted("broken")
    results.begin().replace_by_tag("points", points["12h"]).upsert_nodes("nodes", nodes(points["12h"])).commit()
    return broken.unionByName(counted("rerun"))


@query
def sink_upsert_nodes(spark, folder):
    """Nodes of all tags; then those of one tag again, with fewer forecast rows."""
    c = cleaned(events_by_type(spark, folder))
    path = _folder(spark, "nodes")
    nodes = _nodes(c)
    sinks.upsert_nodes(nodes, path)
    late = (F.col("view") != "forecast") | (F.col("external_id") >= "click_forecast_20240205")
    sinks.upsert_nodes(nodes.where((F.col("tag") == "click") & late), path)
    return sinks.read_rows(spark, path).select("external_id", "view", "tag")


# Models --------------------------------------------------------------------------------------

FOREST = trees.ForestConfig()
BOOSTED = trees.BoostedConfig()


def _model_forecast(name, config=None):
    def run(spark, folder):
        c = cleaned(events_by_type(spark, folder))
        rows = registry.forecast(name, c.prepared("1h"), STEPS, "1h", c.size, config)
        return _forecast_facts(rows, c)

    return run


def _forecast_facts(rows, c):
    """What SQL can state of a fitted model's forecast: its grid, its bounds, its interval's order.

    Blended models are clipped to the historic range and a fifth of its width beyond; the additive
    model must stay within twice the range's width.
    """
    history = c.prepared("1h").groupBy("tag").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    reach = (F.col("hi") - F.col("lo")) * F.when(F.col("model") == "additive", 2.0).otherwise(0.2) + 1e-6
    good = _all(
        *[_sound(F.col(k)) for k in ("yhat", "lower", "upper")], F.col("lower") <= F.col("yhat"),
        F.col("yhat") <= F.col("upper"), F.col("yhat").between(F.col("lo") - reach, F.col("hi") + reach),
    )
    return attach(rows, history, c.size).groupBy("tag", "model").agg(
        F.count("*").alias("rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.count_if(good).alias("good_rows"),
    )


QUERIES["forecast_additive"] = _model_forecast("additive")
QUERIES["forecast_kernel"] = _model_forecast("kernel", kernel.KernelConfig())
QUERIES["forecast_autoregressive"] = _model_forecast("autoregressive")
QUERIES["forecast_random_forest"] = _model_forecast("random_forest", FOREST)
QUERIES["forecast_gbt"] = _model_forecast("boosted_trees", BOOSTED)


@query
def boosted_stump(spark, folder):
    """The first split of the boosted trees of every tag."""
    train, _ = full_frames(cleaned(events_by_type(spark, folder)).prepared("1h"), 1, "1h")
    found = trees.best_splits(trees.training_cells(train), BOOSTED)
    return found.select(
        "tag", "feature", F.round("value", 6).alias("value"), F.round("gain", 2).alias("gain"), "left_rows",
        F.round("left_leaf", 5).alias("left_leaf"), F.round("right_leaf", 5).alias("right_leaf"),
    )


@query
def holdout_eval(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    pos = c.prepared("1h")
    configs = {"random_forest": FOREST, "boosted_trees": BOOSTED}
    rows = ensemble.union([
        registry.holdout(m, pos, "1h", c.size, configs.get(m)) for m in registry.MODELS
    ])
    scores = evaluate.scored(evaluate.forecast_metrics(rows), evaluate.data_std(c.clean), c.size)
    modes = F.create_map(*[F.lit(x) for s in registry.MODELS.values() for x in (s.name, s.eval_mode)])
    held = rows.groupBy("tag", "model").agg(F.count("*").alias("rows"), F.min("ds").alias("first_ds"))
    good = _all(*[_sound(F.col(k)) for k in ("mae", "rmse", "mape", "score")], F.col("mae") <= F.col("rmse") + 1e-9)
    return scores.join(held, ["tag", "model"]).select(
        "tag", "model", "rows", "first_ds", modes[F.col("model")].alias("eval_mode"), good.alias("sound")
    )


@query
def model_diagnostics(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    train, _ = full_frames(c.prepared("1h"), 1, "1h")
    found = additive.diagnostics(train, c.size, "1h")
    return found.withColumn("num_changepoints", F.col("num_changepoints").cast("bigint")).withColumn(
        "sound", _all(
            _sound(F.col("trend_strength")), F.col("trend_strength") >= 0,
            F.col("live_changepoints").between(0, F.col("num_changepoints")),
        ),
    ).drop("trend_strength", "live_changepoints")


@query
def kernel_tube(spark, folder):
    """Distance of each kernel fit from its optimality condition, and whether its rounds came to rest."""
    c = cleaned(events_by_type(spark, folder))
    train, _ = full_frames(c.prepared("1h"), 1, "1h")
    found = kernel.fit_summary(train, c.size)
    good = _all(F.col("rounds") < kernel.ROUNDS, F.col("inside").between(0.01, 1.0), _sound(F.col("noise")))
    return found.select("tag", F.round("residual", 5).alias("residual"), good.alias("settled"))


@query
def additive_optimality(spark, folder):
    """How far each coefficient of the additive fits is from its optimality condition."""
    c = cleaned(lineitem_daily(spark, folder))
    train, _ = full_frames(c.prepared("1d"), 1, "1d")
    found = additive.fit_optimality(additive.fit(train, c.size, "1d"), c.size)
    return found.select("tag", F.col("j").cast("bigint").alias("j"), F.round("residual", 6).alias("residual"))


@query
def additive_band(spark, folder):
    """How the squared width of the additive interval grows over the horizon, as a share of its whole growth."""
    c = cleaned(lineitem_daily(spark, folder))
    rows = registry.forecast("additive", c.prepared("1d"), 84, "1d", c.size)
    square = F.pow((F.col("upper") - F.col("lower")) / 2, 2)
    ends = [F.max(F.when(F.col("i") == k, F.col("square"))).over(Window.partitionBy("tag")) for k in (0, 83)]
    grown = rows.withColumn("square", square).withColumns({"first": ends[0], "last": ends[1]})
    share = (F.col("square") - F.col("first")) / (F.col("last") - F.col("first"))
    return grown.select("tag", "i", F.round(share, 5).alias("growth"))


# Ensembles and search ------------------------------------------------------------------------


@query
def ensemble_average(spark, folder):
    return rounded(ensemble.average_forecast(_forecasts(cleaned(events_by_type(spark, folder)))))


@query
def ensemble_average_metrics(spark, folder):
    metrics = evaluate.forecast_metrics(_holdouts(cleaned(events_by_type(spark, folder))))
    return rounded(ensemble.average_metrics(metrics))


@query
def ensemble_average_ttf(spark, folder):
    c = cleaned(lineitem_daily(spark, folder))
    mean = ensemble.average_forecast(_forecasts(c, freq="1d", steps=180))
    return ttf.breaches_long(ttf.first_breach_wide(mean, c.summary, c.size))


@query
def ensemble_best(spark, folder):
    c = cleaned(events_by_user(spark, folder))
    winners = evaluate.best_model(_scores(c), list(MEMBERS))
    return rounded(ensemble.best_forecast(_forecasts(c, steps=72), winners, c.size).drop("i"))


@query
def hpo_best_params(spark, folder):
    c = cleaned(events_by_type(spark, folder))
    pos = c.prepared("1h")
    results = ensemble.union([
        parameter_search.search(m, parameter_search.searchable(pos), "1h", c.size, trials=50)
        for m in ("additive", "kernel")
    ])
    least = F.min("loss").over(Window.partitionBy("tag", "model"))
    ranked = results.withColumn("_good", _all(_sound(F.col("loss")), (F.col("place") > 1) | (F.col("loss") == least)))
    return ranked.groupBy("tag", "model").agg(
        F.count("*").alias("trials"), F.count_distinct("place").alias("places"), F.count_if("_good").alias("good_trials"),
    )


@query
def search_split(spark, folder):
    """Rows that a search validates on, and rows that score its winner: they do not meet."""
    pos = cleaned(events_by_type(spark, folder)).prepared("1h")
    _, validation = holdout_frames(parameter_search.searchable(pos), clamp=True)
    _, scoring = holdout_frames(pos)
    parts = [
        frame.groupBy("tag").agg(F.count("*").alias("rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))
        .withColumn("part", F.lit(part)) for part, frame in (("validation", validation), ("scoring", scoring))
    ]
    return ensemble.union(parts)


ORDER_SPACE = {"season": (0.0, 1.0, "float"), "urgency": [1, 2, 3, 4, 5]}
LINE_SPACE = {"quantity": (0.0, 1.0, "float"), "discount": (0.0, 1.0, "float"), "status": ["F", "O"]}


@query
def search_density(spark, folder):
    """Orders as trials of their customers: how much more a place is liked by the cheapest third than by the rest."""
    u = F.array(
        F.dayofyear("o_orderdate") / F.lit(366.0), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("double"),
    )
    trials = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("tag"), F.col("o_orderkey").cast("string").alias("fold"),
        F.lit(0).alias("rung"), F.col("o_totalprice").cast("double").alias("loss"), u.alias("u"),
    )
    points = F.explode(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.25, 0.0), (0.5, 1.0), (0.75, 4.0))]))
    told = adaptive.split_trials(trials).withColumn("at", points)
    liked = adaptive.preference(F.col("good"), F.col("rest"), [F.col("at")[0], F.col("at")[1]], ORDER_SPACE)
    counts = [F.size(part).cast("bigint").alias(part) for part in ("good", "rest")]
    told = told.withColumn("preference", F.round(liked, 6))
    return told.select("tag", F.col("at")[0].alias("season"), *counts, "preference")


@query
def search_importance(spark, folder):
    """Order lines as trials, their price as the loss: what each of three settings explains."""
    trials = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("tag"), F.col("l_extendedprice").cast("double").alias("loss"),
        F.array(
            (F.col("l_quantity").cast("double") - 1.0) / 49.0, F.col("l_discount").cast("double") * 10.0,
            (F.col("l_linestatus") == "O").cast("double"),
        ).alias("u"),
    )
    return rounded(adaptive.importance(trials, LINE_SPACE))


@query
def search_rung_rows(spark, folder):
    """Rows that every rung of a round copies for training and validation."""
    c = cleaned(events_by_type(spark, folder))
    pos, settings = parameter_search.searchable(c.prepared("1h")), adaptive.SearchPlan()
    tags, none = pos.select("tag").distinct(), spark.createDataFrame([], adaptive.HISTORY)
    batch = stage(adaptive.propose(tags, none, parameter_search.SPACES["kernel"], settings, 0), "proposed")
    parts = []
    for rung, (count, share) in enumerate(settings.rungs):
        alive = adaptive.promoted(batch.withColumn("loss", F.lit(0.0)), count)
        for part, frame in zip(("train", "validation"), adaptive.rung_frames(pos, alive, share, c.size, settings.batch)):
            parts.append(frame.groupBy("tag").agg(
                F.lit(rung).cast("bigint").alias("rung"), F.lit(part).alias("part"), F.count_distinct("fold").alias("trials"),
                F.count("*").alias("rows"), F.max("n").alias("length"), F.min("i").alias("first_i"),
            ))
    return ensemble.union(parts)


@query
def search_rounds(spark, folder):
    """Trials by the rung that they reached, in two rounds for each of the four model spaces."""
    c = cleaned(events_by_type(spark, folder))
    pos, settings = parameter_search.searchable(c.prepared("1h")), adaptive.SearchPlan(rounds=2)
    inside = F.forall("u", lambda x: x >= 0)
    spaces = parameter_search.SPACES
    return ensemble.union([
        found.withColumn("_good", _all(_sound(F.col("loss")), inside)).groupBy("tag", "round", "rung").agg(
            F.lit(model).alias("model"), F.count("*").alias("trials"), F.count_if("_good").alias("good_trials"),
        ) for model, found in zip(spaces, adaptive.adaptive_searches(list(spaces), pos, "1h", c.size, settings))
    ])


# The whole analysis --------------------------------------------------------------------------


@query
def asset_health(spark, folder):
    analysis = plan.Analysis(models=("trend",), horizon_days=14)
    table_rows = plan.asset_health(plan.analyse(events_by_type(spark, folder), analysis))
    for name in tables.breach_columns().values():
        table_rows = _to_minute(table_rows, name)
    return rounded(table_rows, 3)


@query
def asset_health_best(spark, folder):
    """Three models, the best one per tag."""
    analysis = plan.Analysis(models=("kernel", "autoregressive", "additive"), combine="best", horizon_days=14)
    found = plan.asset_health(plan.analyse(events_by_type(spark, folder), analysis))
    good = _all(*[_sound(F.col(k)) for k in ("mae", "rmse", "mape", "score")], F.col("model").isin(*analysis.models))
    return rounded(found.select(
        "tag", "total_count", "removed_count", "percent_removed", "median", "mad", "sigma", "p3", "n3",
        "above_1s", "above_3s", "below_1s", "below_3s", "last_ts", "last_value", good.alias("sound"),
    ), 3)


@query
def publish_report(spark, folder):
    """The report of a published analysis, with the points of each tag as read back."""
    events = events_by_type(spark, folder)
    health = plan.analyse(events, plan.Analysis(models=("trend",), horizon_days=14))
    asked = stage(
        events.select(F.explode(F.array("tag", F.concat("tag", F.lit(".missing")))).alias("tag")).distinct(), "asked",
    )
    path = _folder(spark, "published")
    found = meta.lookup(asked, part_meta(spark, folder))
    report = plan.publish(health, asked, found, as_of(), path, "2_weeks")
    points = Store(spark, path).read("points").groupBy("tag").agg(F.count("*").alias("points_written"))
    return report.join(points, "tag", "left").withColumn("points_written", F.coalesce("points_written", F.lit(0)))
