import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import clean, rate, sigma, ttf
from pulsegrid.operators.joins import profile
from pulsegrid.plans.stages import SeriesStages
from pulsegrid.sources.series import as_series, scan_range, scan_trailing

START = dt.datetime(2024, 1, 1)


def one(df):
    return df.collect()[0].asDict()


def test_nan_becomes_null_and_missing_values_never_pass(make, spark):
    raw = spark.createDataFrame([("t", START, float("nan")), ("t", START + dt.timedelta(1), 1.0), ("e", START, None)],
                                "tag string, ts timestamp_ntz, value double")
    series = as_series(raw, "tag", "ts", "value")
    counts = {r["tag"]: r for r in clean.outlier_counts(series).collect()}
    assert (counts["t"]["total_count"], counts["t"]["removed_count"]) == (2, 1)
    assert counts["e"]["kept_count"] == 0
    assert clean.remove_outliers(series).count() == 1
    without = clean.outlier_bounds(series).where("tag = 't'")
    counts = {r["tag"]: r for r in clean.outlier_counts(series, profile(series), without).collect()}
    assert (counts["e"]["total_count"], counts["e"]["kept_count"]) == (1, 0)


def test_band_is_inclusive(make):
    # p10 = 1, p90 = 9, so the band is [-11, 21].
    series = make({"t": list(enumerate([*range(0, 11)]))})
    bounds = one(clean.outlier_bounds(series))
    assert (bounds["lower_bound"], bounds["upper_bound"]) == (-11.0, 21.0)
    edge = make({"t": [(0, -11.0), (1, 21.0), (2, 21.0001), (3, -11.1)]})
    kept = clean.remove_outliers(edge, profile(edge), clean.outlier_bounds(series))
    assert sorted(r["value"] for r in kept.collect()) == [-11.0, 21.0]


def test_flat_series_exceeds_every_threshold(make):
    stages = SeriesStages(make({"flat": [(k, 5.0) for k in range(20)]}))
    summary = one(stages.summary)
    assert summary["mad"] == 0 and summary["p5"] == summary["n5"] == 5.0
    counts = one(sigma.sigma_counts(stages.clean, stages.summary, stages.size))
    assert all(counts[f"{s}{k}"] == 20 for s in ("above", "below") for k in range(1, 6))
    assert sigma.sigma_events(stages.clean, stages.summary, stages.size).count() == 200


def test_sigma_against_numpy(make):
    values = np.random.default_rng(3).normal(10, 2, 501).round(2)
    series = make({"t": list(enumerate(values))})
    row = one(sigma.sigma_summary(series))
    mad = np.median(np.abs(values - np.median(values)))
    assert np.isclose(row["median"], np.median(values)) and np.isclose(row["mad"], mad)
    assert np.isclose(row["p3"], np.median(values) + 3 * 1.4826 * mad)
    events = sigma.sigma_events(series, sigma.sigma_summary(series), profile(series))
    above = {k: int((values >= np.median(values) + k * 1.4826 * mad).sum()) for k in (1, 2, 3)}
    found = {r["type"]: r["count"] for r in events.groupBy("type").count().collect()}
    for k, count in above.items():
        assert found.get(f"Crossed Above {k}σ", 0) == count


def test_ramp_slopes_and_breaches(make):
    series = make({"ramp": [(d, 2.0 * d) for d in range(400)], "fall": [(d, -1.0 * d) for d in range(400)]}, hours=24)
    stages = SeriesStages(series)
    rates = {(r["tag"], r["period"]): r["slope"] for r in rate.rates_long(stages.fits).collect()}
    assert len(rates) == 12
    for d in rate.PERIODS:
        assert np.isclose(rates["ramp", f"{d}d"], 2.0) and np.isclose(rates["fall", f"{d}d"], -1.0)
    summary = {r["tag"]: r for r in stages.summary.collect()}
    sides = {(r["tag"], r["period"]): r for r in ttf.slope_sides(stages.fits, stages.summary, stages.size).collect()}
    up = sides["ramp", 30]
    days = (summary["ramp"]["p5"] - 2.0 * 399) / 2.0
    assert up["lower_ts"] is None
    assert abs((up["upper_ts"] - (START + dt.timedelta(days=399 + days))).total_seconds()) < 1
    assert sides["fall", 30]["upper_ts"] is None and sides["fall", 30]["lower_ts"] is not None


@pytest.mark.parametrize("points,known", [(9, False), (10, True)])
def test_short_window_has_a_note_instead_of_a_slope(make, points, known):
    fits = rate.window_fits(make({"t": [(k, k) for k in range(points)]}, hours=24))
    row = rate.rates_long(fits).where("period = '14d'").collect()[0]
    assert (row["slope"] is not None) is known
    assert (row["note"] is None) is known


def test_unknown_unit_is_refused(make):
    with pytest.raises(ValueError, match="per_day"):
        rate.window_fits(make({"t": [(0, 1)]}), convert_to="per_week")


def test_latest_value_and_ranges(make):
    series = make({"t": [(0, 1), (5, 7), (3, 2)], "u": [(1, 4)]})
    rows = {r["tag"]: r["last_value"] for r in rate.latest_value(series).collect()}
    assert rows == {"t": 7.0, "u": 4.0}
    picked = scan_range(series, "2024-01-01 00:00:00", "2024-01-01 05:00:00", ["t"])
    assert sorted(r["value"] for r in picked.collect()) == [1.0, 2.0]
    trailing = scan_trailing(make({"t": [(d, d) for d in range(10)]}, hours=24), 3, profile(series))
    assert sorted(r["value"] for r in trailing.collect()) == [6.0, 7.0, 8.0, 9.0]


def test_countdown_text(make, spark):
    rows = spark.createDataFrame(
        [("t", "x", START + dt.timedelta(days=2, hours=3, minutes=4)), ("t", "y", None),
         ("t", "z", START - dt.timedelta(minutes=1))],
        "tag string, breach_type string, predicted_ts timestamp_ntz",
    )
    texts = {r["breach_type"]: r["time_to_threshold"]
             for r in ttf.countdown(rows, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).collect()}
    assert texts == {"x": "2d 3h 4m", "z": "-1d 23h 59m"}


def test_breaches_beyond_the_calendar_are_unknown(make):
    flat = [(d, 100.0 + d % 2 + 1e-7 * d) for d in range(100)]
    stages = SeriesStages(make({"t": flat}, hours=24))
    rows = ttf.slope_ttf(ttf.slope_sides(stages.fits, stages.summary, stages.size)).collect()
    assert len(rows) == 3 and all(r["predicted_ts"] is None or r["predicted_ts"].year < 2263 for r in rows)
    assert any(r["predicted_ts"] is None for r in rows)
