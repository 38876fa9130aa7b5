import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import features, resample, trend
from pulsegrid.sources.series import scan_interpolate

START = dt.datetime(2024, 1, 1)


def hours(rows, column):
    return [(r[column] - START).total_seconds() / 3600 for r in rows]


def test_gaps_are_filled_forward(make):
    grid = resample.resample_grid(make({"t": [(0, 1), (0.5, 3), (1, 5), (5, 9)]}), "1h").orderBy("ds").collect()
    assert hours(grid, "ds") == [0, 1, 2, 3, 4, 5]
    assert [r["y"] for r in grid] == [2, 5, 5, 5, 5, 9]
    assert [(r["i"], r["n"]) for r in grid] == [(k, 6) for k in range(6)]


def test_resample_against_pandas(sine):
    thin = sine.where(F.pmod(F.xxhash64("ts"), F.lit(3)) == 0)
    found = resample.resample_ffill(thin, "30min").toPandas().sort_values(["tag", "ds"]).reset_index(drop=True)
    parts = [
        g.set_index("ts")["value"].resample("30min").mean().ffill().rename("y").reset_index().assign(tag=t)
        for t, g in thin.toPandas().groupby("tag")
    ]
    wanted = pd.concat(parts).rename(columns={"ts": "ds"})[["tag", "ds", "y"]].reset_index(drop=True)
    assert (found["ds"] == wanted["ds"]).all() and np.allclose(found["y"], wanted["y"])


def test_interpolation_stays_between_the_ends(make):
    series = make({"t": [(0.5, 1), (2.5, 5), (4, 2)], "on": [(0, 3)], "off": [(0.25, 3)]})
    rows = scan_interpolate(series, "1h").orderBy("tag", "ts").collect()
    assert [(r["tag"], r["value"]) for r in rows] == [("on", 3.0), ("t", 2.0), ("t", 4.0), ("t", 4.0), ("t", 2.0)]
    step = scan_interpolate(series, "1h", step=True).where("tag = 't'").orderBy("ts").collect()
    assert [r["value"] for r in step] == [1.0, 1.0, 5.0, 2.0]


def test_step_flag_may_differ_by_tag(make):
    series = make({"s": [(0.5, 1), (2.5, 5)], "l": [(0.5, 1), (2.5, 5)]}).withColumn("is_step", F.col("tag") == "s")
    rows = scan_interpolate(series, "1h", step=F.col("is_step")).orderBy("tag", "ts").collect()
    assert [r["value"] for r in rows] == [2.0, 4.0, 1.0, 1.0]


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_positions(make, limit):
    rng = np.random.default_rng(2)
    times = np.sort(np.append(rng.choice(100, 60, replace=False), rng.choice(np.arange(9_000, 10_000), 240, replace=False)))
    prepared = resample.as_prepared(make({"t": [(k, k) for k in times], "u": [(5, 1), (1, 0)]}))
    rows = resample.with_position(prepared, limit=limit).where("tag = 't'").orderBy("ds").collect()
    assert [r["i"] for r in rows] == list(range(300)) and {r["n"] for r in rows} == {300}


@pytest.mark.parametrize("n,m", [(10, 20), (10, 10), (11, 4), (100, 7), (1000, 999), (5, 2)])
def test_even_subsample_is_linspace(make, n, m):
    rows = resample.with_position(resample.as_prepared(make({"t": [(k, k) for k in range(n)]})))
    found = sorted(r["i"] for r in features.even_subsample(rows, m).collect())
    assert found == (list(range(n)) if n <= m else np.linspace(0, n - 1, m, dtype=int).tolist())


@pytest.mark.parametrize("chunk", [100_000, 10])
def test_lags_cross_chunks(make, chunk):
    rows = resample.with_position(resample.as_prepared(make({"t": [(k, k * k) for k in range(50)]})))
    found = features.lag_sequences(rows, 7, chunk=chunk).orderBy("i").collect()
    assert [r["i"] for r in found] == list(range(7, 50))
    assert all(r["x"] == [float(k * k) for k in range(r["i"] - 7, r["i"])] for r in found)


@pytest.mark.parametrize("n,sloped", [(168, False), (169, True)])
def test_recent_trend_needs_more_than_a_week(make, n, sloped):
    grid = resample.resample_grid(make({"t": [(k, 3.0 * k) for k in range(n)]}))
    row = trend.history_stats(grid).collect()[0]
    assert np.isclose(row["trend_slope"], 3.0 if sloped else 0.0)
    assert row["trend_intercept"] == 3.0 * (n - 1)


def test_search_split_is_clamped(make):
    rows = resample.with_position(resample.as_prepared(make({"t": [(k, k) for k in range(55)]})))
    assert features.holdout_split(rows).where("is_test").count() == 11
    assert features.holdout_split(rows, clamp=True).where("is_test").count() == 5


def test_blend_clip_interval_endpoints(spark):
    rows = spark.range(5).toDF("i").withColumns({
        "min": F.lit(0.0), "max": F.lit(10.0),
        "blend": trend.horizon_blend(F.lit(1.0), F.lit(2.0), 0.3, 5),
        "half": trend.interval_width(F.lit(1.0), 5),
    }).withColumn("clipped", trend.soft_clip(F.col("i") * 5.0)).orderBy("i").collect()
    assert np.allclose([r["blend"] for r in rows], [1.0, 1.075, 1.15, 1.225, 1.3])
    assert np.isclose(rows[-1]["half"], 1.96 * 2)
    assert [r["clipped"] for r in rows] == [0.0, 5.0, 10.0, 12.0, 12.0]


@pytest.mark.parametrize("slice_bins", [1, 2, 7, 4096])
def test_slices_do_not_change_grids(make, slice_bins):
    from pulsegrid.sources.series import scan_interpolate

    rows = make({"a": [(0, 1), (1.5, 2), (30, 5), (31, 4), (200, 0)], "b": [(-70, 3)], "c": [(5, 1), (6, 2)]})
    whole = scan_interpolate(rows, "1h", slice_bins=10_000).orderBy("tag", "ts").collect()
    assert scan_interpolate(rows, "1h", slice_bins=slice_bins).orderBy("tag", "ts").collect() == whole
    filled = resample.resample_grid(rows, "1h", slice_bins=10_000).orderBy("tag", "ds").collect()
    assert resample.resample_grid(rows, "1h", slice_bins=slice_bins).orderBy("tag", "ds").collect() == filled
    assert len(filled) == 201 + 1 + 2 and [r["i"] for r in filled[:201]] == list(range(201))
