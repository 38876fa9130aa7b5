import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.models import autoregressive
from pulsegrid.models.registry import forecast, holdout
from pulsegrid.plans.stages import SeriesStages

CONFIG = autoregressive.AutoregressiveConfig()


@pytest.fixture(scope="module")
def threshold(make):
    """A value climbs by itself and falls back when it passes a threshold: linear in no number of lags."""
    points = {}
    for tag, seed in (("a", 1), ("b", 2)):
        rng = np.random.default_rng(seed)
        y, values = 0.3, []
        for _ in range(1500):
            y = 0.9 * y + 0.2 if y < 0.7 else 0.25 * y
            y += rng.normal(0, 0.02)
            values.append(y)
        points[tag] = list(enumerate(values))
    return SeriesStages(make(points))


def linear_errors(stages):
    """One-step errors of a least-squares fit to the 72 lags alone."""
    out = {}
    for tag, part in stages.prepared("1h").toPandas().groupby("tag"):
        y = part.sort_values("ds")["y"].to_numpy()
        x = np.column_stack([np.ones(len(y) - 72), np.lib.stride_tricks.sliding_window_view(y, 72)[:-1]])
        train = int(len(y) * 0.8) - 72
        coef = np.linalg.lstsq(x[:train], y[72:][:train], rcond=None)[0]
        out[tag] = np.sqrt(np.mean((y[72:][train:] - x[train:] @ coef) ** 2))
    return out


def test_state_beats_the_lags_on_a_threshold_series(threshold):
    rows = holdout("autoregressive", threshold.prepared("1h"), "1h", threshold.size).toPandas()
    for tag, part in rows.groupby("tag"):
        assert len(part) == 300
        assert np.sqrt((part["residual"] ** 2).mean()) < 0.7 * linear_errors(threshold)[tag]


def test_one_step_and_recursive_paths_agree_at_the_first_step(threshold):
    """The holdout's first prediction is the first step of a forecast from the training part."""
    grid = threshold.prepared("1h")
    first = holdout("autoregressive", grid, "1h", threshold.size).where("ds = timestamp_ntz'2024-02-20 00:00:00'").toPandas()
    part = grid.where("i < 1200").withColumn("n", F.lit(1200).cast("long"))
    ahead = autoregressive.forecast(part, 3, threshold.size, "1h", CONFIG).where("i = 0").toPandas()
    both = first.merge(ahead, on=["tag", "ds"])
    assert len(both) == 2 and np.allclose(both["predicted"], both["yhat"], atol=1e-9)


def test_slices_give_the_fit_of_the_whole(threshold, monkeypatch):
    from pulsegrid.models import ridge

    whole = holdout("autoregressive", threshold.prepared("1h"), "1h", threshold.size).toPandas()
    monkeypatch.setattr(ridge, "SLICE_ROWS", 100)
    cut = holdout("autoregressive", threshold.prepared("1h"), "1h", threshold.size).toPandas()
    both = whole.merge(cut, on=["tag", "ds"])
    assert len(both) == 600 and np.allclose(both["predicted_x"], both["predicted_y"], atol=1e-6)


def test_long_recursions_stay_in_reach(threshold):
    grid = threshold.prepared("1h")
    found = autoregressive.forecast(grid, 800, threshold.size, "1h", CONFIG).toPandas()
    low, high = grid.agg(F.min("y"), F.max("y")).first()
    room = autoregressive.REACH * (high - low) + 1e-9
    assert len(found) == 1600 and found["yhat"].between(low - room, high + room).all()
    blended = forecast("autoregressive", grid, 48, "1h", threshold.size)
    assert blended.count() == 96


def test_short_tags_have_no_rows(make):
    stages = SeriesStages(make({"t": [(h, float(h)) for h in range(60)]}))
    assert autoregressive.forecast(stages.prepared("1h"), 5, stages.size, "1h", CONFIG).count() == 0
    assert holdout("autoregressive", stages.prepared("1h"), "1h", stages.size).count() == 0
