import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import evaluate, origins
from pulsegrid.operators.trend import history_stats
from pulsegrid.plans.stages import SeriesStages


@pytest.fixture(scope="module")
def grid(sine):
    stages = SeriesStages(sine)
    return stages.prepared("1h"), stages.size


@pytest.mark.parametrize("spacing,recent", [
    (origins.Origins(30, 7, 7), 168), (origins.Origins(10, 2, 5), 168), (origins.Origins(3, 9, 1), 100), (origins.Origins(1, 1, 1), 24),
])
def test_sums_equal_the_statistics_of_copied_rows(grid, spacing, recent):
    positioned, size = grid
    train, test, _ = evaluate.cv_frames(positioned, "1h", size, spacing.initial_days, spacing.period_days, spacing.horizon_days)
    wanted = history_stats(train, ("tag", "fold"), recent).toPandas().set_index(["tag", "fold"]).sort_index()
    ends = origins.fold_ends(positioned, spacing)
    found = origins.trend_states(positioned, ends, "1h", size, spacing, recent).toPandas().set_index(["tag", "fold"]).sort_index()
    assert found.index.equals(wanted.index) and len(found) == 2 * origins.fold_count(ends)
    for column in ("n", "mean", "std", "trend_slope", "trend_intercept"):
        assert np.allclose(found[column].astype(float), wanted[column].astype(float), rtol=1e-7, atol=1e-9), column
    per_fold = test.groupBy("tag", "fold").agg(F.count("*").alias("n"), F.min("i").alias("first")).toPandas()
    assert (per_fold["n"] == spacing.horizon_days * 24).all() and (per_fold["first"] == 0).all()


def test_tags_too_short_for_a_fold_have_none(grid):
    positioned, size = grid
    assert origins.trend_predictions(positioned, "1h", size, origins.Origins(58, 7, 7)).count() == 0
    assert origins.trend_predictions(positioned.limit(0), "1h", size).count() == 0


def test_horizon_errors_take_the_last_residuals(spark):
    rng = np.random.default_rng(5)
    rows = [("a", "f%d" % f, i, float(rng.normal()), 0.0, 1.0) for f in range(7) for i in range(12) if (f + i) % 5]
    rows += [("a", "g", 3, None, 0.0, 1.0), ("b", "f", 0, 2.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "tag string, fold string, i long, actual double, yhat double, residual_std double")
    found = origins.horizon_errors(frame, 0.25).toPandas().sort_values(["tag", "i"])
    own = [r for r in rows if r[0] == "a" and r[3] is not None]
    w = int(len(own) * 0.25)
    steps = sorted({r[2] for r in own})
    wanted = {}
    for step in steps:
        left, total = w, 0.0
        for back in reversed([s for s in steps if s <= step]):
            errors = [abs(r[4] - r[3]) for r in own if r[2] == back]
            take = min(left, len(errors))
            total, left = total + take * np.mean(errors), left - take
        if not left:
            wanted[step] = total / w
    mine = found[found["tag"] == "a"]
    assert mine["i"].tolist() == sorted(wanted) and np.allclose(mine["mae"], [wanted[s] for s in sorted(wanted)])
    other = found[found["tag"] == "b"].iloc[0]
    assert (other["mae"], other["rmse"], other["mape"], other["coverage"]) == (1.0, 1.0, 0.5, 1.0)
    assert origins.horizon_summary(origins.horizon_errors(frame)).count() == 2
