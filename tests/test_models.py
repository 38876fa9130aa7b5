import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.models import additive, kernel, ridge, trees
from pulsegrid.models.registry import MODELS, forecast, holdout, spec_of
from pulsegrid.operators import evaluate
from pulsegrid.plans import search as parameter_search
from pulsegrid.plans.stages import SeriesStages

SMALL = {
    "random_forest": trees.ForestConfig(n_estimators=10, max_depth=7),
    "boosted_trees": trees.BoostedConfig(n_estimators=10),
}
STEPS = 48


@pytest.fixture(scope="module")
def stages(sine):
    return SeriesStages(sine)


def test_unknown_model_is_refused():
    with pytest.raises(ValueError, match="unknown model"):
        spec_of("oracle")


@pytest.mark.parametrize("name", list(MODELS))
def test_forecast_shape_and_bounds(stages, name):
    grid = stages.prepared("1h")
    found = forecast(name, grid, STEPS, "1h", stages.size, SMALL.get(name)).toPandas()
    limits = grid.groupBy("tag").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.max("ds").alias("end")).toPandas()
    for tag, part in found.sort_values("ds").groupby("tag"):
        edge = limits[limits.tag == tag].iloc[0]
        assert len(part) == STEPS and part["ds"].is_monotonic_increasing
        assert (part["ds"].iloc[0] - edge["end"]).total_seconds() == 3600
        assert (part["lower"] <= part["yhat"]).all() and (part["yhat"] <= part["upper"]).all()
        if name != "additive":
            room = 0.2 * (edge["hi"] - edge["lo"]) + 1e-9
            assert part["yhat"].between(edge["lo"] - room, edge["hi"] + room).all()


@pytest.mark.parametrize("name", [m for m in MODELS if m != "trend"])
def test_models_beat_the_mean(stages, name):
    rows = holdout(name, stages.prepared("1h"), "1h", stages.size, SMALL.get(name)).toPandas()
    for tag, part in rows.groupby("tag"):
        assert len(part) == 288
        error = np.sqrt((part["residual"] ** 2).mean())
        assert error < 0.8 * part["actual"].std(), (name, tag, error)


@pytest.mark.parametrize("largest", [0, 10**9])
def test_ridge_equals_numpy(spark, largest):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    z = x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(0, 0.1, 500)
    rows = spark.createDataFrame(
        [("t", [float(v) for v in x[k]], float(z[k])) for k in range(500)],
        "tag string, x array<double>, z double",
    )
    parts = ridge.moments(rows.repartition(6), ["tag"], largest=largest)
    assert parts.count() == 6
    weights = F.array(*[F.lit(1.0)] * 4)
    found = ridge.solve(parts.withColumn("penalty", weights), ["tag"]).collect()[0]
    variance = 1.0
    for _ in range(3):
        coef = np.linalg.solve(x.T @ x + variance * np.eye(4), x.T @ z)
        variance = ((z - x @ coef) ** 2).mean()
    assert np.allclose(found["coef"], coef, atol=1e-9) and np.isclose(found["noise"], np.sqrt(variance))


def test_multiplicative_needs_positive_values(make):
    hours = np.arange(40 * 24)
    wave = np.exp(2 + 0.3 * np.sin(2 * np.pi * hours / 24))
    stages = SeriesStages(make({"pos": list(zip(hours, wave)), "mixed": list(zip(hours, wave - 7.0))}))
    config = additive.AdditiveConfig(seasonality_mode="multiplicative")
    rows = holdout("additive", stages.prepared("1h"), "1h", stages.size, config).toPandas()
    errors = rows.groupby("tag")["absolute_error"].mean()
    assert errors["pos"] < 0.05 and errors["mixed"] < 0.5


def test_diagnostics(stages):
    from pulsegrid.models.frames import full_frames

    train, _ = full_frames(stages.prepared("1h"), 1, "1h")
    for row in additive.diagnostics(train, stages.size, "1h").collect():
        assert row["num_changepoints"] == 6 and row["trend_strength"] > 0
        assert row["seasonality_components"] == "daily,weekly,monthly"


def test_search_ranks_all_trials(stages):
    grid = stages.prepared("1h")
    found = parameter_search.search("additive", grid, "1h", stages.size, trials=4).toPandas()
    assert len(found) == 8
    for _, part in found.groupby("tag"):
        ordered = part.sort_values("place")
        assert list(ordered["place"]) == [1, 2, 3, 4] and ordered["loss"].is_monotonic_increasing
    best = parameter_search.best_params(parameter_search.search("kernel", grid, "1h", stages.size, 2)).count()
    assert best == 2
    assert parameter_search.sample_trials("additive", 3) == parameter_search.sample_trials("additive", 3)


def test_cross_validation_of_the_additive_model(stages):
    train, test, _ = evaluate.cv_frames(stages.prepared("1h"), "1h", stages.size)
    size = stages.size.with_groups(4)
    rows = evaluate.cv_metrics(additive.fit_predict(train, test, size, "1h")).collect()
    assert {r["folds"] for r in rows} == {4}
    assert all(0 < r["mae_mean"] < 5 and 0 <= r["coverage"] <= 1 for r in rows)


def test_zero_actuals_use_epsilon(spark):
    rows = spark.createDataFrame([("t", "m", 0.0, 1.0), ("t", "m", 2.0, 1.0)], "tag string, model string, actual double, predicted double")
    row = evaluate.forecast_metrics(rows).collect()[0]
    assert row["mae"] == 1.0 and row["rmse"] == 1.0 and row["mape"] > 1e15


def test_score_limits_and_ties(spark):
    metrics = spark.createDataFrame(
        [("t", "b", 0.0, 0.0, 0.0), ("t", "a", 0.0, 0.0, 0.0), ("t", "c", 9.0, 9.0, 9.0), ("u", "c", None, None, None)],
        "tag string, model string, mae double, rmse double, mape double",
    )
    spread = spark.createDataFrame([("t", 1.0), ("u", 0.0)], "tag string, data_std double")
    from pulsegrid.operators.joins import SeriesProfile

    scores = evaluate.scored(metrics, spread, SeriesProfile(2, 4, 1))
    found = {(r["tag"], r["model"]): r for r in scores.collect()}
    assert found["t", "a"]["score"] == 100.0 and found["t", "a"]["category"] == "Good"
    assert found["t", "c"]["score"] == 0.0 and found["t", "c"]["color"] == "error"
    assert found["u", "c"]["score"] is None and found["u", "c"]["nmse"] == float("inf")
    best = {r["tag"]: r["model"] for r in evaluate.best_model(scores, ["a", "b", "c"]).collect()}
    assert best == {"t": "a", "u": "c"}


def test_unknown_kernels_are_refused_and_all_known_ones_differ(stages):
    grid = stages.prepared("1h")
    with pytest.raises(ValueError, match="kernel must be"):
        forecast("kernel", grid, 4, "1h", stages.size, kernel.KernelConfig(kernel="sigmoid"))
    means = {
        (k, d): forecast("kernel", grid, 4, "1h", stages.size, kernel.KernelConfig(kernel=k, degree=d)).agg(F.sum("yhat")).first()[0]
        for k, d in (("rbf", 3), ("linear", 3), ("poly", 2), ("poly", 3))
    }
    assert len({round(v, 6) for v in means.values()}) == 4 and all(np.isfinite(v) for v in means.values())


def test_polynomial_features_approximate_the_kernel():
    import pandas as pd

    x = np.random.default_rng(1).normal(size=(20, len(kernel.FEATURES)))
    pdf = pd.DataFrame({"gamma": [1.0] * 20, "kernel": ["poly"] * 20, "degree": [2] * 20})
    z = kernel._lift(20_000, 1)(x, pdf)[:, 1:20_001]
    exact = (x @ x.T / len(kernel.FEATURES)) ** 2
    assert np.abs(z @ z.T - exact).max() < 0.15


def test_a_flat_tag_has_no_trend_strength(make):
    from pulsegrid.models.frames import full_frames

    flat = SeriesStages(make({"f": [(k, 3.0) for k in range(100)], "g": [(k, k) for k in range(100)]}))
    train, _ = full_frames(flat.prepared("1h"), 1, "1h")
    found = {r["tag"]: r["trend_strength"] for r in additive.diagnostics(train, flat.size, "1h").collect()}
    assert found["f"] is None and found["g"] > 1


def test_a_search_does_not_see_the_scoring_rows(stages):
    grid = stages.prepared("1h")
    seen = parameter_search.searchable(grid).groupBy("tag").agg(F.max("i").alias("last"), F.max("n").alias("n")).collect()
    held = {r["tag"]: r["first"] for r in grid.where(F.col("i") >= F.floor(F.col("n") * 0.8)).groupBy("tag").agg(F.min("i").alias("first")).collect()}
    assert all(r["last"] < held[r["tag"]] and r["n"] == r["last"] + 1 for r in seen)


def test_unknown_combinations_are_refused(sine):
    from pulsegrid.plans.health import Analysis, analyse

    for combine in ("avg", None):
        with pytest.raises(ValueError):
            analyse(sine, Analysis(models=("trend", "kernel"), combine=combine))
