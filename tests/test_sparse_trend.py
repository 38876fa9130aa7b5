import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.models import additive, ridge
from pulsegrid.models.frames import full_frames, holdout_frames
from pulsegrid.plans.stages import SeriesStages


def objective(system, target, price, coef):
    return coef @ system @ coef / 2 - target @ coef + price @ np.abs(coef)


@pytest.mark.parametrize("seed", range(6))
def test_sparse_solution_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, free, priced = 200, 4, 12
    t = np.linspace(0, 1, n)
    hinges = np.maximum(0, t[:, None] - np.linspace(0.05, 0.9, priced))  # nearly collinear
    x = np.column_stack([np.ones(n), t, rng.normal(size=(n, free - 2)), hinges])
    z = 3 * t - 8 * np.maximum(0, t - 0.5) + rng.normal(0, 0.2, n)
    system = x.T @ x + np.diag([1e-3] * free + [1e-9] * priced)
    price = np.array([0.0] * free + [0.3] * priced)
    coef = ridge._sparse(system, x.T @ z, price)
    gradient = system @ coef - x.T @ z
    live = coef != 0
    assert 0 < (live & (price > 0)).sum() < priced
    assert np.abs(gradient + np.sign(coef) * price)[live].max() < 1e-5
    assert (np.abs(gradient[~live]) <= price[~live] + 1e-5).all()
    best = objective(system, x.T @ z, price, coef)
    for _ in range(200):
        other = coef + rng.normal(0, 10.0 ** -rng.integers(1, 6), len(coef)) * (rng.random(len(coef)) < 0.3)
        assert objective(system, x.T @ z, price, other) >= best - 1e-9


@pytest.fixture(scope="module")
def bent(make):
    """A slope that changes twice, one that never does, and a constant; daily for 400 days."""
    rng = np.random.default_rng(4)
    days = np.arange(400)
    shapes = {"bent": 100 + 0.5 * days - 0.9 * np.maximum(0, days - 130) + 0.8 * np.maximum(0, days - 260), "straight": 50 + 0.1 * days}
    points = {t: list(zip(days, y + rng.normal(0, 1.0, 400))) for t, y in shapes.items()}
    return SeriesStages(make(points | {"flat": [(d, 5.0) for d in days]}, 24.0))


def test_changepoints_live_where_the_slope_changes(bent):
    train, _ = full_frames(bent.prepared("1d"), 1, "1d")
    fitted = additive.fit(train, bent.size, "1d")
    coef = {r["tag"]: r["coef"][2:8] for r in fitted.coefficients.collect()}
    assert sum(c != 0 for c in coef["bent"]) >= 2 and np.abs(coef["straight"]).sum() < 0.5 and coef["flat"] == [0.0] * 6
    strict = additive.fit(train, bent.size, "1d", additive.AdditiveConfig(changepoint_prior_scale=0.005)).coefficients
    assert all(r["coef"][2:8] == [0.0] * 6 for r in strict.collect())
    told = {r["tag"]: r["live_changepoints"] for r in additive.diagnostics(train, bent.size, "1d").collect()}
    assert told == {t: sum(c != 0 for c in own) for t, own in coef.items()}
    worst = additive.fit_optimality(fitted, bent.size).agg(F.max("residual")).first()[0]
    assert worst < 1e-7


def test_optimality_sees_a_wrong_coefficient(bent):
    train, _ = full_frames(bent.prepared("1d"), 1, "1d")
    fitted = additive.fit(train, bent.size, "1d")
    fitted.coefficients = fitted.coefficients.withColumn("coef", F.transform("coef", lambda c: c * 1.01))
    assert additive.fit_optimality(fitted, bent.size).where("tag = 'bent'").agg(F.max("residual")).first()[0] > 1e-4


def test_band_widens_by_the_closed_form(bent):
    train, future = full_frames(bent.prepared("1d"), 60, "1d")
    fitted = additive.fit(train, bent.size, "1d")
    own = {r["tag"]: r for r in fitted.coefficients.collect()}
    rows = additive.predict(fitted, future, bent.size, "1d").toPandas().sort_values("i")
    for tag, part in rows.groupby("tag"):
        fit = own[tag]
        size = np.abs(fit["coef"][2:8]).mean()
        h = (part["i"].to_numpy() + 1) / 399
        wanted = np.sqrt(fit["noise"] ** 2 + 2 / 3 * 6 * size**2 * h**3) * fit["scale"]
        assert np.allclose(part["residual_std"], wanted) and (np.diff(part["residual_std"]) >= 0).all()


def test_widening_band_covers_random_slopes_better(make):
    """Holdouts of series whose slope keeps changing: nearer to 0.9 than the constant band."""
    rng = np.random.default_rng(11)
    points = {}
    for k in range(12):
        slopes = np.repeat(rng.laplace(0, 0.4, 8), 50)
        points[f"t{k}"] = list(enumerate(100 + np.cumsum(slopes) + rng.normal(0, 1.0, 400)))
    stages = SeriesStages(make(points, 24.0))
    train, test = holdout_frames(stages.prepared("1d"))
    fitted = additive.fit(train, stages.size, "1d")
    rows = additive.predict(fitted, test, stages.size, "1d").join(fitted.coefficients.select("tag", "noise", "scale"), "tag").toPandas()
    error = (rows["actual"] - rows["yhat"]).abs()
    widening, constant = ((error <= 1.645 * s).mean() for s in (rows["residual_std"], rows["noise"] * rows["scale"]))
    assert abs(widening - 0.9) < abs(constant - 0.9)
