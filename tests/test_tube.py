import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.models import kernel
from pulsegrid.models.frames import full_frames
from pulsegrid.models.registry import holdout
from pulsegrid.operators.features import feature_frame
from pulsegrid.plans.stages import SeriesStages


def loss(x, z, coef, c, epsilon):
    return (coef[1:] ** 2).sum() / 2 + c * np.maximum(0, np.abs(z - x @ coef) - epsilon).sum()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = []
    for tag, n in (("a", 300), ("b", 120), ("c", 40)):
        x = rng.normal(size=(n, 16))
        z = x[:, 0] - 0.5 * x[:, 3] + rng.laplace(0, 0.3, n)
        data += [(tag, "f", [float(v) for v in x[k]], float(z[k]), 4.0, 0.1, 1.0, "linear", 3) for k in range(n)]
    return spark.createDataFrame(data, "tag string, fold string, x array<double>, z double, c double, epsilon double, gamma double, kernel string, degree int")


def test_rounds_find_the_least_tube_loss(rows):
    lift = kernel._lift(8, 1)
    found = kernel.tube_fit(rows, ["tag", "fold"], lift, 300).toPandas()
    for _, fit in found.iterrows():
        own = rows.where(F.col("tag") == fit["tag"]).toPandas()
        x, z, coef = lift(np.stack(own["x"]), own), own["z"].to_numpy(), np.asarray(fit["coef"])
        best, rng = loss(x, z, coef, 4.0, 0.1), np.random.default_rng(0)
        for scale in (1e-1, 1e-2, 1e-3):
            for _ in range(60):
                assert loss(x, z, coef + rng.normal(0, scale, len(coef)), 4.0, 0.1) > best - 4.0 * kernel.CORNER * len(z) / 10
        assert fit["residual"] < 1e-5 and 0 < fit["inside"] < 1 and fit["rounds"] < kernel.ROUNDS
        assert np.isclose(fit["noise"], np.sqrt(np.mean((z - x @ coef) ** 2)))


def test_rounds_over_spark_agree_with_rounds_in_a_task(rows):
    lift = kernel._lift(8, 1)
    here = kernel.tube_fit(rows, ["tag", "fold"], lift, 300).orderBy("tag").collect()
    there = kernel.tube_fit(rows, ["tag", "fold"], lift, 300, slice_rows=50).orderBy("tag").collect()
    for a, b in zip(here, there, strict=True):
        assert np.abs(np.array(a["coef"]) - np.array(b["coef"])).max() < 5e-3
        assert abs(a["inside"] - b["inside"]) < 0.03 and np.isclose(a["noise"], b["noise"], rtol=1e-2)
        assert b["residual"] < 1e-2 and 1 < b["rounds"] <= kernel.SPARK_ROUNDS


def test_outliers_pull_less_than_under_squared_loss(spark):
    """A tenth of the rows are far off on one side; the fit stays with the others."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    z = x[:, 2] + rng.normal(0, 0.1, 400) + 6 * (np.arange(400) % 10 == 0)
    rows = spark.createDataFrame(
        [("t", "f", [float(v) for v in x[k]], float(z[k]), 15.0, 0.08, 1.0, "linear", 3) for k in range(400)],
        "tag string, fold string, x array<double>, z double, c double, epsilon double, gamma double, kernel string, degree int",
    )
    lift = kernel._lift(4, 1)
    fit = kernel.tube_fit(rows, ["tag", "fold"], lift, 400).collect()[0]
    lifted = lift(x, rows.toPandas())
    squared = np.linalg.lstsq(lifted, z, rcond=None)[0]
    tube_off, squared_off = (np.abs(lifted @ np.asarray(coef) - x[:, 2]).mean() for coef in (fit["coef"], squared))
    assert squared_off > 0.5 and tube_off < 0.1


def test_summary_and_odd_tags(make):
    stages = SeriesStages(make({"flat": [(h, 3.0) for h in range(100)], "one": [(0, 1.0)], "wave": [(h, float(h % 24)) for h in range(240)]}))
    train, _ = full_frames(stages.prepared("1h"), 1, "1h")
    told = {r["tag"]: r for r in kernel.fit_summary(train, stages.size).collect()}
    assert set(told) == {"flat", "one", "wave"} and told["flat"]["inside"] == 1.0
    assert kernel.fit_summary(train.limit(0), stages.size).count() == 0
    rows = holdout("kernel", stages.prepared("1h"), "1h", stages.size).where("tag = 'flat'").toPandas()
    assert np.allclose(rows["predicted"], 3.0)
    assert feature_frame(train).count() == 341
