import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.models import trees
from pulsegrid.models.frames import full_frames, holdout_frames
from pulsegrid.plans import search as parameter_search
from pulsegrid.plans.stages import SeriesStages


def tree_brute(x, y, weight, depth, least, least_split, l2, l1):
    """Every threshold of every feature, row by row."""
    def score(g, h):
        return max(abs(g) - l1, 0) ** 2 / (h + l2) if h + l2 else 0.0

    g, h = -(weight * y).sum(), weight.sum()
    leaf = np.full(len(y), -np.sign(g) * max(abs(g) - l1, 0) / (h + l2) if h else 0.0)
    best, cut = trees.LEAST_GAIN, None
    if depth and h >= least_split:
        for j in range(x.shape[1]):
            for v in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= v
                hl, gl = weight[left].sum(), -(weight * y)[left].sum()
                if hl >= least and h - hl >= least and score(gl, hl) + score(g - gl, h - hl) - score(g, h) > best + 1e-9:
                    best, cut = score(gl, hl) + score(g - gl, h - hl) - score(g, h), left
    if cut is not None:
        for side in (cut, ~cut):
            leaf[side] = tree_brute(x[side], y[side], weight[side], depth - 1, least, least_split, l2, l1)
    return leaf


@pytest.mark.parametrize("depth, least, least_split, l2, l1", [(1, 1, 0, 0.0, 0.0), (3, 7, 0, 0.27, 0.12), (6, 3, 5, 0.0, 0.0), (9, 1, 2, 1.0, 5.0)])
def test_grown_trees_equal_brute_force(depth, least, least_split, l2, l1):
    rng = np.random.default_rng(depth)
    fit = np.repeat([0, 1, 2], [90, 40, 25])
    x = np.stack([rng.integers(0, 12, len(fit)), rng.normal(size=len(fit)), rng.integers(0, 2, len(fit))], axis=1).astype(float)
    y, weight = rng.normal(0, 3, len(fit)) + x[:, 0], rng.integers(0, 3, len(fit)).astype(float)
    columns, feature = trees.binned(x)
    def each(v):
        return np.full(3, float(v))
    limits = trees.Limits(each(depth).astype(int), each(least), each(least_split), each(l2), each(l1))
    found = trees.grow(columns, feature, fit, weight, -y, limits, lambda f, p: np.ones((len(f), 3), bool))
    for k in range(3):
        own, drawn = fit == k, (fit == k) & (weight > 0)
        wanted = tree_brute(x[drawn], y[drawn], weight[drawn], depth, least, least_split, l2, l1)
        assert np.allclose(found[drawn], wanted)
        assert np.isfinite(found[own]).all()


def test_first_split_of_the_task_equals_that_of_the_aggregation(sine):
    train, _ = full_frames(SeriesStages(sine).prepared("1h"), 1, "1h")
    cells = trees.training_cells(train)
    config = trees.BoostedConfig()
    told = {r["tag"]: r for r in trees.best_splits(cells, config).collect()}
    for tag, part in cells.toPandas().groupby("tag"):
        columns, feature = trees.binned(part[trees.FEATURES].to_numpy(float))
        rows, mean = part["rows"].to_numpy(float), (part["total"] / part["rows"]).to_numpy(float)
        start = np.average(mean, weights=rows)
        limits = trees.Limits(*(np.array([v]) for v in (1, config.min_child_weight, 0.0, config.reg_lambda, config.reg_alpha)))
        leaf = trees.grow(columns, feature, np.zeros(len(rows), int), rows, start - mean, limits, lambda f, p: np.ones((1, 16), bool))
        left = part[told[tag]["feature"]].to_numpy() <= told[tag]["value"]
        assert np.allclose(leaf[left], told[tag]["left_leaf"]) and np.allclose(leaf[~left], told[tag]["right_leaf"])
        assert rows[left].sum() == told[tag]["left_rows"]


@pytest.mark.parametrize("config", [trees.BoostedConfig(n_estimators=60), trees.ForestConfig(n_estimators=30)])
def test_tags_of_unlike_shape_are_each_followed(make, config):
    """One tag's peak is another's trough; a constant tag stays constant; a fit depends on its own rows only."""
    hours = np.arange(30 * 24)
    wave = 5 * np.sin(2 * np.pi * hours / 24)
    points = {"up": list(zip(hours, 10 + wave)), "down": list(zip(hours, 10 - wave)), "flat": [(h, 4.0) for h in hours], "short": [(0, 1.0), (1, 3.0)]}
    stages = SeriesStages(make(points))
    train, test = holdout_frames(stages.prepared("1h"))
    found = trees.fit_predict(train, test, stages.size, "1h", config).toPandas()
    for tag in ("up", "down"):
        part = found[found.tag == tag]
        assert len(part) == 144 and np.abs(part["actual"] - part["yhat"]).mean() < 0.5
        assert 0 <= part["residual_std"].iloc[0] < 1
    assert np.allclose(found[found.tag == "flat"]["yhat"], 4.0) and np.allclose(found[found.tag == "short"]["yhat"], 1.0)
    alone = train.where("tag = 'down'"), test.where("tag = 'down'")
    again = trees.fit_predict(*alone, stages.size, "1h", config).toPandas()
    both = again.merge(found, on=["tag", "ds"])
    assert len(both) == 144 and np.allclose(both["yhat_x"], both["yhat_y"])


def test_half_hours_are_cells_of_their_hour(make):
    """Splits need only sums, so a finer grid gives the fit of its hourly means, weighted by rows."""
    steps = np.arange(30 * 48)
    points = {"t": [(s / 2, float(s % 7 + (s // 2) % 24)) for s in steps]}
    stages = SeriesStages(make(points))
    train, _ = full_frames(stages.prepared("30min"), 4, "30min")
    cells = trees.training_cells(train).toPandas()
    assert cells["rows"].sum() == len(steps) and len(cells) < len(steps)
    assert np.isclose(cells["total"].sum(), sum(v for _, v in points["t"]))


def test_search_of_tree_settings_gives_every_tag_its_own(sine):
    stages = SeriesStages(sine)
    space = {"n_estimators": (5, 10, "int"), "max_depth": (2, 4, "int"), "learning_rate": (0.05, 0.3, "log")}
    found = parameter_search.search("boosted_trees", stages.prepared("1h"), "1h", stages.size, trials=3, space=space).toPandas()
    assert len(found) == 6 and found["loss"].between(0, 50).all()
    assert found.groupby("tag")["place"].apply(sorted).tolist() == [[1, 2, 3]] * 2


def test_no_rows(make):
    stages = SeriesStages(make({"t": [(0, 1.0), (1, 2.0)]}))
    train, future = full_frames(stages.prepared("1h"), 3, "1h")
    assert trees.fit_predict(train.limit(0), future, stages.size, "1h", trees.ForestConfig(n_estimators=2)).count() == 0
    assert trees.best_splits(trees.training_cells(train)).count() == 0
    assert trees.training_cells(train).agg(F.sum("rows")).first()[0] == 2
