"""Tree ensembles per tag: second-order boosting and bagged forests on calendar cells.

All calendar features follow from the hour that a grid point lies in, so training rows are first
reduced to cells ``(tag, fold, hour, position bin)`` with the count and sums of their targets, by
partial aggregation.  A cell stands for all its rows exactly, because splits need sums only.  A
fit has at most one cell per hour of its span and position bin, whatever the number of readings and the grid's
step; that bounded table is what one task sees of it.  Every task grows the trees of all fits that
it holds together, level by level, from histograms over (fit, node, feature, bin).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import CALENDAR_NAMES, calendar_features
from pulsegrid.models.frames import KEYS, setting_keys, with_settings
from pulsegrid.operators.joins import SeriesProfile
from pulsegrid.session import stage

FEATURES = [*CALENDAR_NAMES, "time_idx"]
POSITION_BINS = 256
HELD_CELLS, HELD_FITS = 100_000, 256  # cells and fits that a task grows together
FOREST_TREES = 10  # trees of a forest that are grown together
LEAST_GAIN = 1e-6


# The default settings of both ensembles.
@dataclass(frozen=True)
class ForestConfig:
    n_estimators: int = 300
    max_depth: int = 15
    min_samples_split: int = 5
    min_samples_leaf: int = 3
    max_features: float = 0.8
    bootstrap: bool = True
    random_state: int = 42
    trend_blend_weight: float = 0.3


@dataclass(frozen=True)
class BoostedConfig:
    n_estimators: int = 500
    max_depth: int = 3
    learning_rate: float = 0.25
    subsample: float = 0.7
    colsample_bytree: float = 0.9
    reg_lambda: float = 0.27
    reg_alpha: float = 0.12
    min_child_weight: int = 7
    random_state: int = 42
    trend_blend_weight: float = 0.3


# Growing -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """What stops a tree: one value per fit."""

    depth: np.ndarray
    least: np.ndarray  # sum of weights that a child needs
    least_split: np.ndarray  # sum of weights that a node needs to be split
    l2: np.ndarray
    l1: np.ndarray


def shrunk(gradient, l1):
    """The gradient sum after the penalty on absolute leaf values."""
    return np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0.0)


def binned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One histogram column per feature and distinct value: columns of all cells, and each column's feature."""
    columns, feature, first = np.empty(x.shape, np.int64), [], 0
    for j in range(x.shape[1]):
        values, place = np.unique(x[:, j], return_inverse=True)
        columns[:, j] = place + first
        feature += [j] * len(values)
        first += len(values)
    return columns, np.array(feature)


def grow(
    columns: np.ndarray, feature: np.ndarray, fit: np.ndarray, weight: np.ndarray, gradient: np.ndarray,
    limits: Limits, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> np.ndarray:
    """The leaf value of every cell in one new tree per fit.

    ``gradient`` is per unit of ``weight``, which is also the second derivative.  Cells of weight 0 are led to
    their leaves and take no part otherwise.  ``allowed(fit, path)`` tells for nodes which features
    may split them.
    """
    width, features = len(feature), columns.shape[1]
    first = np.searchsorted(feature, np.arange(features))
    leaf, leaves = np.full(len(fit), -1), 0
    rows, node, owner = np.arange(len(fit)), fit, np.arange(len(limits.depth))
    path = np.ones(len(owner), np.int64)
    for level in range(int(limits.depth.max()) + 1):
        count = len(owner)
        drawn = weight[rows]
        g = np.bincount(node, drawn * gradient[rows], count)
        h = np.bincount(node, drawn, count)
        open_ = (level < limits.depth[owner]) & (h >= np.maximum(limits.least_split[owner], 2 * limits.least[owner]))
        places = np.flatnonzero(open_)
        best, good = np.zeros(0, int), np.zeros(0, bool)
        if len(places):
            number = np.full(count, -1)
            number[places] = np.arange(len(places))
            own = number[node]
            told = np.flatnonzero((own >= 0) & (drawn > 0))
            at = (own[told][:, None] * width + columns[rows[told]]).ravel()
            shape = (len(places), width)
            left_h = np.bincount(at, np.repeat(drawn[told], features), len(places) * width).reshape(shape)
            left_g = np.bincount(at, np.repeat(drawn[told] * gradient[rows[told]], features), len(places) * width).reshape(shape)
            for sums in (left_h, left_g):  # from histograms to sums up to each column, feature by feature
                np.cumsum(sums, axis=1, out=sums)
                before = np.where(first > 0, sums[:, first - 1], 0.0)
                sums -= before[:, feature]
            l2, l1 = limits.l2[owner[places]][:, None], limits.l1[owner[places]][:, None]
            whole_g, whole_h, least = g[places][:, None], h[places][:, None], limits.least[owner[places]][:, None]
            right_g, right_h = whole_g - left_g, whole_h - left_h
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = shrunk(left_g, l1) ** 2 / (left_h + l2) + shrunk(right_g, l1) ** 2 / (right_h + l2)
                gain -= shrunk(whole_g, l1) ** 2 / (whole_h + l2)
            fits = (left_h >= least) & (right_h >= least) & allowed(owner[places], path[places])[:, feature]
            gain = np.where(fits & np.isfinite(gain), gain, -np.inf)
            best = gain.argmax(axis=1)
            good = gain[np.arange(len(places)), best] > LEAST_GAIN
        split = np.full(count, -1)
        split[places[good]] = np.arange(int(good.sum()))
        done = split[node] < 0
        closed = np.flatnonzero(split < 0)
        numbered = np.zeros(count, int)
        numbered[closed] = leaves + np.arange(len(closed))
        leaf[rows[done]] = numbered[node[done]]
        leaves += len(closed)
        if done.all():
            break
        rows, node = rows[~done], split[node[~done]]
        cut = best[good]
        right = columns[rows, feature[cut][node]] > cut[node]
        node = 2 * node + right
        owner = np.repeat(owner[places[good]], 2)
        path = (2 * path[places[good]][:, None] + [0, 1]).ravel()
    g = np.bincount(leaf, weight * gradient, leaves)
    h = np.bincount(leaf, weight, leaves)
    home = np.zeros(leaves, int)
    home[leaf] = fit
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(h > 0, -shrunk(g, limits.l1[home]) / (h + limits.l2[home]), 0.0)
    return value[leaf]


def _chance(seed: np.ndarray) -> np.ndarray:
    """Evenly spread numbers in 0-1 from whole numbers, the same on every machine."""
    z = seed.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _lowest(chances: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of each row the ``share`` of columns with the lowest numbers, one at least."""
    wanted = np.maximum(1, (share * chances.shape[1]).astype(int))
    return chances.argsort(axis=1).argsort(axis=1) < wanted[:, None]


@dataclass
class _Fits:
    """The cells of several fits."""

    columns: np.ndarray
    feature: np.ndarray
    fit: np.ndarray
    bounds: np.ndarray  # where each fit's cells begin, and the end
    rows: np.ndarray  # training rows of a cell, 0 for what is only predicted
    mean: np.ndarray
    seeds: np.ndarray
    settings: pd.DataFrame

    def parts(self) -> Iterator[tuple[int, slice]]:
        for k, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            yield k, slice(a, b)


def _boosted(fits: _Fits) -> np.ndarray:
    """Each tree is fitted to what the trees before it leave, on a share of the rows and features."""
    s = {name: fits.settings[name].to_numpy(float) for name in fits.settings}
    limits = Limits(s["max_depth"].astype(int), s["min_child_weight"], np.zeros(len(fits.seeds)), s["reg_lambda"], s["reg_alpha"])
    start = np.bincount(fits.fit, fits.rows * fits.mean) / np.bincount(fits.fit, fits.rows)
    found, rngs = start[fits.fit], [np.random.default_rng(seed) for seed in fits.seeds]
    features = fits.columns.shape[1]
    for tree in range(int(s["n_estimators"].max())):
        chances = np.stack([rng.random(features) for rng in rngs])
        drawn = np.concatenate([rngs[k].binomial(fits.rows[at], s["subsample"][k]) for k, at in fits.parts()]).astype(float)
        drawn *= (tree < s["n_estimators"])[fits.fit]
        open_ = _lowest(chances, s["colsample_bytree"])
        step = grow(fits.columns, fits.feature, fits.fit, drawn, found - fits.mean, limits, lambda fit, path: open_[fit])
        found += s["learning_rate"][fits.fit] * step
    return found


def _forest(fits: _Fits) -> np.ndarray:
    """The mean of trees on rows drawn with replacement; every node may use a new share of the features."""
    found = np.empty(len(fits.fit))
    features = np.arange(fits.columns.shape[1])
    for k, at in fits.parts():
        s, seed, size = fits.settings.iloc[k], fits.seeds[k], at.stop - at.start
        rows, mean, rng = fits.rows[at], fits.mean[at], np.random.default_rng(seed)
        center, total = np.average(mean, weights=rows), np.zeros(size)
        for first in range(0, int(s["n_estimators"]), FOREST_TREES):
            trees = min(FOREST_TREES, int(s["n_estimators"]) - first)
            drawn = rng.multinomial(int(rows.sum()), rows / rows.sum(), trees) if s["bootstrap"] else np.tile(rows, (trees, 1))

            def allowed(tree: np.ndarray, path: np.ndarray) -> np.ndarray:
                code = (seed + first + tree) * 1_000_003 + path * 8191
                return _lowest(_chance(code[:, None] * 64 + features), np.full(len(tree), float(s["max_features"])))

            def each(value: float) -> np.ndarray:
                return np.full(trees, float(value))

            limits = Limits(
                each(s["max_depth"]).astype(int), each(s["min_samples_leaf"]), each(s["min_samples_split"]), each(0), each(0),
            )
            value = grow(
                np.tile(fits.columns[at], (trees, 1)), fits.feature, np.repeat(np.arange(trees), size),
                drawn.ravel().astype(float), np.tile(center - mean, trees), limits, allowed,
            )
            total += value.reshape(trees, size).sum(axis=0)
        found[at] = center + total / int(s["n_estimators"])
    return found


# Spark ---------------------------------------------------------------------------------------


def _position(i: Column, n: Column) -> Column:
    """The position 0-1 of a training row, in bins when there are more rows than bins."""
    fine = F.floor(i * POSITION_BINS / F.greatest(n, F.lit(1))) / POSITION_BINS
    return F.when(n <= POSITION_BINS, i / F.greatest(n, F.lit(1))).otherwise(fine)


def training_cells(train: DataFrame) -> DataFrame:
    """``(tag, fold, hour_ds, time_idx, rows, total, squares, features...)`` from training rows."""
    cells = train.groupBy(
        *KEYS, F.date_trunc("hour", "ds").cast("timestamp_ntz").alias("hour_ds"), _position(F.col("i"), F.col("n")).alias("time_idx"),
    ).agg(F.count("y").alias("rows"), F.sum("y").alias("total"), F.sum(F.col("y") * F.col("y")).alias("squares"))
    return cells.select("*", *calendar_features(F.col("hour_ds")))


def best_splits(cells: DataFrame, config: BoostedConfig = BoostedConfig()) -> DataFrame:
    """``(tag, fold, feature, value, gain, left_rows, left_leaf, right_leaf)``: the first split of every fit.

    The histograms and gains of ``grow`` for the root, over all rows and features, as one
    aggregation and one running sum over a feature's values.  Equal gains go to the earlier feature
    and the lower value.
    """
    def part(g: Column) -> Column:
        return F.signum(g) * F.greatest(F.abs(g) - config.reg_alpha, F.lit(0.0))

    def score(g: Column, h: Column) -> Column:
        return part(g) * part(g) / (h + config.reg_lambda)

    means = cells.groupBy(*KEYS).agg(F.sum("rows").alias("h"), (F.sum("total") / F.sum("rows")).alias("start"))
    named = F.explode(F.array(*[
        F.struct(F.lit(j).alias("place"), F.lit(c).alias("feature"), F.col(c).alias("value")) for j, c in enumerate(FEATURES)
    ]))
    histogram = cells.select(*KEYS, "rows", "total", named.alias("at")).groupBy(*KEYS, "at").agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total"),
    )
    upto = Window.partitionBy(*KEYS, "at.place").orderBy("at.value").rowsBetween(Window.unboundedPreceding, 0)
    sums = histogram.join(means, list(KEYS)).select(
        *KEYS, "at", "h", F.sum("rows").over(upto).alias("lh"),
        F.sum(F.col("rows") * F.col("start") - F.col("total")).over(upto).alias("lg"),
    )
    right_h = F.col("h") - F.col("lh")
    gain = score(F.col("lg"), F.col("lh")) + score(-F.col("lg"), right_h)
    fits = (F.col("lh") >= config.min_child_weight) & (right_h >= config.min_child_weight)
    candidates = sums.where(fits).withColumn("gain", F.round(gain, 3)).where(F.col("gain") > LEAST_GAIN)
    best = F.max_by(F.struct("at", "gain", "lh", "lg", "h"), F.struct("gain", -F.col("at.place"), -F.col("at.value")))
    found = candidates.groupBy(*KEYS).agg(best.alias("s")).select(*KEYS, "s.*")
    return found.select(
        *KEYS, "at.feature", "at.value", "gain", F.col("lh").alias("left_rows"),
        (-part(F.col("lg")) / (F.col("lh") + config.reg_lambda)).alias("left_leaf"),
        (-part(-F.col("lg")) / (F.col("h") - F.col("lh") + config.reg_lambda)).alias("right_leaf"),
    )


def fit_predict(
    train: DataFrame, future: DataFrame, size: SeriesProfile, freq: str,
    config: ForestConfig | BoostedConfig, trials: DataFrame | None = None,
) -> DataFrame:
    """``future`` with ``yhat`` and the fit's ``residual_std``.

    Future points lie behind all training positions, so their hours are cells too; the cells of a
    fit are dealt to one task together, which grows its trees and leads all cells through them.
    """
    names = [n for n in asdict(config) if n not in ("trend_blend_weight", "random_state")]
    ensemble = _forest if isinstance(config, ForestConfig) else _boosted
    hour = F.date_trunc("hour", "ds").cast("timestamp_ntz").alias("hour_ds")
    ahead = future.select(*KEYS, hour).distinct().select(
        *KEYS, "hour_ds", F.lit(1.0).alias("time_idx"), F.lit(0).cast("long").alias("rows"),
        F.lit(0.0).alias("total"), F.lit(0.0).alias("squares"), *calendar_features(F.col("hour_ds")),
    )
    cells = training_cells(train).unionByName(ahead)
    if trials is not None:
        own = [n for n in names if n in trials.columns]
        keys = setting_keys(trials)
        cells = with_settings(cells, trials.select(*keys, *own), size)
        names, fixed = own, {n: v for n, v in asdict(config).items() if n not in own}
    else:
        names, fixed = [], asdict(config)
    seed = config.random_state
    wanted = [*KEYS, "hour_ds", "time_idx", "rows", "total", "squares", *CALENDAR_NAMES, *names]
    schema = "tag string, fold string, hour_ds timestamp_ntz, yhat double, residual_std double"

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*KEYS, "time_idx", "hour_ds"], kind="stable").reset_index(drop=True)
        known = frame.groupby(list(KEYS))["rows"].transform("sum") > 0
        frame = frame[known.to_numpy()].reset_index(drop=True)
        if not len(frame):
            return frame[[*KEYS, "hour_ds"]].assign(yhat=0.0, residual_std=0.0)
        starts = np.flatnonzero(~frame.duplicated(list(KEYS)).to_numpy())
        bounds = np.append(starts, len(frame))
        fit = np.repeat(np.arange(len(starts)), np.diff(bounds))
        columns, feature = binned(frame[FEATURES].to_numpy(float))
        rows, total = frame["rows"].to_numpy(), frame["total"].fillna(0.0).to_numpy(float)
        heads = frame.iloc[starts]
        settings = pd.DataFrame({n: heads[n].to_numpy() for n in names} | {n: [v] * len(starts) for n, v in fixed.items()})
        seeds = np.array([zlib.crc32(f"{t}\0{f}".encode()) + seed for t, f in zip(heads["tag"], heads["fold"])])
        mean = np.divide(total, rows, out=np.zeros(len(rows)), where=rows > 0)
        found = ensemble(_Fits(columns, feature, fit, bounds, rows, mean, seeds, settings))
        count = np.bincount(fit, rows)
        left = np.bincount(fit, total - rows * found) / count
        square = np.bincount(fit, frame["squares"].fillna(0.0).to_numpy(float) - 2 * found * total + rows * found**2) / count
        spread = np.sqrt(np.maximum(square - left**2, 0.0))
        out = frame[[*KEYS, "hour_ds"]].assign(yhat=found, residual_std=spread[fit])
        return out[rows == 0]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, cells, fits = [], 0, 0
        for frame in frames:
            for _, part in frame.groupby(list(KEYS), sort=False):
                same = held and tuple(held[-1].iloc[0][list(KEYS)]) == tuple(part.iloc[0][list(KEYS)])
                if not same and (cells >= HELD_CELLS or fits >= HELD_FITS):
                    yield solve(pd.concat(held))
                    held, cells, fits = [], 0, 0
                held.append(part)
                cells, fits = cells + len(part), fits + (not same)
        if held:
            yield solve(pd.concat(held))

    # A fixed number of partitions: small tables of cells are much work, so they are not put together.
    tasks = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select(*wanted).repartition(tasks, *KEYS).sortWithinPartitions(*KEYS)
    told = stage(dealt.mapInPandas(task, schema), "trees")
    keyed = future.withColumn("hour_ds", hour)
    return keyed.join(told, [*KEYS, "hour_ds"]).select(*future.columns, "yhat", "residual_std")
