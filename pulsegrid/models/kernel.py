"""Support-vector regression on random features of the calendar, over all training rows.

Residuals below ``epsilon`` cost nothing, larger ones in proportion to what is above it.  The fit is
found by reweighted least squares: the loss ``c max(0, |e| - epsilon)`` is ``c / 2 (|e - epsilon| +
|e + epsilon|)`` up to a constant, and each absolute value lies below a parabola that touches it at
the last residual, so every round lowers the objective.  Corners are rounded within ``CORNER``.
The RBF kernel has random Fourier features (Rahimi & Recht, 2007), the polynomial kernel products of
random signs (Kar & Karnick, 2012), the linear kernel its columns.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import CALENDAR_NAMES
from pulsegrid.models.frames import KEYS, fit_size, setting_keys, with_settings
from pulsegrid.models.ridge import SLICE_ROWS, _matrix, clustered, moments, predict_lifted, solution
from pulsegrid.operators.features import feature_frame, future_time_index
from pulsegrid.operators.joins import SeriesProfile, attach
from pulsegrid.session import stage

FEATURES = [*CALENDAR_NAMES, "time_idx"]


KERNELS = ("rbf", "linear", "poly")
DEGREES = (2, 3, 4)
CORNER = 0.01  # in deviations of the target
SETTLED = 1e-6  # largest change of a prediction between rounds, in deviations
ROUNDS, SPARK_ROUNDS = 400, 60


# The default settings.
@dataclass(frozen=True)
class KernelConfig:
    c: float = 15.0
    epsilon: float = 0.08  # in deviations of the target
    gamma: float = 1.0  # times 1 / number of features, which "scale" and "auto" mean here
    kernel: str = "rbf"
    degree: int = 3
    components: int = 128
    seed: int = 42
    trend_blend_weight: float = 0.35


def _lift(components: int, seed: int):
    width = len(FEATURES)
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(width, components))
    phases = rng.uniform(0.0, 2 * np.pi, components)
    signs = rng.choice([-1.0, 1.0], size=(max(DEGREES), width, components))

    def lift(x: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
        gamma = pdf["gamma"].to_numpy(dtype=float)[:, None]
        waves = np.cos((x @ directions) * np.sqrt(2 * gamma / width) + phases)
        waves *= np.sqrt(2.0 / components)
        kernel, degree = pdf["kernel"].to_numpy(), pdf["degree"].to_numpy()
        waves[kernel == "linear"] = 0.0
        for d in np.unique(degree[kernel == "poly"]):
            at = np.flatnonzero((kernel == "poly") & (degree == d))
            product = np.prod([x[at] @ signs[k] for k in range(int(d))], axis=0)
            waves[at] = product * (gamma[at] / width) ** (d / 2) / np.sqrt(components)
        linear = x * (kernel == "linear")[:, None]
        return np.hstack([np.ones((len(x), 1)), waves, linear])

    return lift


def _scaled(frame: DataFrame) -> "F.Column":
    return F.array(*[
        F.when(F.col("_std")[j] > 0, (F.col(name) - F.col("_mean")[j]) / F.col("_std")[j]).otherwise(0.0)
        for j, name in enumerate(FEATURES)
    ])


def reweighted(x: np.ndarray, z: np.ndarray, coef: np.ndarray, c: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and targets of the squared loss that lies above the tube loss and touches it at ``coef``."""
    residual = z - x @ coef
    upper = c / (2 * np.maximum(np.abs(residual - epsilon), CORNER))
    lower = c / (2 * np.maximum(np.abs(residual + epsilon), CORNER))
    return upper + lower, (upper * (z - epsilon) + lower * (z + epsilon)) / (upper + lower)


def _ridge(width: int) -> np.ndarray:
    """The penalty: half the square of every coefficient but the first."""
    return np.diag(np.r_[1e-6, np.ones(width - 1)])


FIT = ["coef array<double>", "noise double", "residual double", "inside double", "rounds int"]


def _summary(x: np.ndarray, z: np.ndarray, coef: np.ndarray, c: float, epsilon: float, rounds: int) -> tuple:
    weight, target = reweighted(x, z, coef, c, epsilon)
    slope = x.T @ (weight * (x @ coef - target)) + _ridge(len(coef)) @ coef
    error = z - x @ coef
    return coef, float(np.sqrt(np.mean(error**2))), float(np.abs(slope).max() / (c * len(z))), float(np.mean(np.abs(error) <= epsilon + CORNER)), rounds


def tube_fit(rows: DataFrame, keys: list[str], lift, largest: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(keys, coef, noise, residual, inside, rounds)`` per group of ``(x, z, c, epsilon, ...)`` rows.

    ``residual`` is the largest entry of the objective's gradient, per row and unit of ``c``;
    ``inside`` the share of rows within the tube.  Groups of up to ``slice_rows`` rows are one slice,
    so their rounds run where the slice lies.  If any group is larger, every round is one pass over the
    rows: weights from the last coefficients, moments added up per group, one small system solved; groups
    whose coefficients have come to rest take no part in later rounds.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + FIT)
    names = [*keys, *(f.split()[0] for f in FIT)]

    def settle(key, pdf):
        x, z = lift(_matrix(pdf["x"]), pdf), pdf["z"].to_numpy(float)
        c, epsilon = float(pdf["c"].iloc[0]), float(pdf["epsilon"].iloc[0])
        penalty, coef, done = _ridge(x.shape[1]), np.zeros(x.shape[1]), 0
        for done in range(1, ROUNDS + 1):
            weight, target = reweighted(x, z, coef, c, epsilon)
            new = solution((x.T * weight) @ x + penalty, x.T @ (weight * target))
            change, coef = np.abs(x @ (new - coef)).max(), new
            if not change >= SETTLED:  # a change that is not a number ends the rounds, too
                break
        return pd.DataFrame([(*key, *_summary(x, z, coef, c, epsilon, done))], columns=names)

    if largest <= slice_rows:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(tasks, *keys).groupBy(*keys).applyInPandas(settle, schema)
    return _fit_by_rounds(rows, keys, lift, largest, schema, names)


def _fit_by_rounds(rows: DataFrame, keys: list[str], lift, largest: int, schema: str, names: list[str]) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keyed = ", ".join(f"{k} {types[k]}" for k in keys)
    rows = stage(clustered(rows, keys, largest), "tube-rows")
    state = None

    def weighed(frames):
        for frame in frames:
            for key, pdf in frame.groupby(keys, sort=False):
                x, z = lift(_matrix(pdf["x"]), pdf), pdf["z"].to_numpy(float)
                coef = pdf["coef"].iloc[0]
                coef = np.zeros(x.shape[1]) if coef is None else np.asarray(coef, float)
                weight, target = reweighted(x, z, coef, float(pdf["c"].iloc[0]), float(pdf["epsilon"].iloc[0]))
                root = np.sqrt(weight)
                out = pd.DataFrame({"x": list(x * root[:, None]), "z": target * root})
                yield out.assign(**dict(zip(keys, key)))[[*keys, "x", "z"]]

    def solved(key, pdf):
        xz = _matrix(pdf["xz"]).sum(axis=0)
        xx = _matrix(pdf["xx"]).sum(axis=0).reshape(len(xz), len(xz))
        return pd.DataFrame([(*key, solution(xx + _ridge(len(xz)), xz))], columns=[*keys, "coef"])

    for done in range(1, SPARK_ROUNDS + 1):
        if state is None:
            told = rows.withColumn("coef", F.lit(None).cast("array<double>"))
        else:
            told = rows.join(state.where("not settled").select(*keys, "coef"), keys)
        parts = moments(told.mapInPandas(weighed, f"{keyed}, x array<double>, z double"), keys, largest=largest)
        new = parts.groupBy(*keys).applyInPandas(solved, f"{keyed}, coef array<double>")
        if state is None:
            state = stage(new.select(*keys, "coef", F.lit(False).alias("settled"), F.lit(done).alias("rounds")), "tube-state")
            continue
        old = state.select(*keys, F.col("coef").alias("old"), F.col("settled").alias("was"), F.col("rounds").alias("before"))
        moved = F.array_max(F.zip_with("coef", "old", lambda a, b: F.abs(a - b)))
        state = stage(old.join(new, keys, "left").select(
            *keys, F.coalesce("coef", "old").alias("coef"), (F.col("was") | (moved < 100 * SETTLED) | F.isnan(moved)).alias("settled"),
            F.when(F.col("was"), F.col("before")).otherwise(done).alias("rounds"),
        ), "tube-state")
        if state.where("not settled").isEmpty():
            break

    def measured(frames):
        for frame in frames:
            for key, pdf in frame.groupby(keys, sort=False):
                x, z = lift(_matrix(pdf["x"]), pdf), pdf["z"].to_numpy(float)
                coef, c, epsilon = np.asarray(pdf["coef"].iloc[0], float), float(pdf["c"].iloc[0]), float(pdf["epsilon"].iloc[0])
                weight, target = reweighted(x, z, coef, c, epsilon)
                error = z - x @ coef
                yield pd.DataFrame([(
                    *key, len(z), float(error @ error), int((np.abs(error) <= epsilon + CORNER).sum()),
                    x.T @ (weight * (x @ coef - target)) / c,
                )], columns=[*keys, "n", "ee", "held", "slope"])

    pieces = rows.join(state.select(*keys, "coef"), keys).mapInPandas(measured, f"{keyed}, n long, ee double, held long, slope array<double>")
    slope = F.aggregate(F.collect_list("slope"), F.transform(F.first("slope"), lambda v: v * 0.0), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    totals = pieces.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("ee").alias("ee"), F.sum("held").alias("held"), slope.alias("slope"))
    cs = rows.groupBy(*keys).agg(F.first("c").alias("c"))
    pull = F.transform("coef", lambda w, j: F.when(j == 0, w * 1e-6).otherwise(w) / F.col("c"))
    worst = F.array_max(F.zip_with("slope", pull, lambda a, b: F.abs(a + b)))
    return totals.join(state, keys).join(cs, keys).select(
        *keys, "coef", F.sqrt(F.col("ee") / F.col("n")).alias("noise"), (worst / F.col("n")).alias("residual"),
        (F.col("held") / F.col("n")).alias("inside"), F.col("rounds").cast("int").alias("rounds"),
    )


def fit_predict(
    train: DataFrame, future: DataFrame, size: SeriesProfile, freq: str,
    config: KernelConfig = KernelConfig(), trials: DataFrame | None = None,
) -> DataFrame:
    fitted, ahead, lift, keep = _fitted(train, future, size, config, trials)
    rows_ahead = ahead.select(*keep, "gamma", "kernel", "degree", _scaled(ahead).alias("x"))
    scored = predict_lifted(rows_ahead, fitted, list(KEYS), lift, keep, size)
    return scored.select(
        *future.columns,
        (F.col("score") * F.col("scale") + F.col("center")).alias("yhat"),
        (F.col("noise") * F.col("scale")).alias("residual_std"),
    )


def fit_summary(train: DataFrame, size: SeriesProfile, config: KernelConfig = KernelConfig()) -> DataFrame:
    """``(tag, fold, residual, inside, rounds, noise)`` of every fit; see ``tube_fit``."""
    fitted, *_ = _fitted(train, train.limit(0), size, config, None)
    return fitted.select(*KEYS, "residual", "inside", "rounds", "noise")


def _fitted(train: DataFrame, future: DataFrame, size: SeriesProfile, config: KernelConfig, trials: DataFrame | None):
    names = ("c", "epsilon", "gamma", "kernel", "degree")
    if trials is None and (config.kernel not in KERNELS or config.degree not in DEGREES):
        raise ValueError(f"kernel must be one of {', '.join(KERNELS)}, a degree one of {DEGREES}")

    def settings(frame):
        if trials is not None:
            keys = setting_keys(trials)
            told = trials if "epsilon" in trials.columns else trials.withColumn("epsilon", F.lit(config.epsilon))
            return with_settings(frame, told.select(*keys, *names), size)
        return frame.select("*", *[F.lit(asdict(config)[k]).alias(k) for k in names])

    rows = feature_frame(settings(train))
    stats = rows.groupBy(*KEYS).agg(
        F.array(*[F.avg(c) for c in FEATURES]).alias("_mean"),
        F.array(*[F.stddev_pop(c) for c in FEATURES]).alias("_std"),
        F.avg("y").alias("center"),
        F.greatest(F.stddev_pop("y"), F.lit(1e-12)).alias("scale"),
    )
    scaled = attach(rows, stats, size, KEYS, rows_per_key=20).select(
        *KEYS, *names, _scaled(rows).alias("x"),
        ((F.col("y") - F.col("center")) / F.col("scale")).alias("z"),
    )
    lift = _lift(config.components, config.seed)
    fitted = tube_fit(scaled, list(KEYS), lift, fit_size(train, size).largest)
    ahead = attach(
        feature_frame(settings(future), future_time_index()), stats, size, KEYS, rows_per_key=20
    )
    return fitted, ahead, lift, [*future.columns, "center", "scale"]
