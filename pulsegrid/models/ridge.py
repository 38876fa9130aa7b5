"""Ridge regressions for many groups at once.

Rows are reduced to moment matrices (X'X, X'y, y'y) where they lie; the matrices add up, so only
they are shuffled, and the only thing solved per group is one small linear system.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.joins import SeriesProfile, attach

HELD_GROUPS = 1000  # groups a task holds before it passes their moments on
SLICE_ROWS = 50_000  # rows of a group that one task reduces to one matrix
SPREAD = 64

Lift = Callable[[np.ndarray, pd.DataFrame], np.ndarray]


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float)


def clustered(rows: DataFrame, keys: list[str], largest: int) -> DataFrame:
    """Rows dealt by group and slice, so that a task sees the rows of a slice together.

    A group of ``largest`` rows is cut into slices of about ``SLICE_ROWS``.
    """
    slices = max(1, -(-largest // SLICE_ROWS))
    by = [*keys, F.pmod(F.xxhash64("x", "z"), F.lit(slices))]
    return rows.repartition(*by).sortWithinPartitions(*by)


def moments(
    rows: DataFrame, keys: list[str], lift: Lift | None = None, carry: tuple[str, ...] = (),
    largest: int = 0,
) -> DataFrame:
    """Partial moment matrices per group of ``(x ARRAY<DOUBLE>, z DOUBLE)`` rows.

    ``lift`` maps the matrix of a group's rows to more columns; it may read the ``carry`` columns,
    which are constant within a group.  Every task hands on one matrix per group that it holds, so
    interleaved groups should be clustered first.  Those of a group above ``SLICE_ROWS`` rows are added
    up by part number, so that no group hands more than ``SPREAD`` of them to its solution.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fields = ["part int", "rows bigint", "zz double", "xz array<double>", "xx array<double>"]
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + fields)
    names = [*keys, "part", "rows", "zz", "xz", "xx"]

    def flush(held, part):
        return pd.DataFrame(
            [(*key, part, n, zz, xz, xx.ravel()) for key, (n, zz, xz, xx) in held.items()], columns=names
        )

    def reduce_task(frames):
        part, held = TaskContext.get().partitionId(), {}
        for frame in frames:
            for key, pdf in frame.groupby(keys, sort=False):
                x = _matrix(pdf["x"])
                x = x if lift is None else lift(x, pdf)
                z = pdf["z"].to_numpy(dtype=float)
                found = (len(z), float(z @ z), x.T @ z, x.T @ x)
                old = held.get(key)
                held[key] = found if old is None else tuple(a + b for a, b in zip(old, found))
            if len(held) > HELD_GROUPS:
                yield flush(held, part)
                held = {}
        if held:
            yield flush(held, part)

    parts = rows.select(*keys, *carry, "x", "z").mapInPandas(reduce_task, schema)
    if largest <= SLICE_ROWS:
        return parts

    def add(key, pdf):
        return pd.DataFrame([(*key, int(pdf["rows"].sum()), pdf["zz"].sum(),
                              _matrix(pdf["xz"]).sum(axis=0), _matrix(pdf["xx"]).sum(axis=0))], columns=names)

    parts = parts.withColumn("part", F.pmod("part", F.lit(SPREAD)))
    return parts.groupBy(*keys, "part").applyInPandas(add, schema)


def solution(system: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The solution, or NaN throughout if there is none: one failed fit must not end those beside it."""
    try:
        return np.linalg.solve(system, target)
    except np.linalg.LinAlgError:
        return np.full(np.shape(target), np.nan)


def _sparse(system: np.ndarray, target: np.ndarray, price: np.ndarray) -> np.ndarray:
    """The minimum of ``c'Sc/2 - t'c + sum(price |c|)``: coefficients with a price become exactly zero.

    Priceless coefficients are eliminated first.  Coordinate descent with soft thresholding on the
    others finds which of them live; the equations of these are then solved exactly.
    """
    if not (np.isfinite(system).all() and np.isfinite(target).all() and np.isfinite(price).all()):
        return np.full(len(target), np.nan)
    free, priced = np.flatnonzero(price == 0), np.flatnonzero(price > 0)
    if not len(priced):
        return solution(system, target)
    carried = solution(system[np.ix_(free, free)], np.column_stack([system[np.ix_(free, priced)], target[free]]))
    inner = system[np.ix_(priced, priced)] - system[np.ix_(priced, free)] @ carried[:, :-1]
    wanted = target[priced] - system[np.ix_(priced, free)] @ carried[:, -1]
    inner[np.diag_indices(len(priced))] += 1e-9 * max(1.0, np.abs(np.diag(inner)).max())
    cost, found = price[priced], np.zeros(len(priced))
    for _ in range(20):
        for _ in range(2000):
            largest = 0.0
            for j in range(len(priced)):
                pull = wanted[j] - inner[j] @ found + inner[j, j] * found[j]
                new = np.sign(pull) * max(abs(pull) - cost[j], 0.0) / inner[j, j]
                largest = max(largest, abs(new - found[j]) * np.sqrt(inner[j, j]))
                found[j] = new
            if largest < 1e-9 * (1.0 + np.abs(wanted).max()):
                break
        live = np.flatnonzero(found)
        exact = np.zeros(len(priced))
        if len(live):
            exact[live] = solution(inner[np.ix_(live, live)], wanted[live] - cost[live] * np.sign(found[live]))
        slack = np.abs(wanted - inner @ exact) - cost
        slack[live] = 0.0
        if (exact[live] * found[live] >= 0).all() and (slack <= 1e-9 * (1.0 + cost)).all():
            found = exact
            break
    coef = np.empty(len(target))
    coef[priced], coef[free] = found, carried[:, -1] - carried[:, :-1] @ found
    return coef


def solve(parts: DataFrame, keys: list[str], penalty: str = "penalty", price: str | None = None) -> DataFrame:
    """``coef``, residual deviation ``noise`` and ``variance`` per group, from the parts of its moments.

    ``penalty`` holds one normal prior precision per coefficient, ``price`` one inverse scale of a
    Laplace prior, both in units of the noise variance, which is estimated first: solve with a unit
    variance, then again with the residual variance.  ``variance`` is the one that ``coef`` was found with.
    A system that is singular or not finite has no coefficients: NaN in a task, NULL in the table.
    """
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["coef array<double>", "noise double", "variance double"])

    def solve_group(key, pdf):
        pdf = pdf.sort_values("part")
        count = int(pdf["rows"].sum())
        xz = _matrix(pdf["xz"]).sum(axis=0)
        xx = _matrix(pdf["xx"]).sum(axis=0).reshape(len(xz), len(xz))
        zz = float(pdf["zz"].sum())
        prior = np.asarray(pdf[penalty].iloc[0], dtype=float)
        cost = np.asarray(pdf[price].iloc[0], dtype=float) if price else np.zeros(len(xz))
        variance = 1.0
        for _ in range(3):
            used = variance
            system = xx + np.diag(np.maximum(variance * prior, 1e-9))
            coef = _sparse(system, xz, variance * cost)
            residual = zz - 2 * coef @ xz + coef @ xx @ coef
            variance = max(residual / max(1, count), 1e-6) if np.isfinite(residual) else np.nan
        frame = dict(zip(keys, ([k] for k in key)))
        return pd.DataFrame(frame | {"coef": [coef], "noise": [float(np.sqrt(variance))], "variance": [used]})

    return parts.groupBy(*keys).applyInPandas(solve_group, schema)


def optimality(rows: DataFrame, fitted: DataFrame, keys: list[str], size: SeriesProfile, price: str | None = None) -> DataFrame:
    """``(keys, j, coef, residual)``: how far each coefficient is from where its objective is flat.

    Computed anew from the ``(x, z)`` rows, per row: the gradient of the squared loss and the normal
    prior; a Laplace price is added with the coefficient's sign, and a coefficient of 0 may resist up to
    its price.
    """
    told = attach(rows, fitted, size, tuple(keys), rows_per_key=100)
    fit = F.aggregate(F.zip_with("x", "coef", lambda x, c: x * c), F.lit(0.0), lambda a, b: a + b)
    cost = F.col(price) if price else F.transform("penalty", lambda p: p * 0.0)
    terms = told.select(*keys, "variance", (fit - F.col("z")).alias("err"), F.posexplode(F.arrays_zip(
        F.col("x"), F.col("coef"), F.col("penalty"), cost.alias("cost"),
    )).alias("j", "t"))
    sums = terms.groupBy(*keys, "j").agg(
        F.sum(F.col("t.x") * F.col("err")).alias("g"), F.count("*").alias("rows"), F.first("variance").alias("v"),
        F.first("t.coef").alias("coef"), F.first("t.penalty").alias("p"), F.first("t.cost").alias("c"),
    )
    g = F.col("g") + F.greatest(F.col("v") * F.col("p"), F.lit(1e-9)) * F.col("coef")
    cost = F.col("v") * F.col("c")
    off = F.when(F.col("coef") == 0, F.greatest(F.abs(g) - cost, F.lit(0.0))).otherwise(F.abs(g + F.signum("coef") * cost))
    return sums.select(*keys, "j", "coef", (off / F.col("rows")).alias("residual"))


def dot(columns: list[Column], coef: Column) -> Column:
    """Linear prediction as one compiled expression."""
    total = columns[0] * coef[0]
    for j, column in enumerate(columns[1:], start=1):
        total = total + column * coef[j]
    return total


def predict_lifted(
    rows: DataFrame, fitted: DataFrame, keys: list[str], lift: Lift, keep: list[str], size: SeriesProfile
) -> DataFrame:
    """``score`` = lift(x) . coef and the fit's ``noise``, batch by batch; no group is gathered.

    The coefficients, one row per group, are joined to the rows and used once per run of rows of a
    group within a batch.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["score double", "noise double"])

    def score(frames):
        for frame in frames:
            for _, pdf in frame.groupby(keys, sort=False):
                found = lift(_matrix(pdf["x"]), pdf) @ np.asarray(pdf["coef"].iloc[0], dtype=float)
                yield pdf.assign(score=found)[[*keep, "score", "noise"]]

    sent = fitted.select(*keys, "coef", "noise")
    return attach(rows, sent, size, tuple(keys), rows_per_key=100).mapInPandas(score, schema)
