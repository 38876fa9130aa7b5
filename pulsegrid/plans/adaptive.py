"""Adaptive hyper-parameter search: later trials are drawn where earlier ones did well, and most trials see few rows.

A search runs in rounds.  Every tag gets a batch of trials of its own, proposed from the densities of its
better and worse trials so far.  The batch passes through rungs of growing training lengths; only the best
part of it reaches the next, so a round copies about as many rows as ``log(batch)`` full fits, not ``batch``.
Rounds follow each other; within a rung all trials of all tags are one job.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.score import error_metrics
from pulsegrid.models.frames import fit_size, holdout_frames
from pulsegrid.operators.joins import SeriesProfile, attach
from pulsegrid.plans.search import METRICS, SPACES, fit_trials, searchable
from pulsegrid.session import stage

LEAST_ROWS = 50  # a rung trains on at least so many rows, as far as there are
HISTORY = "tag string, fold string, round int, rung int, loss double, u array<double>"


@dataclass(frozen=True)
class SearchPlan:
    """``rounds`` batches of ``batch`` trials a tag; one in ``eta`` reaches a rung ``eta`` times as long.

    Each trial is the best of ``candidates`` draws.
    """

    rounds: int = 3
    batch: int = 9
    eta: int = 3
    candidates: int = 24
    seed: int = 42

    @property
    def rungs(self) -> list[tuple[int, float]]:
        """``(trials, share of the training rows)`` of every rung of a round."""
        count = 1
        while self.batch // self.eta**count >= 1 and self.eta > 1:
            count += 1
        return [(max(1, self.batch // self.eta**k), self.eta ** -(count - 1 - k)) for k in range(count)]


def _options(bounds) -> int:
    """The number of choices, 0 for a number."""
    return len(bounds) if isinstance(bounds, list) else 0


def settings_of(u: Column, space: dict) -> list[Column]:
    """The settings that a trial's place ``u`` in the unit cube stands for; a choice is its number."""
    found = []
    for j, (name, bounds) in enumerate(space.items()):
        at = u[j]
        if isinstance(bounds, list):
            value = F.element_at(F.array(*[F.lit(b) for b in bounds]), at.cast("int") + 1)
        else:
            low, high, kind = bounds
            if kind == "log":
                value = F.exp(math.log(low) + at * (math.log(high) - math.log(low)))
            elif kind == "float":
                value = low + at * (high - low)
            else:
                step = int(kind[3:] or 1)
                steps = (high - low) // step + 1
                value = (low + step * F.least(F.floor(at * steps), F.lit(steps - 1))).cast("bigint")
        found.append(value.alias(name))
    return found


def split_trials(history: DataFrame) -> DataFrame:
    """``(tag, good, rest)``: places of the best third of each tag's trials, and of the others.

    Trials that reached a longer rung come first, then the smaller loss, then the earlier ``fold``.  A tag
    holds its trials only, whose number the search sets.
    """
    every = Window.partitionBy("tag")
    order = every.orderBy(F.desc("rung"), "loss", "fold")
    placed = history.withColumn("_place", F.row_number().over(order)).withColumn("_n", F.count("*").over(every))
    good = F.col("_place") <= F.ceil(F.col("_n") / 3)
    def places(these):
        return F.transform(F.sort_array(F.collect_list(F.when(these, F.struct("fold", "u")))), lambda t: t["u"])
    return placed.groupBy("tag").agg(places(good).alias("good"), places(~good).alias("rest"))


def density(trials: Column, j: int, at: Column, options: int) -> Column:
    """Density of setting ``j`` at ``at`` as the trials tell it, with one trial's weight spread evenly.

    Numbers: normal kernels of width ``1 / (1 + sqrt(trials))`` on the unit interval.  Choices: counts.
    """
    n = F.size(trials)
    if options:
        same = F.aggregate(trials, F.lit(0.0), lambda a, t: a + (t[j] == at).cast("double"))
        return (same + 1.0) / (n + options)
    width = kernel_width(n)
    peak = 1.0 / (width * math.sqrt(2 * math.pi))
    near = F.aggregate(trials, F.lit(0.0), lambda a, t: a + F.exp(-F.pow((t[j] - at) / width, F.lit(2.0)) / 2))
    return (near * peak + 1.0) / (n + 1)


def kernel_width(n: Column) -> Column:
    return 1.0 / (1.0 + F.sqrt(n.cast("double")))


def preference(good: Column, rest: Column, at: list[Column], space: dict) -> Column:
    """How much likelier a place is among the good trials than among the others, as a logarithm."""
    total = F.lit(0.0)
    for j, bounds in enumerate(space.values()):
        options = _options(bounds)
        total = total + F.log(density(good, j, at[j], options)) - F.log(density(rest, j, at[j], options))
    return total


def propose(tags: DataFrame, history: DataFrame, space: dict, plan: SearchPlan, turn: int) -> DataFrame:
    """``(tag, fold, u)``: the next batch of every tag.

    Candidates are drawn from the good trials' densities (evenly, as long as there are none) and the
    one that is preferred most is kept.  Draws are hashes of what is drawn, so reruns agree.
    """
    known = tags.join(split_trials(history), "tag", "left")
    empty = F.array().cast("array<array<double>>")
    good, rest = F.coalesce("good", empty), F.coalesce("rest", empty)
    drawn = (
        known.select("tag", good.alias("good"), rest.alias("rest"))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(plan.batch - 1))))
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(plan.candidates - 1))))
    )

    def even(j, part):
        parts = F.xxhash64("tag", "slot", "draw", F.lit(turn), F.lit(j), F.lit(part), F.lit(plan.seed))
        return F.pmod(parts, F.lit(1 << 30)) / float(1 << 30)

    count = F.size("good")
    at = []
    for j, bounds in enumerate(space.values()):
        options = _options(bounds)
        told = F.get(F.get("good", F.floor(even(j, 0) * (count + 1)).cast("int")), F.lit(j))
        if options:
            value = F.coalesce(told, F.floor(even(j, 1) * options).cast("double"))
        else:
            bell = F.sqrt(-2.0 * F.log(1.0 - even(j, 1))) * F.cos(2 * math.pi * even(j, 2))
            moved = F.abs(told + bell * kernel_width(count))
            inside = F.least(F.greatest(F.when(moved > 1, 2.0 - moved).otherwise(moved), F.lit(0.0)), F.lit(1.0))
            value = F.coalesce(inside, even(j, 1))
        at.append(value)
    drawn = drawn.withColumn("u", F.array(*at))
    liked = preference(F.col("good"), F.col("rest"), [F.col("u")[j] for j in range(len(space))], space)
    best = drawn.groupBy("tag", "slot").agg(F.max_by("u", F.struct(liked, -F.col("draw"))).alias("u"))
    return best.select("tag", F.format_string("%02d-%03d", F.lit(turn), F.col("slot")).alias("fold"), "u")


def rung_frames(
    positioned: DataFrame, alive: DataFrame, share: float, size: SeriesProfile, batch: int
) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of the trials that are ``alive``: the latest ``share`` of the training part.

    At least ``LEAST_ROWS`` rows are trained on, all if there are fewer.
    """
    train, test = holdout_frames(positioned, clamp=True)
    length = F.least(F.col("n"), F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("n") * share))).cast("bigint")
    folds = alive.groupBy("tag").agg(F.array_sort(F.collect_list("fold")).alias("folds"))

    def copied(frame):
        told = attach(frame, folds, size, rows_per_key=batch)
        return told.withColumn("fold", F.explode("folds")).drop("folds")

    cut = train.withColumn("_m", length).where(F.col("i") >= F.col("n") - F.col("_m"))
    cut = cut.select("tag", "ds", "y", (F.col("i") - F.col("n") + F.col("_m")).alias("i"), F.col("_m").alias("n"))
    return copied(cut), copied(test.drop("fold").withColumn("n", length))


def promoted(scored: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best trials of every tag by loss; ties by ``fold``."""
    order = Window.partitionBy("tag").orderBy("loss", "fold")
    return scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= keep).drop("_place")


def adaptive_search(
    model: str, positioned: DataFrame, freq: str, size: SeriesProfile, plan: SearchPlan = SearchPlan(),
    metric: str = "rmse", space: dict | None = None,
) -> DataFrame:
    """``(tag, fold, round, rung, loss, u)``: every trial at the longest rung that it reached.

    A trial whose fit fails has an infinite loss.  ``settings_of`` tells the settings of ``u``.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    space = space or SPACES[model]
    spark = positioned.sparkSession
    tags = positioned.select("tag").distinct()
    history = spark.createDataFrame([], HISTORY)
    size = fit_size(positioned, size)
    many = size.with_groups(plan.batch)
    for turn in range(plan.rounds):
        alive = stage(propose(tags, history, space, plan, turn), "proposed")
        for rung, (count, share) in enumerate(plan.rungs):
            if rung:
                alive = promoted(scored, count).select("tag", "fold", "u")
            train, test = rung_frames(positioned, alive, share, size, plan.batch)
            trials = alive.select("tag", "fold", *settings_of(F.col("u"), space))
            predicted = fit_trials(model, train, test, freq, many, trials, space)
            errors = predicted.groupBy("tag", "fold").agg(*error_metrics(F.col("actual"), F.col("yhat")))
            value = F.col(metric)
            loss = F.when(value.isNull() | F.isnan(value), float("inf")).otherwise(value)
            scored = stage(alive.join(errors, ["tag", "fold"], "left").select(
                "tag", "fold", F.lit(turn).alias("round"), F.lit(rung).alias("rung"), loss.alias("loss"), "u",
            ), "scored")
            older = history.join(scored.select("tag", "fold"), ["tag", "fold"], "left_anti")
            history = older.unionByName(scored)
        history = stage(history, "trials")
    return history


def adaptive_searches(
    models: list[str], positioned: DataFrame, freq: str, size: SeriesProfile, plan: SearchPlan = SearchPlan(), metric: str = "rmse",
) -> list[DataFrame]:
    """The ``adaptive_search`` of every model, side by side: a search's rungs wait for each other, models do not."""
    if not models:
        return []
    with ThreadPoolExecutor(len(models)) as pool:
        begun = [
            pool.submit(inheritable_thread_target(positioned.sparkSession)(adaptive_search), m, positioned, freq, size, plan, metric)
            for m in models
        ]
        return [b.result() for b in begun]


def best_trials(history: DataFrame, space: dict) -> DataFrame:
    """The best trial of every tag among those that reached the longest rung, with its settings."""
    order = Window.partitionBy("tag").orderBy(F.desc("rung"), "loss", "fold")
    first = history.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == 1)
    return first.select("tag", "fold", "loss", *settings_of(F.col("u"), space))


def tune_adaptively(
    model: str, positioned: DataFrame, freq: str, size: SeriesProfile, plan: SearchPlan, metric: str = "rmse",
) -> DataFrame | None:
    """Every tag's own best settings as a table; None for a model without a space.

    As with random trials, the rows that will score the winner play no part.
    """
    if model not in SPACES:
        return None
    history = adaptive_search(model, searchable(positioned), freq, size, plan, metric)
    best = best_trials(history, SPACES[model]).drop("fold", "loss")
    return stage(best.withColumn("interval_width", F.lit(0.9)) if model == "additive" else best, "settings")


def importance(history: DataFrame, space: dict, bins: int = 4) -> DataFrame:
    """``(tag, setting, trials, explained, share)``: variance of the loss that a setting explains alone.

    ``explained`` is the variance between the means of ``bins`` equal parts of the setting's range (or its
    choices) over the whole variance; ``share`` is its part of the sum over the settings.  Trials without
    a finite loss do not count; a constant loss is explained by nothing.
    """
    level = [
        (F.col("u")[j] if _options(bounds) else F.least(F.floor(F.col("u")[j] * bins), F.lit(bins - 1))).cast("int")
        for j, bounds in enumerate(space.values())
    ]
    told = F.array(*[F.struct(F.lit(name).alias("setting"), k.alias("level")) for name, k in zip(space, level)])
    finite = F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") < float("inf"))
    cells = history.where(finite).select("tag", "loss", F.explode(told).alias("t")).groupBy("tag", "t.setting", "t.level").agg(
        F.count("*").alias("n"), F.avg("loss").alias("mean"), F.var_pop("loss").alias("var"),
    )
    every = Window.partitionBy("tag", "setting")
    centre = F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every)
    sums = cells.withColumn("_off", F.pow(F.col("mean") - centre, F.lit(2.0))).groupBy("tag", "setting").agg(
        F.sum("n").alias("trials"), F.sum(F.col("n") * F.col("_off")).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"),
    )
    whole = F.col("between") + F.col("within")
    part = F.when(whole > 0, F.col("between") / whole).otherwise(0.0)
    found = sums.select("tag", "setting", "trials", part.alias("explained"))
    total = F.sum("explained").over(Window.partitionBy("tag"))
    return found.withColumn("share", F.when(total > 0, F.col("explained") / total).otherwise(0.0))
