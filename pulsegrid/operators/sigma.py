"""Robust (median / MAD) sigma thresholds, exceedance flags, counts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.joins import SeriesProfile, attach, profile
from pulsegrid.operators.quantiles import EXACT_LIMIT, group_quantiles
from pulsegrid.session import stage

MAD_TO_SIGMA = 1.4826
LEVELS = (1, 2, 3, 4, 5)


def sigma_summary(
    clean: DataFrame, size: SeriesProfile | None = None, exact_limit: int = EXACT_LIMIT
) -> DataFrame:
    """Median, MAD, sigma and the thresholds ``p1..p5`` above and ``n1..n5`` below the median."""
    size = size or profile(clean)
    medians = group_quantiles(clean, "value", {"median": 0.5}, size, exact_limit=exact_limit)
    if size.largest > exact_limit:
        medians = stage(medians, "medians")
    deviations = attach(clean, medians, size).select(
        "tag", "ts", F.abs(F.col("value") - F.col("median")).alias("deviation"), "median"
    )
    if size.largest > exact_limit:
        mads = group_quantiles(deviations, "deviation", {"mad": 0.5}, size, exact_limit=exact_limit)
        stats = medians.join(mads, "tag")
    else:  # the median travels with the deviations
        stats = deviations.groupBy("tag").agg(
            F.max("median").alias("median"), F.percentile("deviation", 0.5).alias("mad")
        )
    sigma = F.col("mad") * MAD_TO_SIGMA
    return stats.select(
        "tag", "median", "mad", sigma.alias("sigma"),
        *[(F.col("median") + sigma * k).alias(f"p{k}") for k in LEVELS],
        *[(F.col("median") - sigma * k).alias(f"n{k}") for k in LEVELS],
    )


def above(level: int) -> Column:
    return F.col("value") >= F.col(f"p{level}")


def below(level: int) -> Column:
    return F.col("value") <= F.col(f"n{level}")


def with_thresholds(
    clean: DataFrame, summary: DataFrame, size: SeriesProfile, levels=LEVELS
) -> DataFrame:
    names = [f"{side}{k}" for side in "pn" for k in levels]
    return attach(clean, summary.select("tag", *names), size)


def sigma_flags(clean: DataFrame, summary: DataFrame, size: SeriesProfile) -> DataFrame:
    """Each reading with ten flags; both comparisons include the threshold."""
    return with_thresholds(clean, summary, size).select(
        "tag", "ts", "value",
        *[above(k).alias(f"above{k}") for k in LEVELS],
        *[below(k).alias(f"below{k}") for k in LEVELS],
    )


def sigma_counts(clean: DataFrame, summary: DataFrame, size: SeriesProfile) -> DataFrame:
    """Readings at or beyond each threshold, ten counts per tag."""
    return with_thresholds(clean, summary, size).groupBy("tag").agg(
        *[F.count_if(above(k)).alias(f"above{k}") for k in LEVELS],
        *[F.count_if(below(k)).alias(f"below{k}") for k in LEVELS],
    )


def sigma_events(clean: DataFrame, summary: DataFrame, size: SeriesProfile) -> DataFrame:
    """One row per reading and exceeded level, in a single pass over the readings."""
    labels = [F.when(above(k), F.lit(f"Crossed Above {k}σ")) for k in LEVELS]
    labels += [F.when(below(k), F.lit(f"Crossed Below {k}σ")) for k in LEVELS]
    beyond = above(LEVELS[0]) | below(LEVELS[0])
    return (
        with_thresholds(clean, summary, size)
        .where(beyond)
        .select("tag", "ts", "value", F.explode(F.array_compact(F.array(*labels))).alias("type"))
    )
