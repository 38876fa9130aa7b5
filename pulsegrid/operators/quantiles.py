"""Exact per-group quantiles (linear interpolation) that do not depend on the group size.

Small groups use Spark's exact ``percentile``, which keeps every distinct value of a group in
memory.  Larger groups are narrowed first: a bounded sketch brackets each wanted rank, readings
outside the brackets are merely counted, and only the values inside a bracket are kept, with
multiplicities.  The sketch decides how much is kept, never the result: a rank that falls outside
its bracket is noticed by the exact counts, and the brackets are widened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.joins import SeriesProfile, attach, profile
from pulsegrid.session import stage

EXACT_LIMIT = 100_000
ACCURACY = 10_000
BINS = 1024


def group_quantiles(
    rows: DataFrame,
    value: str,
    probs: dict[str, float],
    size: SeriesProfile | None = None,
    keys: tuple[str, ...] = ("tag",),
    exact_limit: int = EXACT_LIMIT,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group with a column per entry of ``probs``; NULL values are ignored.

    A group without any value has a row of NULLs, whatever the size of the others.
    """
    size = size or profile(rows, keys)
    if size.largest <= exact_limit:
        wanted = F.array(*[F.lit(q) for q in probs.values()])
        found = rows.groupBy(*keys).agg(F.percentile(value, wanted).alias("_q"))
        return found.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])

    stamp = [c for c in ("ts",) if c in rows.columns]  # spreads equal values in a salted join
    groups = rows.select(*keys).distinct()
    rows = rows.select(*keys, value, *stamp).where(F.col(value).isNotNull())
    margin = 2.0 / accuracy
    while True:
        counts = stage(_bracket(rows, value, probs, size, keys, margin, accuracy), "quantile")
        kept = _largest_group(counts, keys)
        while kept > exact_limit:
            counts = stage(_thin(counts, probs, size, keys, exact_limit), "quantile")
            before, kept = kept, _largest_group(counts, keys)
            if kept >= before:
                break
        picked = _pick(counts, probs, keys)
        if picked.where("_missed").isEmpty():
            return groups.join(picked.drop("_missed"), list(keys), "left")
        margin *= 16


def _bracket(rows, value, probs, size, keys, margin, accuracy) -> DataFrame:
    """Value counts inside the brackets; each stretch between brackets is one counted gap."""
    marks = [min(1.0, max(0.0, q + d)) for q in probs.values() for d in (-margin, margin)]
    cuts = rows.groupBy(*keys).agg(
        F.percentile_approx(value, [float(m) for m in marks], accuracy).alias("_cuts")
    )
    v = F.col(value)
    lows = [F.col("_cuts")[2 * i] for i in range(len(probs))]
    highs = [F.col("_cuts")[2 * i + 1] for i in range(len(probs))]
    inside = F.lit(False)
    for low, high in zip(lows, highs):
        inside = inside | v.between(low, high)
    lowest = F.lit(float("-inf"))
    below = F.greatest(lowest, *[F.when(high < v, high).otherwise(lowest) for high in highs])
    zone = sum((F.when(high < v, 1).otherwise(0) for high in highs), F.lit(0))
    return (
        attach(rows, cuts, size, keys)
        .select(
            *keys,
            zone.alias("_zone"),
            F.when(inside, v).otherwise(below).alias("_at"),
            (~inside).alias("_gap"),
        )
        .groupBy(*keys, "_zone", "_at", "_gap")
        .agg(F.count("*").alias("_n"))
    )


def _largest_group(counts: DataFrame, keys) -> int:
    return counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _ranks(probs: dict[str, float], total: Column) -> dict[str, tuple[Column, Column, Column]]:
    """Zero-based position of each quantile, with the two order statistics around it."""
    found = {}
    for name, q in probs.items():
        position = (total - 1) * F.lit(q)
        found[name] = (position, F.floor(position), F.ceil(position))
    return found


def _holds(rank: Column) -> Column:
    return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))


def _cumulate(counts: DataFrame, keys, order: list[str]) -> DataFrame:
    everything = Window.partitionBy(*keys)
    running = everything.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "*",
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
        F.sum("_n").over(everything).alias("_total"),
    )


def _thin(counts: DataFrame, probs, size: SeriesProfile, keys, limit: int) -> DataFrame:
    """Of groups above ``limit`` rows, keep single values only in the bins that hold a wanted rank.

    Bins are of equal width within each bracket; the stretches between the kept ones become gaps.
    """
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("_rows"))
    big = stage(sizes.where(F.col("_rows") > limit).select(*keys, F.lit(True).alias("_big")), "big")
    few = SeriesProfile(big.count(), size.largest, size.tag_bytes)
    told = attach(counts, big, few, keys, "left")
    small_part = told.where(F.col("_big").isNull()).drop("_big")
    counts = told.where("_big").drop("_big")

    zone = [*keys, "_zone"]
    real = F.when(~F.col("_gap"), F.col("_at"))
    edges = counts.groupBy(*zone).agg(F.min(real).alias("_lo"), F.max(real).alias("_hi"))
    share = (F.col("_at") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS
    binned = attach(counts, edges, few, tuple(zone), rows_per_key=len(probs) + 1).select(
        *counts.columns,
        F.when(F.col("_at") < F.coalesce(F.col("_lo"), F.lit(float("inf"))), -1)
        .when(F.col("_at") > F.col("_hi"), BINS + 1)
        .when(F.col("_hi") == F.col("_lo"), 0)
        .otherwise(F.least(F.floor(share), F.lit(BINS))).cast("int").alias("_bin"),
    )
    bins = binned.groupBy(*zone, "_bin").agg(F.sum("_n").alias("_n"))
    wanted = F.lit(False)
    for _, low, high in _ranks(probs, F.col("_total")).values():
        wanted = wanted | _holds(low) | _holds(high)
    placed = _cumulate(bins, keys, ["_zone", "_bin"]).withColumn("_keep", wanted)
    ordered = Window.partitionBy(*keys).orderBy("_zone", "_bin")
    segment = F.sum(F.col("_keep").cast("int")).over(ordered)
    labels = placed.select(*zone, "_bin", "_keep", segment.alias("_segment"))
    most = (len(probs) + 1) * (BINS + 3)
    labelled = attach(binned, labels, few, (*zone, "_bin"), rows_per_key=most)
    single = labelled.where("_keep").select(*counts.columns)
    merged = labelled.where(~F.col("_keep")).groupBy(*keys, "_segment").agg(
        F.max("_zone").alias("_zone"), F.max("_at").alias("_at"), F.sum("_n").alias("_n")
    )
    gaps = merged.select(*zone, "_at", F.lit(True).alias("_gap"), "_n")
    return small_part.unionByName(single).unionByName(gaps)


def _pick(counts: DataFrame, probs, keys) -> DataFrame:
    placed = _cumulate(counts, keys, ["_at", "_gap"])
    outputs, missed = [], F.lit(False)
    for name, (position, low, high) in _ranks(probs, F.col("_total")).items():
        at_low = F.max(F.when(_holds(low) & ~F.col("_gap"), F.col("_at")))
        at_high = F.max(F.when(_holds(high) & ~F.col("_gap"), F.col("_at")))
        fraction = F.max(position - low)
        outputs.append((at_low * (1 - fraction) + at_high * fraction).alias(name))
        missed = missed | at_low.isNull() | at_high.isNull()
    return placed.groupBy(*keys).agg(*outputs, missed.alias("_missed"))
