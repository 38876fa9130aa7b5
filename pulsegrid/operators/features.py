"""Model inputs: calendar features, positions, splits, subsamples, lags and scaling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import calendar_features
from pulsegrid.operators.joins import SeriesProfile, attach

TEST_SHARE = 0.2
LOOKBACK = 72


def time_index() -> Column:
    return (F.col("i") / F.greatest(F.lit(1), F.col("n"))).alias("time_idx")


def future_time_index() -> Column:
    return (1.0 + F.col("i") / F.greatest(F.lit(1), F.col("n"))).alias("time_idx")


def feature_frame(
    positioned: DataFrame,
    index: Column | None = None,
    builder: Callable[[Column], list[Column]] = calendar_features,
) -> DataFrame:
    """Calendar features of ``ds`` and the normalised position, beside the input columns."""
    return positioned.select("*", *builder(F.col("ds")), index if index is not None else time_index())


def train_length(n: Column, test_size: float = TEST_SHARE, clamp: bool = False) -> Column:
    """Rows in the training part: the first 80 %, one at least; the search keeps >= 50 and leaves >= 10."""
    split = F.greatest(F.lit(1), F.floor(n * F.lit(1.0 - test_size))).cast("bigint")
    return F.greatest(F.lit(50), F.least(n - 10, split)) if clamp else split


def holdout_split(positioned: DataFrame, test_size: float = TEST_SHARE, clamp: bool = False) -> DataFrame:
    """Mark the rows after the training part with ``is_test``."""
    return positioned.withColumn("is_test", F.col("i") >= train_length(F.col("n"), test_size, clamp))


def even_subsample(positioned: DataFrame, rows: int | Column) -> DataFrame:
    """At most ``rows`` (two or more) evenly spaced rows per tag, first and last included.

    Row ``i`` is kept when a sampling point falls on it: decided from ``i`` and ``n`` alone.
    """
    i, n = F.col("i"), F.col("n")
    rows = rows if isinstance(rows, Column) else F.lit(rows)
    scale = (n - 1) / (rows - 1)
    # Points are floor(k * scale); row i is hit exactly when some integer k lands in [i, i + 1).
    k = F.ceil(i / scale)
    hit = i == n - 1  # the last point is exact, whatever the rounding of k * scale
    for candidate in (k - 1, k, k + 1):
        inner = (candidate >= 0) & (candidate < rows - 1)
        hit = hit | (inner & (F.floor(candidate * scale) == i))
    return positioned.where((n <= rows) | hit)


def lag_sequences(
    positioned: DataFrame, lookback: int = LOOKBACK, value: str = "y", chunk: int = 100_000
) -> DataFrame:
    """Each row with the array ``x`` of its ``lookback`` predecessors; rows with fewer are dropped.

    Long tags are cut into chunks of positions, each preceded by a copy of the last ``lookback``
    rows before it, so a window never orders more than ``chunk + lookback`` rows.
    """
    block = F.floor(F.col("i") / chunk)
    shared = F.col("i") % chunk >= chunk - lookback
    homes = F.when(shared, F.array(block, block + 1)).otherwise(F.array(block))
    copies = positioned.withColumn("_block", F.explode(homes))
    before = Window.partitionBy("tag", "_block").orderBy("i").rowsBetween(-lookback, -1)
    return (
        copies.withColumn("x", F.collect_list(value).over(before))
        .where((F.floor(F.col("i") / chunk) == F.col("_block")) & (F.size("x") == lookback))
        .select(*positioned.columns, "x")
    )


def minmax_scale(split: DataFrame, size: SeriesProfile) -> DataFrame:
    """``scaled``: y mapped to 0-1 by the extremes of the training rows; constant tags map to 0."""
    train = F.when(~F.col("is_test"), F.col("y"))
    ranges = split.groupBy("tag").agg(F.min(train).alias("y_min"), F.max(train).alias("y_max"))
    spread = F.col("y_max") - F.col("y_min")
    scaled = (F.col("y") - F.col("y_min")) / F.when(spread == 0, 1.0).otherwise(spread)
    return attach(split, ranges, size).withColumn("scaled", scaled)


def minmax_inverse(scaled: Column, low: Column, high: Column) -> Column:
    spread = high - low
    return scaled * F.when(spread == 0, 1.0).otherwise(spread) + low


def standard_scale(split: DataFrame, columns: list[str], size: SeriesProfile) -> DataFrame:
    """``{c}_scaled`` for each column: centred and divided by the training rows' deviation."""
    def train(c):
        return F.when(~F.col("is_test"), F.col(c))

    stats = split.groupBy("tag").agg(
        *[F.avg(train(c)).alias(f"_{c}_mean") for c in columns],
        *[F.stddev_pop(train(c)).alias(f"_{c}_std") for c in columns],
    )
    def scaled(c):
        spread = F.when(F.col(f"_{c}_std") == 0, 1.0).otherwise(F.col(f"_{c}_std"))
        return ((F.col(c) - F.col(f"_{c}_mean")) / spread).alias(f"{c}_scaled")

    return attach(split, stats, size).select(*split.columns, *[scaled(c) for c in columns])
