"""Regular grids: resampling with forward fill, future grids, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import freq_us, from_us, to_us
from pulsegrid.operators.joins import SeriesProfile, attach, profile
from pulsegrid.session import stage
from pulsegrid.sources.series import SLICE_BINS, explode_grid, scan_aggregate, with_previous


def resample_grid(series: DataFrame, freq: str = "1h", slice_bins: int = SLICE_BINS) -> DataFrame:
    """Bin means on a regular grid, each carried forward over the empty bins after it.

    Gives ``(tag, ds, y, i, n)`` with the position ``i`` and the length ``n`` of the tag's grid.
    Only non-empty bins are put in order, slice by slice; each one yields itself and the empty bins
    before it, which hold the previous bin's mean, so no grid table is built or joined.
    """
    width = freq_us(freq)
    bins = scan_aggregate(series, freq).where(F.col("value").isNotNull())
    bins = bins.select("tag", "value", to_us(F.col("ts")).alias("us"))
    ends = bins.groupBy("tag").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    paired = with_previous(bins, "us", ["value"], width, slice_bins)
    start = F.coalesce(F.col("_prev.us") + width, F.col("us"))
    filled = explode_grid(paired, start, F.col("us"), width, slice_bins, "at").join(ends, "tag")
    return filled.select(
        "tag", from_us(F.col("at")).alias("ds"),
        F.when(F.col("at") == F.col("us"), F.col("value")).otherwise(F.col("_prev.value")).alias("y"),
        ((F.col("at") - F.col("first_us")) / width).cast("bigint").alias("i"),
        ((F.col("last_us") - F.col("first_us")) / width + 1).cast("bigint").alias("n"),
    )


def resample_ffill(series: DataFrame, freq: str = "1h") -> DataFrame:
    return resample_grid(series, freq).select("tag", "ds", "y")


def as_prepared(series: DataFrame) -> DataFrame:
    """Readings used as they come, without resampling."""
    return series.where(F.col("value").isNotNull()).select(
        "tag", F.col("ts").alias("ds"), F.col("value").alias("y")
    )


def prepare(series: DataFrame, freq: str = "1h", auto_resample: bool = True) -> DataFrame:
    return resample_ffill(series, freq) if auto_resample else as_prepared(series)


ORDER_LIMIT = 1_000_000


def with_position(
    rows: DataFrame,
    size: SeriesProfile | None = None,
    ts: str = "ds",
    limit: int = ORDER_LIMIT,
) -> DataFrame:
    """Zero-based position ``i`` by time and length ``n``, on any timestamps.

    Tags up to ``limit`` rows are numbered by one window.  Larger ones are cut into time slices
    that are numbered separately; the slices' counts give each slice its offset.
    """
    size = size or profile(rows)
    tag = Window.partitionBy("tag")
    if size.largest <= limit:
        return rows.select(
            "*",
            (F.row_number().over(tag.orderBy(ts)) - 1).cast("bigint").alias("i"),
            F.count("*").over(tag).alias("n"),
        )
    us = to_us(F.col(ts))
    span = rows.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    width = max(1, (span["hi"] - span["lo"]) * limit // (4 * size.largest))
    while True:
        sliced = rows.withColumn("_slice", F.floor(us / width))
        counts = stage(sliced.groupBy("tag", "_slice").agg(F.count("*").alias("_c")), "slices")
        found = counts.agg(F.max("_c").alias("largest"), F.count("*").alias("slices")).first()
        if found["largest"] <= limit or width == 1:
            break
        width = max(1, width // 16)  # readings crowd into a short time: cut it finer
    running = tag.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tag", "_slice",
        F.coalesce(F.sum("_c").over(running), F.lit(0)).alias("_offset"),
        F.sum("_c").over(tag).alias("n"),
    )
    inside = Window.partitionBy("tag", "_slice").orderBy(ts)
    slices = SeriesProfile(found["slices"], found["largest"], size.tag_bytes)
    placed = attach(sliced, offsets, slices, ("tag", "_slice"))
    return placed.select(
        *rows.columns,
        (F.row_number().over(inside) - 1 + F.col("_offset")).cast("bigint").alias("i"),
        "n",
    )


def future_grid(prepared: DataFrame, steps: int, freq: str) -> DataFrame:
    """``steps`` grid points after each tag's last one, numbered from zero in ``i``."""
    width = freq_us(freq)
    last = prepared.groupBy("tag").agg(
        F.max(to_us(F.col("ds"))).alias("_last"), F.count("*").alias("n")
    )
    ahead = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps - 1).cast("bigint")))
    return last.withColumn("i", ahead).select(
        "tag", from_us(F.col("_last") + (F.col("i") + 1) * width).alias("ds"), "i", "n"
    )
