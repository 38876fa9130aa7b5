"""Outlier band and outlier removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.joins import SeriesProfile, attach, profile
from pulsegrid.operators.quantiles import group_quantiles

BAND_WIDTH = 1.5


def outlier_bounds(series: DataFrame, size: SeriesProfile | None = None, **options) -> DataFrame:
    """10th and 90th percentile of each tag, widened by 1.5 times their distance."""
    band = group_quantiles(series, "value", {"p10": 0.10, "p90": 0.90}, size, **options)
    spread = (F.col("p90") - F.col("p10")) * BAND_WIDTH
    return band.select(
        "tag", "p10", "p90",
        (F.col("p10") - spread).alias("lower_bound"),
        (F.col("p90") + spread).alias("upper_bound"),
    )


def _banded(
    series: DataFrame, size: SeriesProfile | None, bounds: DataFrame | None, how: str = "inner"
) -> DataFrame:
    size = size or profile(series)
    bounds = outlier_bounds(series, size) if bounds is None else bounds
    return attach(series, bounds.select("tag", "lower_bound", "upper_bound"), size, how=how)


def _inside():
    return F.col("value").between(F.col("lower_bound"), F.col("upper_bound"))


def remove_outliers(
    series: DataFrame, size: SeriesProfile | None = None, bounds: DataFrame | None = None
) -> DataFrame:
    """The readings inside the band, both ends included; missing values are dropped."""
    return _banded(series, size, bounds).where(_inside()).select(*series.columns)


def outlier_counts(
    series: DataFrame, size: SeriesProfile | None = None, bounds: DataFrame | None = None
) -> DataFrame:
    """Per tag: all readings, removed readings, and the removed share in percent."""
    counted = _banded(series, size, bounds, "left").groupBy("tag").agg(
        F.count("*").alias("total_count"), F.count_if(_inside()).alias("kept_count")
    )
    removed = F.col("total_count") - F.col("kept_count")
    return counted.select(
        "tag", "total_count", "kept_count",
        removed.alias("removed_count"),
        (removed / F.col("total_count") * 100.0).alias("percent_removed"),
    )
