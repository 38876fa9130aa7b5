"""The intermediate results that several outputs of one series share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from pulsegrid.operators import clean, rate, sigma
from pulsegrid.operators.joins import SeriesProfile, profile
from pulsegrid.operators.resample import resample_grid
from pulsegrid.session import stage


class SeriesStages:
    """A series with its bounds, thresholds and slopes (one row per tag) and its prepared grid.

    Each is computed at its first use and staged, so the readings are scanned once for each of
    them, however many results are derived from it.  The clean readings themselves are never
    written: they are the readings filtered by their bounds.
    """

    def __init__(self, series: DataFrame, size: SeriesProfile | None = None):
        self.series = series
        self.size = size or profile(series)
        self._grids: dict[str, DataFrame] = {}

    @cached_property
    def bounds(self) -> DataFrame:
        return stage(clean.outlier_bounds(self.series, self.size), "bounds")

    @property
    def clean(self) -> DataFrame:
        return clean.remove_outliers(self.series, self.size, self.bounds)

    @property
    def counts(self) -> DataFrame:
        return clean.outlier_counts(self.series, self.size, self.bounds)

    @cached_property
    def summary(self) -> DataFrame:
        return stage(sigma.sigma_summary(self.clean, self.size), "summary")

    @cached_property
    def fits(self) -> DataFrame:
        return stage(rate.window_fits(self.clean, self.size), "fits")

    def prepared(self, freq: str = "1h") -> DataFrame:
        """``(tag, ds, y, i, n)`` on the regular grid."""
        if freq not in self._grids:
            self._grids[freq] = stage(resample_grid(self.clean, freq), "prepared")
        return self._grids[freq]
