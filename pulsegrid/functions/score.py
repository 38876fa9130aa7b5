"""Forecast error metrics and the composite performance score, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAPE_EPSILON = 2.220446049250313e-16

# Label, threshold and display colour of each performance band.
BANDS = [("Good", 70.0, "success"), ("Moderate", 30.0, "warning"), ("Poor", None, "error")]


def error_metrics(actual: Column, predicted: Column) -> list[Column]:
    """Aggregates MAE, RMSE and MAPE (a ratio) over the pairs that have both values."""
    error = predicted - actual
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error) / F.greatest(F.abs(actual), F.lit(MAPE_EPSILON))).alias("mape"),
    ]


def composite_score(mape: Column, rmse: Column, mae: Column, data_std: Column) -> Column:
    """0-100: MAPE saturates at 50 %, RMSE at two and MAE at one standard deviation.

    NULL metrics give a NULL score; an unknown deviation counts as zero.
    """
    spread = F.greatest(F.coalesce(data_std, F.lit(0.0)), F.lit(1e-8))

    def part(value: Column, worst: float) -> Column:
        kept = F.lit(1.0) - F.least(value, F.lit(worst)) / F.lit(worst)
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), kept * 100.0))
        return F.when(value.isNotNull(), bounded)

    return part(mape, 0.5) * 0.4 + part(rmse / spread, 2.0) * 0.3 + part(mae / spread, 1.0) * 0.3


def _banded(score: Column, index: int) -> Column:
    good, moderate, poor = BANDS
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score >= good[1], F.lit(good[index]))
        .when(score >= moderate[1], F.lit(moderate[index]))
        .otherwise(F.lit(poor[index]))
    )


def category(score: Column) -> Column:
    return _banded(score, 0)


def colour(score: Column) -> Column:
    return _banded(score, 2)


def nmse(rmse: Column, data_std: Column) -> Column:
    """Squared error over variance; infinite for constant data."""
    variance = data_std * data_std
    return F.when(variance > 0, rmse * rmse / variance).otherwise(F.lit(float("inf")))
