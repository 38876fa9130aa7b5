"""Writing results: CSV exports, forecast points, node records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources.meta import FORECAST_PREFIX
from pulsegrid.sources.store import Store


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).csv(path)


def forecast_points(forecast: DataFrame, ts: str | Column = "ds", value: str = "yhat") -> DataFrame:
    """``(tag, timestamp_ms, value)`` of the rows with a value and a readable timestamp.

    ``ts`` may be a timestamp or text; text that is no timestamp is skipped.
    """
    column = F.col(ts) if isinstance(ts, str) else ts
    stamp = F.try_to_timestamp(column.cast("string"))
    return forecast.select(
        "tag", F.unix_millis(stamp).alias("timestamp_ms"), F.col(value).alias("value")
    ).where(F.col("timestamp_ms").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def forecast_series(looked_up: DataFrame, model: str | Column, horizon: str) -> DataFrame:
    """Metadata of the series that will hold each tag's forecast."""
    own = F.concat(F.lit(FORECAST_PREFIX), F.col("tag"))
    facts = {
        "model_type": F.lit(model), "forecast_horizon": F.lit(horizon), "base_tag": F.col("tag"),
        "created_by": F.lit("automated"), "asset_id": F.col("asset_id").cast("string"),
        "data_set_id": F.col("data_set_id").cast("string"),
    }
    return looked_up.select(
        own.alias("external_id"), own.alias("name"),
        F.concat(F.lit("Forecast data for "), "tag").alias("description"),
        F.coalesce("unit", F.lit("")).alias("unit"),
        F.create_map(*[c for k, v in facts.items() for c in (F.lit(k), v)]).alias("metadata"),
    )


#: The table that these functions keep in a store of its own.
ROWS = "rows"


def replace_by_tag(points: DataFrame, path: str) -> None:
    """Write points, replacing everything the table holds for the same tags.

    Only the buckets of those tags are rewritten, readers see the old rows or the new ones, and
    writing the same points twice is harmless.
    """
    Store(points.sparkSession, path).begin().replace_by_tag(ROWS, points).commit()


def upsert_nodes(nodes: DataFrame, path: str) -> None:
    """Write node records by id, one row for each; a tag's earlier forecast nodes are dropped first."""
    Store(nodes.sparkSession, path).begin().upsert_nodes(ROWS, nodes).commit()


def read_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``replace_by_tag`` or ``upsert_nodes`` last made valid."""
    return Store(spark, path).read(ROWS)
