"""The driver tables as series, prepared series and series metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.plans.stages import SeriesStages
from pulsegrid.session import configure, stage
from pulsegrid.sources.series import as_series, scan_aggregate

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def events_by_type(spark, folder) -> DataFrame:
    return as_series(table(spark, folder, "events"), "event_type", "ts", "value")


def events_by_user(spark, folder) -> DataFrame:
    return as_series(table(spark, folder, "events"), "user_id", "ts", "value")


def orders_daily(spark, folder) -> DataFrame:
    raw = as_series(table(spark, folder, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")
    return stage(scan_aggregate(raw, "1d", "average"), "daily")


def lineitem_daily(spark, folder) -> DataFrame:
    flags = F.concat("l_returnflag", "l_linestatus")
    raw = as_series(table(spark, folder, "lineitem"), flags, "l_shipdate", "l_extendedprice")
    return stage(scan_aggregate(raw, "1d", "sum"), "daily")


def part_meta(spark, folder) -> DataFrame:
    """Parts stand in for series metadata."""
    unit = F.when(F.col("p_type") == "SMALL", "mm").when(F.col("p_type") == "LARGE", "m")
    own = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), "p_partkey")
    forecast_of = (F.col("p_partkey") % 50) == 7
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(forecast_of, F.concat(F.lit("forecast_of_"), own)).otherwise(own).alias("external_id"),
        F.concat_ws(".", F.lit("S"), F.lit("A"), "p_brand", "p_type", "p_name", F.lit("PV")).alias("name"),
        F.when(F.col("p_size") != 1, F.col("p_type")).alias("description"),
        unit.alias("unit"),
        F.col("p_size").cast("bigint").alias("asset_id"),
        F.lit(None).cast("bigint").alias("data_set_id"),
        F.lit(False).alias("is_string"),
        (F.col("p_size") % 2 == 0).alias("is_step"),
        F.create_map(
            F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"),
        ).alias("metadata"),
    )


def cleaned(series: DataFrame) -> SeriesStages:
    return SeriesStages(series)
