"""The result tables and their node records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timeops import SECOND, floor_us, freq_us, from_us, to_us
from pulsegrid.operators.sigma import LEVELS as LEVEL_NAMES
from pulsegrid.operators.ttf import LEVELS, SLOPE_PERIODS

STAMP = "yyyy-MM-dd HH:mm:ss"
COMPACT_STAMP = "yyyyMMdd_HHmmss"
HALF_HOUR = 1800 * SECOND


def rate_table(rates: DataFrame, as_of: Column) -> DataFrame:
    return rates.select(
        F.col("tag").alias("Tag"), F.col("period").alias("Period"),
        F.col("slope").alias("Slope_per_Day"), F.date_format(as_of, STAMP).alias("Date_Modelling"),
    )


def event_table(events: DataFrame) -> DataFrame:
    """Exceedances in time order; events of one time are ordered by tag and type."""
    return events.select(
        F.col("ts").alias("Timestamp"), F.col("value").alias("Value"), F.col("type").alias("Type"),
        F.col("tag").alias("Tag"),
    ).orderBy("Timestamp", "Tag", "Type")


def sigma_table(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.col("tag").alias("Tag"), F.col("median").alias("Median"), F.col("mad").alias("MAD"),
        F.col("sigma").alias("Sigma"),
        *[F.col(f"p{k}").alias(f"+{k}σ") for k in LEVEL_NAMES],
        *[F.col(f"n{k}").alias(f"-{k}σ") for k in LEVEL_NAMES],
    )


def forecast_table(
    forecast: DataFrame, rebase_to: Column | None = None, freq: str = "1h"
) -> DataFrame:
    """The forecast with its own times, or re-stamped from the hour nearest to ``rebase_to``."""
    stamp = F.col("ds")
    if rebase_to is not None:
        start = floor_us(to_us(rebase_to) + HALF_HOUR, 2 * HALF_HOUR)
        stamp = from_us(start + F.col("i") * freq_us(freq))
    return forecast.select(
        stamp.alias("Timestamp"), F.col("yhat").alias("Forecast"),
        F.col("lower").alias("Lower_CI"), F.col("upper").alias("Upper_CI"), F.col("tag").alias("Tag"),
    )


def breach_table(breaches: DataFrame) -> DataFrame:
    return breaches.select(
        F.col("tag").alias("Tag"), F.col("breach_type").alias("Breach_Type"),
        F.col("predicted_ts").alias("Predicted_Timestamp"),
    )


def breach_columns(levels=LEVELS, periods=SLOPE_PERIODS) -> dict[str, str]:
    """Labels of the breaches and the columns they get in wide tables."""
    names = {f"Positive {k}σ": f"TTF_Pos_{k}Sigma" for k in levels}
    names |= {f"Negative {k}σ": f"TTF_Neg_{k}Sigma" for k in levels}
    return names | {f"TTF ROC {d}d": f"TTF_ROC_{d}d" for d in periods}


def breaches_wide(breaches: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One row per tag with a column per breach type (given in advance, so one aggregation)."""
    names = names or breach_columns()
    return breaches.groupBy("tag").agg(*[
        F.max(F.when(F.col("breach_type") == label, F.col("predicted_ts"))).alias(column)
        for label, column in names.items()
    ])


def ttf_summary(scores: DataFrame, breaches: DataFrame, as_of: Column) -> DataFrame:
    """Tag, model, rounded metrics and score, then one column per breach type."""
    wide = breaches_wide(breaches)
    columns = [c for c in wide.columns if c != "tag"]
    return scores.join(wide, "tag", "left").select(
        F.col("tag").alias("Tags"), F.date_format(as_of, STAMP).alias("Date_Modelling"),
        F.col("model").alias("Model"), F.round("mae", 4).alias("Model_MAE"),
        F.round("rmse", 4).alias("Model_RMSE"), F.round("mape", 4).alias("Model_MAPE"),
        F.round("score", 2).alias("Score"), *columns,
    )


def _finite(column: str) -> Column:
    return F.when(~F.isnan(column), F.col(column))


def _node(df: DataFrame, view: str, tag: str, external_id: Column, properties: list[Column]) -> DataFrame:
    return df.select(
        external_id.alias("external_id"), F.lit(view).alias("view"), F.col(tag).alias("tag"),
        F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}).alias("properties"),
    )


def node_records(
    forecast: DataFrame, rates: DataFrame, summary: DataFrame, ttf: DataFrame, events: DataFrame,
    as_of: Column,
) -> DataFrame:
    """``(external_id, view, tag, properties)`` of the five result tables; ids name their content.

    Ids are unique: of the events of a tag and type within one second, the last is the node.
    """
    modelled = as_of.alias("Date_Modelling")

    def stamp(column: str) -> Column:
        return F.coalesce(F.date_format(column, COMPACT_STAMP), F.lit("unknown"))

    event_type = F.replace(F.replace(F.replace("Type", F.lit("+"), F.lit("pos")),
                                     F.lit("-"), F.lit("neg")), F.lit(" "), F.lit("_"))
    thresholds = [
        _finite(f"{side}{k}").alias(f"{word}_{k}Sigma")
        for side, word in (("p", "Pos"), ("n", "Neg")) for k in range(1, 6)
    ]
    unset = [F.lit(None).cast("timestamp_ntz").alias(f"TTF_{s}_{k}Sigma") for s in ("Pos", "Neg") for k in (4, 5)]
    second = F.date_trunc("second", "ts").alias("_second")
    typed = (
        events.groupBy("tag", F.col("type").alias("Type"), second)
        .agg(F.max(F.struct("ts", "value")).alias("_last")).select("tag", "Type", "_last.ts", "_last.value")
    )
    parts = [
        _node(
            forecast, "forecast", "Tag", F.concat("Tag", F.lit("_forecast_"), stamp("Timestamp")),
            [F.col("Timestamp"), *[_finite(c).alias(c) for c in ("Forecast", "Lower_CI", "Upper_CI")], F.col("Tag")],
        ),
        _node(
            rates, "rate_of_change", "Tag", F.concat("Tag", F.lit("_rate_"), "Period"),
            [F.col("Tag"), F.col("Period"), _finite("Slope_per_Day").alias("Slope_per_day"), modelled],
        ),
        _node(
            summary, "sigma_summary", "tag", F.concat("tag", F.lit("_sigma_summary")),
            [F.col("tag").alias("Tag"), _finite("median").alias("Median"), _finite("mad").alias("MAD"),
             _finite("sigma").alias("Sigma"), *thresholds, modelled],
        ),
        _node(
            ttf, "ttf_summary", "Tags", F.concat("Tags", F.lit("_ttf_summary")),
            [F.col("Tags"), modelled,
             *[_finite(c).alias(c) for c in ("Model_MAE", "Model_RMSE", "Model_MAPE", "Score")],
             *[F.col(c) for c in breach_columns().values()], *unset],
        ),
        _node(
            typed, "sigma_event", "tag",
            F.concat(F.col("tag"), F.lit("_sigma_"), event_type, F.lit("_"), stamp("ts")),
            [F.col("ts").alias("Timestamp"), _finite("value").alias("Value"), F.col("Type"), F.col("tag").alias("Tag")],
        ),
    ]
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    return records


def run_report(requested: DataFrame, nodes: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Status of every requested tag: what was written, or why it failed.

    ``failures(tag, error)`` names tags known to have failed; tags without any node have no data.
    """
    written = nodes.groupBy("tag").agg(F.count("*").alias("nodes_written"))
    report = requested.select("tag").join(written, "tag", "left")
    report = (
        report.join(failures, "tag", "left") if failures is not None
        else report.withColumn("error", F.lit(None).cast("string"))
    )
    done = F.col("nodes_written").isNotNull() & F.col("error").isNull()
    error = F.when(~done, F.coalesce("error", F.lit("No data")))
    return report.select(
        "tag", F.when(done, "success").otherwise("error").alias("status"), error.alias("error"),
        F.when(done, "success").otherwise("no_data").alias("write_status"),
        F.when(done, F.col("nodes_written")).otherwise(0).alias("nodes_written"),
    )


def run_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("processed_tags"),
        F.count_if(F.col("status") == "success").alias("successful_tags"),
        F.sum("nodes_written").alias("nodes_written"),
    )
