import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import health, tables
from pulsegrid.sources import meta, sinks
from pulsegrid.sources.series import relative_time
from pulsegrid.session import scratch_folder, stage


def test_presets_round_trip():
    for name, analysis in health.PRESETS.items():
        assert health.preset_name(analysis) == name
    assert health.preset_name(health.Analysis()) == "Custom"


def test_average_stays_between_members(sine):
    analysis = health.Analysis(models=("trend", "additive"), combine="average", horizon_days=2)
    result = health.analyse(sine, analysis)
    assert {r["model"] for r in result.forecast.select("model").distinct().collect()} == {"ensemble_average"}
    assert result.forecast.count() == 96
    assert result.scores.count() == 2 and result.breaches.count() == 18


def test_best_picks_one_model_per_tag(sine):
    analysis = health.Analysis(models=("trend", "additive"), combine="best", horizon_days=2)
    result = health.analyse(sine, analysis)
    winners = {r["tag"]: r["model"] for r in result.scores.collect()}
    assert winners == {"a": "additive", "b": "additive"}
    row = health.asset_health(result).collect()
    assert len(row) == 2 and all(r["category"] == "Good" for r in row)


def test_searched_settings_are_used(sine):
    analysis = health.Analysis(models=("additive",), horizon_days=2, search_trials=3)
    result = health.analyse(sine, analysis)
    assert result.forecast.count() == 96 and result.scores.where("score > 50").count() == 2


def test_tag_without_values_is_reported(make):
    series = make({"ok": [(k, float(k % 7)) for k in range(400)], "empty": [(0, None), (5, None)]})
    result = health.analyse(series, health.Analysis(models=("trend",), horizon_days=1))
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    nodes = tables.node_records(
        tables.forecast_table(result.forecast), tables.rate_table(result.rates, as_of), result.summary,
        tables.ttf_summary(result.scores, result.breaches, as_of), result.events, as_of,
    )
    report = tables.run_report(series.select("tag").distinct(), nodes)
    status = {r["tag"]: r["status"] for r in report.collect()}
    assert status == {"ok": "success", "empty": "error"}
    totals = tables.run_totals(report).collect()[0]
    assert (totals["processed_tags"], totals["successful_tags"]) == (2, 1)
    ids = [r["external_id"] for r in nodes.select("external_id").collect()]
    assert len(ids) == len(set(ids)) and "ok_sigma_summary" in ids and "ok_rate_14d" in ids


def test_exports_and_relative_times(sine, spark):
    result = health.analyse(sine, health.Analysis(models=("trend",), horizon_days=1), as_of="2024-03-01 00:00:00")
    folder = f"{scratch_folder(spark)}/export-{uuid.uuid4().hex}"
    as_of = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    health.export_csv(result, as_of, folder)
    for name, table in health.result_tables(result, as_of).items():
        back = spark.read.option("header", True).csv(f"{folder}/{name}")
        assert back.columns == table.columns and back.count() == table.count()
    now = dt.datetime(2024, 3, 1)
    assert relative_time("365d-ago", now) == now - dt.timedelta(days=365) and relative_time("now", now) == now
    with pytest.raises(ValueError):
        relative_time("soon", now)


def test_replace_is_idempotent(make, spark):
    path = f"{scratch_folder(spark)}/points-{uuid.uuid4().hex}"
    sinks.replace_by_tag(make({"a": [(0, 1), (1, 2)], "b": [(0, 3)]}), path)
    for _ in range(2):
        sinks.replace_by_tag(make({"a": [(7, 9)], "c": [(0, 4)]}), path)
    found = sorted((r["tag"], r["value"]) for r in sinks.read_rows(spark, path).collect())
    assert found == [("a", 9.0), ("b", 3.0), ("c", 4.0)]


def test_search_ranks_names_first(spark):
    schema = "id long, external_id string, name string, description string, unit string, metadata map<string,string>"
    rows = spark.createDataFrame([
        (1, "x1", "S.A.U.P.PT100.PV", "Pump pressure", "bar", {"b": "2", "a": "1"}),
        (2, "x2", "flow", "beside the PT100", "N/A", None),
        (3, "forecast_of_x1", "pt100", "PT100", "", None),
        (4, " ", "PT100", None, None, None),
    ], schema)
    found = meta.search(rows, '"pt100"').collect()
    assert [(r["id"], r["match_rank"]) for r in found] == [(1, 0), (2, 1)]
    assert meta.search(rows, "pressure pump").count() == 1 and meta.search(rows, " ").count() == 2
    names = {r["id"]: r["display_name"] for r in meta.selection_list(rows).collect()}
    assert names[1] == "PT100 (U/P): Pump pressure (bar)" and names[2] == "flow: beside the PT100"


def test_staged_tables_live_in_one_folder(spark):
    first = scratch_folder(spark)
    assert first == scratch_folder(spark)
    staged = stage(spark.range(3), "three")
    assert staged.count() == 3 and first in staged.inputFiles()[0]
