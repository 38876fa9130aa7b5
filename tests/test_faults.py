import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.models import ridge
from pulsegrid.plans import health, tables

PLAN = health.Analysis(models=("autoregressive",), horizon_days=1)


def test_a_system_without_a_solution_gives_nan():
    assert np.isnan(ridge.solution(np.zeros((2, 2)), np.ones(2))).all()
    assert np.allclose(ridge.solution(np.eye(2), np.ones(2)), 1.0)
    bad = np.eye(3)
    bad[1, 1] = np.inf
    assert np.isnan(ridge._sparse(bad, np.ones(3), np.zeros(3))).all()


def test_one_failed_group_leaves_the_others(spark):
    rows = [(key, [1.0, float(k)], float("nan") if key == "bad" and k == 3 else 2.0 * k) for key in ("bad", "good") for k in range(9)]
    frame = spark.createDataFrame(rows, "tag string, x array<double>, z double")
    parts = ridge.moments(frame, ["tag"]).withColumn("penalty", F.array(F.lit(0.0), F.lit(0.0)))
    found = {r["tag"]: r for r in ridge.solve(parts, ["tag"]).collect()}
    assert np.allclose(found["good"]["coef"], [0.0, 2.0], atol=1e-6)
    assert np.isnan(np.array(found["bad"]["coef"], dtype=float)).all()


@pytest.fixture(scope="module")
def mixed(spark, sine, make):
    huge = sine.where("tag = 'a'").select(F.lit("huge").alias("tag"), "ts", (F.col("value") * 1e200).alias("value"))
    short = make({"short": [(k, 5.0 + k % 3) for k in range(20)]})
    single = sine.where("tag = 'a'").limit(1).select(F.lit("single").alias("tag"), (F.col("ts") + F.expr("INTERVAL '7' MINUTE")).alias("ts"), "value")
    return sine.unionByName(huge).unionByName(short).unionByName(single)


def test_every_cause_is_named_and_other_tags_are_unchanged(spark, sine, mixed):
    alone, found = health.analyse(sine, PLAN), health.analyse(mixed, PLAN)
    asked = spark.createDataFrame([(t,) for t in ("a", "b", "huge", "short", "single", "never")], "tag string")
    assert {r["tag"]: r["error"] for r in health.failures(asked, found).collect()} == {
        "huge": "grid: values too large", "short": "forecast: too few points", "single": "grid: no point", "never": "No data",
    }
    columns = ["tag", "ds", "yhat", "lower", "upper"]
    mine = found.forecast.where("tag IN ('a', 'b')").select(columns).toPandas().sort_values(["tag", "ds"])
    wanted = alone.forecast.select(columns).toPandas().sort_values(["tag", "ds"])
    assert len(mine) == 48 and np.allclose(mine[columns[2:]], wanted[columns[2:]])
    rows = {r["tag"]: r for r in health.asset_health(found).collect()}
    assert set(rows) == {"a", "b", "huge", "short", "single"} and rows["single"]["median"] is None and rows["a"]["median"] is not None


def test_totals_count_tags_and_nodes(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "tag string")
    nodes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "tag string, n int")
    failed = spark.createDataFrame([("b", "fit: singular or not finite")], "tag string, error string")
    report = tables.run_report(asked, nodes, failed)
    assert {r["tag"]: r["error"] for r in report.collect()} == {"a": None, "b": "fit: singular or not finite", "c": "No data"}
    totals = tables.run_totals(report).first()
    assert (totals["processed_tags"], totals["successful_tags"], totals["nodes_written"]) == (3, 1, 2)
