import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import adaptive, health, search
from pulsegrid.plans.adaptive import SearchPlan

SPACE = {"rate": (0.01, 1.0, "log"), "depth": (2, 10, "int"), "mode": ["a", "b", "c"]}


def judged(batch, turn):
    """A loss that is least at rate place 0.3 and mode b."""
    loss = F.pow(F.col("u")[0] - 0.3, F.lit(2.0)) + F.when(F.col("u")[2] == 1, 0.0).otherwise(0.5)
    return batch.select("tag", "fold", F.lit(turn).alias("round"), F.lit(0).alias("rung"), loss.alias("loss"), "u")


@pytest.fixture(scope="module")
def played(spark):
    """Four rounds of 12 trials for three tags on a known loss."""
    tags = spark.createDataFrame([("x",), ("y",), ("z",)], "tag string")
    plan, rows = SearchPlan(rounds=4, batch=12), []
    for turn in range(plan.rounds):
        history = spark.createDataFrame(rows, adaptive.HISTORY)
        rows += [tuple(r) for r in judged(adaptive.propose(tags, history, SPACE, plan, turn), turn).collect()]
    return spark.createDataFrame(rows, adaptive.HISTORY)


def test_later_rounds_are_better(played):
    rounds = played.groupBy("tag", "round").agg(F.avg("loss").alias("loss"), F.count("*").alias("n")).toPandas()
    assert (rounds["n"] == 12).all()
    by = rounds.pivot(index="tag", columns="round", values="loss")
    assert (by[3] < by[0] / 2).all()
    places = np.stack(played.toPandas()["u"])
    assert (places >= 0).all() and (places[:, :2] <= 1).all() and set(places[:, 2]) <= {0.0, 1.0, 2.0}


def test_proposals_agree_between_runs_and_differ_between_tags(spark, played):
    tags = spark.createDataFrame([("x",), ("y",)], "tag string")
    first = adaptive.propose(tags, played, SPACE, SearchPlan(), 4).orderBy("tag", "fold").collect()
    again = adaptive.propose(tags.repartition(3), played.repartition(5), SPACE, SearchPlan(), 4).orderBy("tag", "fold").collect()
    assert first == again and len(first) == 18
    assert [r["u"] for r in first[:9]] != [r["u"] for r in first[9:]]
    assert adaptive.propose(tags.limit(0), played, SPACE, SearchPlan(), 4).count() == 0


def test_settings_stay_in_their_space(spark):
    rows = spark.createDataFrame([([a, a, float(k)],) for a in (0.0, 0.5, 1.0) for k in range(3)], "u array<double>")
    found = rows.select(*adaptive.settings_of(F.col("u"), SPACE)).toPandas()
    assert np.allclose(found["rate"].unique(), [0.01, 0.1, 1.0]) and found["depth"].unique().tolist() == [2, 6, 10]
    assert set(found["mode"]) == {"a", "b", "c"}


def test_preference_equals_its_definition(played):
    split = adaptive.split_trials(played)
    at = [F.lit(0.4), F.lit(0.9), F.lit(1.0)]
    found = split.withColumn("p", adaptive.preference(F.col("good"), F.col("rest"), at, SPACE)).toPandas()

    def density(trials, j, x, options):
        own = np.array([t[j] for t in trials])
        if options:
            return (1 + (own == x).sum()) / (len(own) + options)
        width = 1 / (1 + np.sqrt(len(own)))
        return (1 + (np.exp(-(((own - x) / width) ** 2) / 2) / (width * np.sqrt(2 * np.pi))).sum()) / (len(own) + 1)

    for _, row in found.iterrows():
        own = played.where(F.col("tag") == row["tag"]).toPandas().sort_values(["loss", "fold"])
        good = own["u"].tolist()[: int(np.ceil(len(own) / 3))]
        rest = own["u"].tolist()[len(good):]
        wanted = sum(
            np.log(density(good, j, x, o)) - np.log(density(rest, j, x, o)) for j, (x, o) in enumerate(((0.4, 0), (0.9, 0), (1.0, 3)))
        )
        assert np.isclose(row["p"], wanted)


def test_importance_names_what_decides(played):
    told = adaptive.importance(played, SPACE).toPandas().pivot(index="tag", columns="setting", values="share")
    assert (told["mode"] > told["depth"]).all() and np.allclose(told.sum(axis=1), 1.0)
    flat = adaptive.importance(played.withColumn("loss", F.lit(2.0)), SPACE).toPandas()
    assert (flat["explained"] == 0).all() and (flat["share"] == 0).all()
    failed = played.withColumn("loss", F.when(F.col("fold") == "00-000", float("inf")).otherwise(F.col("loss")))
    assert adaptive.importance(failed, SPACE).toPandas()["trials"].unique().tolist() == [47]


def test_rungs_grow_and_copy_fewer_rows_than_trials():
    assert SearchPlan().rungs == [(9, 1 / 9), (3, 1 / 3), (1, 1)]
    assert SearchPlan(batch=1).rungs == [(1, 1)]
    assert SearchPlan(batch=8, eta=2).rungs == [(8, 1 / 8), (4, 1 / 4), (2, 1 / 2), (1, 1)]


def test_an_analysis_uses_the_best_trials(sine):
    plan = SearchPlan(rounds=2, batch=3)
    found = health.analyse(sine, health.Analysis(models=("additive",), horizon_days=2, search_plan=plan))
    rows = found.forecast.groupBy("tag").agg(F.count("*").alias("n"), F.max("yhat").alias("top")).collect()
    assert {r["tag"] for r in rows} == {"a", "b"} and all(r["n"] == 48 and np.isfinite(r["top"]) for r in rows)


def test_many_readings_for_a_grid_point_are_no_longer_fits(spark, sine, monkeypatch):
    """Readings beyond a slice do not send fits of few grid points through rounds over Spark."""
    from pulsegrid.models import kernel
    from pulsegrid.models.frames import fit_size
    from pulsegrid.operators.joins import SeriesProfile
    from pulsegrid.operators.resample import resample_grid

    def refused(*_):
        raise AssertionError("rounds over Spark")

    monkeypatch.setattr(kernel, "_fit_by_rounds", refused)
    pos = resample_grid(sine, "1h")
    size = SeriesProfile(2, 10_000_000, 1)
    assert fit_size(pos, size) == SeriesProfile(2, 60 * 24, 1)
    assert fit_size(pos, SeriesProfile(2, 40_000, 1)).largest == 40_000 and fit_size(pos.limit(0), size).largest == 0
    plan = adaptive.SearchPlan(rounds=1, batch=2, eta=2, candidates=2)
    few = search.searchable(pos.where("i < 200").withColumn("n", F.lit(200).cast("long")))
    for found in adaptive.adaptive_searches(["kernel", "additive"], few, "1h", size, plan):
        assert found.count() == 4 and found.where("loss < double('inf')").count() == 4
    assert adaptive.adaptive_searches([], few, "1h", size, plan) == []
