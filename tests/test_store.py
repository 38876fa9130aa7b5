import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import sinks
from pulsegrid.sources.store import Conflict, Store


def held(store, table, version=None):
    return sorted((r["tag"], r["value"]) for r in store.read(table, version).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/results")


def test_tables_change_together_or_not_at_all(store, make):
    assert store.version() == 0 and store.read("points") is None
    first = make({"a": [(0, 1), (1, 2)], "b": [(0, 3)]})
    assert store.begin().replace_by_tag("points", first).replace_by_tag("other", first).commit() == 1
    late = make({"a": [(7, 9)], "c": [(0, 4)]})
    broken = store.begin()
    broken.replace_by_tag("points", late)
    assert held(store, "points") == held(store, "other") == [("a", 1.0), ("a", 2.0), ("b", 3.0)]
    again = store.begin().replace_by_tag("points", late).replace_by_tag("other", late)
    assert again.commit() == 2
    assert held(store, "points") == held(store, "other") == [("a", 9.0), ("b", 3.0), ("c", 4.0)]
    assert held(store, "points", 1) == [("a", 1.0), ("a", 2.0), ("b", 3.0)]
    with pytest.raises(Conflict):
        broken.commit()
    assert held(store, "points") == [("a", 9.0), ("b", 3.0), ("c", 4.0)]


def test_a_change_reads_what_it_has_written(store, make):
    change = store.begin()
    change.replace_by_tag("points", make({"a": [(0, 1)], "b": [(0, 2)]})).replace_by_tag("points", make({"a": [(0, 5)]}))
    change.commit()
    assert held(store, "points") == [("a", 5.0), ("b", 2.0)]


def test_a_failing_write_leaves_the_old_version(store, make):
    store.begin().replace_by_tag("points", make({"a": [(0, 1)]})).commit()
    bad = make({"a": [(0, 1)]}).withColumn("value", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.begin().replace_by_tag("points", bad).commit()
    assert store.version() == 1 and held(store, "points") == [("a", 1.0)]


def test_no_rows_and_only_the_touched_buckets(store, make):
    store.begin().replace_by_tag("points", make({"a": [(0, 1)], "b": [(0, 2)]})).commit()
    before = store.manifest()["points"]["buckets"]
    store.begin().replace_by_tag("points", make({"a": [(0, 3)]})).commit()
    after = store.manifest()["points"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    store.begin().replace_by_tag("points", make({"a": []})).replace_by_tag("empty", make({"a": []})).commit()
    assert held(store, "points") == [("a", 3.0), ("b", 2.0)] and store.read("empty").count() == 0


def test_sweep_deletes_what_no_kept_version_names(store, make):
    for value in range(4):
        store.begin().replace_by_tag("points", make({"a": [(0, value)]})).commit()
    store.begin().replace_by_tag("points", make({"a": [(0, 99)]}))  # never committed
    assert store.sweep(keep=2) == 0  # all are young
    assert store.sweep(keep=2, grace_seconds=-5) == 3
    assert held(store, "points") == [("a", 3.0)] and held(store, "points", 3) == [("a", 2.0)]
    assert store.version() == 4 and store.sweep(keep=2, grace_seconds=-5) == 0


def test_nodes_of_one_id_and_earlier_forecasts(spark, store):
    names = "external_id string, view string, tag string, n int"
    store.begin().upsert_nodes("nodes", spark.createDataFrame([("x1", "forecast", "a", 1), ("x2", "forecast", "a", 1), ("s", "sigma", "a", 1)], names)).commit()
    store.begin().upsert_nodes("nodes", spark.createDataFrame([("x3", "forecast", "a", 2), ("s", "sigma", "a", 2), ("s", "sigma", "a", 3)], names)).commit()
    assert sorted(tuple(r) for r in store.read("nodes").collect()) == [("s", "sigma", "a", 3), ("x3", "forecast", "a", 2)]


def test_sinks_keep_a_store(spark, tmp_path, make):
    path = f"{tmp_path}/points"
    assert sinks.read_rows(spark, path) is None
    sinks.replace_by_tag(make({"a": [(0, 1)]}), path)
    assert sinks.read_rows(spark, path).count() == 1
