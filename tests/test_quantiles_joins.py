import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import joins
from pulsegrid.operators.joins import SeriesProfile, attach, profile
from pulsegrid.operators.quantiles import group_quantiles


@pytest.fixture(scope="module")
def skewed(make):
    rng = np.random.default_rng(1)
    hot = np.concatenate([rng.normal(0, 1, 3000), np.full(1500, 0.25), rng.pareto(0.3, 500)])
    rng.shuffle(hot)
    points = {"hot": list(enumerate(hot)), "small": [(0, 3.0), (1, None), (2, 5.0)], "one": [(0, -1.0)]}
    return make(points).persist()


PROBS = {"low": 0.1, "mid": 0.5, "high": 0.9, "first": 0.0, "last": 1.0}


def expected(frame):
    values = frame.toPandas().dropna().groupby("tag")["value"]
    return pd.DataFrame({n: values.quantile(q) for n, q in PROBS.items()}).sort_index()


@pytest.mark.parametrize("limit,accuracy", [(100_000, 10_000), (500, 1000), (60, 50)])
def test_narrowed_quantiles_are_exact(skewed, limit, accuracy):
    found = group_quantiles(skewed, "value", PROBS, exact_limit=limit, accuracy=accuracy).toPandas()
    found = found.set_index("tag").sort_index()[list(PROBS)]
    assert np.allclose(found, expected(skewed), rtol=1e-12)


def test_salted_join_equals_broadcast_join(skewed, monkeypatch):
    stats = skewed.groupBy("tag").agg(F.sum("value").alias("total"))
    size = profile(skewed)
    assert (size.tags, size.largest) == (3, 5000)
    plain = attach(skewed, stats, size).orderBy("tag", "ts").toPandas()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    salted_frame = attach(skewed, stats, size)
    assert "_salt" in salted_frame._jdf.queryExecution().toString()
    pd.testing.assert_frame_equal(salted_frame.orderBy("tag", "ts").toPandas(), plain)


def test_join_size_is_checked(skewed):
    stats = skewed.groupBy("tag").agg(F.sum("value").alias("total"))
    huge = SeriesProfile(tags=10**8, largest=10, tag_bytes=10)
    text = attach(skewed, stats, huge)._jdf.queryExecution().toString()
    assert "broadcast" not in text.split("== Analyzed")[0].lower()


def test_groups_without_values_have_a_row_on_both_paths(make):
    series = make({"a": [(k, k) for k in range(300)], "empty": [(k, None) for k in range(3)]})
    for limit in (10, 100_000):
        found = {r["tag"]: r["q"] for r in group_quantiles(series, "value", {"q": 0.5}, exact_limit=limit).collect()}
        assert found == {"a": 149.5, "empty": None}
