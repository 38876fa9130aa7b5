import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SERIES = "tag string, ts timestamp_ntz, value double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Series from ``{tag: [(offset, value), ...]}`` with offsets in hours since 2024-01-01."""
    def build(points, hours=1.0):
        rows = [
            (tag, START + dt.timedelta(hours=k * hours), None if v is None else float(v))
            for tag, pairs in points.items() for k, v in pairs
        ]
        return spark.createDataFrame(rows, SERIES)
    return build


@pytest.fixture(scope="session")
def sine(make):
    """60 days of hourly readings with a daily and a weekly wave, a slope, and some noise."""
    import numpy as np

    rng = np.random.default_rng(7)
    hours = np.arange(60 * 24)
    waves = {}
    for tag, level in (("a", 50.0), ("b", 500.0)):
        y = level + 10 * np.sin(2 * np.pi * hours / 24) + 4 * np.sin(2 * np.pi * hours / 168)
        y = y + 0.002 * hours + rng.normal(0, 0.5, len(hours))
        waves[tag] = list(zip(hours.tolist(), y.tolist()))
    return make(waves)
