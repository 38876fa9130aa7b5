from pathlib import Path
from types import SimpleNamespace

import pytest

from pulsegrid import session
from pulsegrid.operators.features import train_length


def named(master, folder=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: folder))


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://x"])
def test_only_a_local_session_gets_a_folder_of_its_own(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_folder(named(master))
    assert session.scratch_folder(named(master, "file:///shared/")).startswith("file:///shared/pulsegrid-app-")


def test_local_masters():
    assert all(session.scratch_folder(named(m)) for m in ("local", "local[8]", "local[*]", "local[4, 2]"))


def test_release_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_folder", lambda _: str(tmp_path / "app"))
    kept = session.stage(spark.range(5).toDF("n"), "numbers")
    assert kept.count() == 5 and list((tmp_path / "app").iterdir())
    session.release(spark)
    assert not (tmp_path / "app").exists()
    session.release(spark)


def test_discard_deletes_staged_tables_only(spark, tmp_path):
    kept, gone = session.stage(spark.range(5).toDF("n"), "kept"), session.stage(spark.range(9).toDF("n"), "gone")
    outside = str(tmp_path / "outside")
    spark.range(3).write.parquet(outside)
    files = gone.inputFiles()
    session.discard(gone)
    session.discard(spark.read.parquet(outside))
    assert kept.count() == 5 and spark.read.parquet(outside).count() == 3
    assert files and not any(Path(f.removeprefix("file:")).exists() for f in files)


def test_one_row_is_a_training_part(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1,), (2,), (9,), (10,)], "n long").select(train_length(F.col("n")).alias("k"))
    assert [r["k"] for r in rows.collect()] == [1, 1, 7, 8]
