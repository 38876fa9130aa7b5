"""Session settings, shipping the package, and staged tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Series carry naive timestamps, so time arithmetic runs in UTC, free of clock changes.

    Functions that run in Python workers import this package, so it is sent to the executors once.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package as an archive to all executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pulsegrid-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/pulsegrid-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder for staged tables, below the one named in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder, which is deleted at exit.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/pulsegrid-{context.applicationId}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_scratch:
        folder = tempfile.mkdtemp(prefix="pulsegrid-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_scratch[context.applicationId] = folder
    return _local_scratch[context.applicationId]


def release(spark: SparkSession) -> None:
    """Delete what this application staged; call it when results have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more; other tables are left alone."""
    spark = df.sparkSession
    own = scratch_folder(spark).rstrip("/").split(":", 1)[-1].lstrip("/")
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        if folder.split(":", 1)[-1].lstrip("/").startswith(f"{own}/"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and read it back.

    Cuts the lineage durably (a lost executor costs one re-read, not a recomputation), keeps
    column pruning, and gives the optimizer the table's real size.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
