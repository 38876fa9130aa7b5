"""Result tables that change together or not at all.

A store is a folder.  Rows lie in buckets of tags, ``BUCKETS`` to a table, and a change writes the
buckets that it touches as new folders; nothing is written over.  A manifest names the valid folder
of every bucket of every table, and one rename makes the next manifest the valid one.  A job
that breaks off before it leaves the old version as it was, whole, for all readers.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.session import stage

BUCKETS = 256


class Conflict(RuntimeError):
    """Another change became valid first."""


def _bucket() -> Column:
    return F.pmod(F.xxhash64("tag"), F.lit(BUCKETS)).cast("int")


class Store:
    """Tables under ``root``, a path of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _system(self):
        return self._path().getFileSystem(self._conf)

    def _listed(self, *parts: str) -> list:
        path = self._path(*parts)
        return list(self._system().listStatus(path)) if self._system().exists(path) else []

    def version(self) -> int:
        """Number of the valid version; 0 before the first change."""
        names = [s.getPath().getName() for s in self._listed("manifests")]
        return max([int(n[1:]) for n in names if n[0] == "v"], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``{table: {"schema": ..., "buckets": {bucket: folder}}}``: as many entries as tables have buckets."""
        version = self.version() if version is None else version
        if not version:
            return {}
        with_lines = self.spark.read.text(f"{self.root}/manifests/v{version:010d}", wholetext=True)
        return json.loads(with_lines.first()[0])

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a table, or of some of its buckets; None if there is no such table."""
        told = self.manifest(version).get(table)
        if told is None:
            return None
        schema = StructType.fromJson(told["schema"])
        chosen = told["buckets"] if buckets is None else {b: f for b, f in told["buckets"].items() if int(b) in buckets}
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{folder}" for folder in chosen.values()])

    def begin(self) -> "Change":
        return Change(self)

    def sweep(self, keep: int = 2, grace_seconds: float = 86_400.0) -> int:
        """Delete what the last ``keep`` versions do not name; the number of folders deleted.

        Folders younger than ``grace_seconds`` stay, as a change in progress may own them.
        """
        latest = self.version()
        kept = range(max(1, latest - keep + 1), latest + 1) if latest else range(0)
        named = {folder.rsplit("/", 1)[0] for v in kept for t in self.manifest(v).values() for folder in t["buckets"].values()}
        system, before, gone = self._system(), (time.time() - grace_seconds) * 1000, 0
        for table in self._listed("data"):
            for change in system.listStatus(table.getPath()):
                name = f"data/{table.getPath().getName()}/{change.getPath().getName()}"
                if name not in named and change.getModificationTime() <= before:
                    system.delete(change.getPath(), True)
                    gone += 1
        for status in self._listed("manifests"):
            name = status.getPath().getName()
            old = name[0] == "v" and int(name[1:]) < latest - keep + 1
            if old or (name[0] != "v" and status.getModificationTime() <= before):
                system.delete(status.getPath(), False)
        return gone


class Change:
    """Writes to one or more tables that become valid together at ``commit``."""

    def __init__(self, store: Store):
        self.store, self.base, self.id = store, store.version(), uuid.uuid4().hex
        self._next = store.manifest(self.base)

    def _merge(self, table: str, new: DataFrame, outdated: Callable[[DataFrame], list[DataFrame]]) -> None:
        """The touched buckets anew: ``new`` and what they held beside the ``outdated`` rows."""
        fresh = stage(new.withColumn("bucket", _bucket()), "fresh")
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # at most BUCKETS
        rows, old = fresh, self._read(table, touched)
        if old is not None:
            kept = old.withColumn("bucket", _bucket())
            for values in outdated(fresh):
                kept = kept.join(values.distinct(), values.columns, "left_anti")
            rows = kept.select(*fresh.columns).unionByName(fresh)
        folder = f"data/{table}/{self.id}-{uuid.uuid4().hex[:8]}"
        # The rebalance hint lets large buckets be written by several tasks.
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.store.root}/{folder}")
        known = self._next.get(table, {"buckets": {}})["buckets"]
        self._next[table] = {
            "schema": json.loads(new.schema.json()),
            "buckets": known | {str(b): f"{folder}/bucket={b}" for b in touched},
        }

    def _read(self, table: str, buckets: list[int]) -> DataFrame | None:
        """What the table holds so far in this change."""
        told = self._next.get(table)
        folders = [f for b, f in told["buckets"].items() if int(b) in buckets] if told else []
        if not folders:
            return None
        schema = StructType.fromJson(told["schema"])
        return self.store.spark.read.schema(schema).parquet(*[f"{self.store.root}/{f}" for f in folders])

    def replace_by_tag(self, table: str, rows: DataFrame) -> "Change":
        """Write rows in place of all that the table holds for their tags."""
        self._merge(table, rows, lambda fresh: [fresh.select("tag")])
        return self

    def upsert_nodes(self, table: str, nodes: DataFrame) -> "Change":
        """Write node records by id, one row for each; a tag's earlier forecast nodes are dropped first.

        Of new records with one id, the one whose other columns come last in order is kept.
        """
        rest = [c for c in nodes.columns if c != "external_id"]
        last = nodes.groupBy("external_id").agg(F.max(F.struct(*rest)).alias("_last"))
        nodes = last.select(*[F.col(c) if c == "external_id" else F.col(f"_last.{c}") for c in nodes.columns])
        self._merge(table, nodes, lambda fresh: [
            fresh.select("external_id"),
            fresh.where(F.col("view") == "forecast").select("tag", "view"),
        ])
        return self

    def commit(self) -> int:
        """Make the change valid with one rename; raises ``Conflict`` if another change did so since ``begin``."""
        store, version = self.store, self.base + 1
        system = store._system()
        draft, final = store._path("manifests", f"draft-{self.id}"), store._path("manifests", f"v{version:010d}")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps(self._next).encode()))
        out.close()
        context = store._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), store._conf)
        plain = store.spark.sparkContext._gateway.new_array(getattr(store._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            if system.exists(final):
                raise Conflict(f"version {version} is there already")
            context.rename(draft, final, plain)  # fails if the target exists
        except Conflict:
            system.delete(draft, False)
            raise
        except Exception as error:
            system.delete(draft, False)
            if system.exists(final):
                raise Conflict(f"version {version} is there already") from error
            raise
        self.base = version
        return version
