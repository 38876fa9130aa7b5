"""Best-fit packing of documents into fixed-length training sequences, with conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import BLANK, word_count
from pulsegrid.session import stage

PLACED = "id {kind}, row long, piece long, start long, words long, bin long, bin_offset long"


@dataclass(frozen=True)
class PackConfig:
    """Bins of ``capacity`` words; at most ``per_source`` pieces of a source and one of a cluster in a bin.

    ``shard_words`` is what one shard packs by itself: enough that bins left open at its end are
    few, and a bound on its memory.
    """

    capacity: int = 2048
    per_source: int = 2
    shard_words: int = 1 << 20


class Bins:
    """Open bins ordered by residual; each carries bitmaps of its sources and of its clusters.

    ``sources[k]`` marks the sources that a bin holds more than k times, so the last of
    ``per_source`` bitmaps marks those that are full.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []

    def place(self, words: int, source: int, cluster: int) -> tuple[int, int]:
        """``(bin, offset)`` in the tightest compatible bin that has room, else in a new one."""
        source, cluster = 1 << source, 1 << cluster
        for at in range(bisect_left(self.open, (words, -1)), len(self.open)):
            residual, bin_ = self.open[at]
            marks = self.sources[bin_]
            if not (self.clusters[bin_] & cluster or marks[-1] & source):
                del self.open[at]
                break
        else:
            residual, bin_ = self.capacity, len(self.clusters)
            marks = [0] * self.per_source
            self.sources.append(marks), self.clusters.append(0)
        self.clusters[bin_] |= cluster
        for k, mark in enumerate(marks):
            marks[k] = mark | source
            if not mark & source:
                break
        if residual > words:
            insort(self.open, (residual - words, bin_))
        return bin_, self.capacity - residual


def pack_shard(frame: pd.DataFrame, config: PackConfig) -> pd.DataFrame:
    """Place the documents ``(id, row, words, source, cluster)`` of one shard, the largest rest first."""
    bins = Bins(config.capacity, config.per_source)
    sources, clusters = pd.factorize(frame["source"])[0], pd.factorize(frame["cluster"])[0]
    words, full = frame["words"].to_numpy(), len(frame) * [0]
    out = {k: [] for k in ("at", "piece", "start", "words", "bin", "bin_offset")}

    def put(*values):
        for column, value in zip(out.values(), values):
            column.append(value)

    for at, n in enumerate(words.tolist()):  # whole bins of long documents
        full[at] = n // config.capacity
        for piece in range(full[at]):
            bins.clusters.append(0), bins.sources.append([0] * config.per_source)
            put(at, piece, piece * config.capacity, config.capacity, len(bins.clusters) - 1, 0)
    rest = words % config.capacity
    keys = frame.assign(rest=-rest, at=range(len(frame))).sort_values(["rest", "row"], kind="stable")
    for at in keys["at"].tolist():
        left = int(rest[at])
        if left:
            bin_, offset = bins.place(left, int(sources[at]), int(clusters[at]))
            put(at, full[at], full[at] * config.capacity, left, bin_, offset)
    placed = pd.DataFrame(out)
    at = placed.pop("at").to_numpy(dtype="int64")
    return placed.assign(id=frame["id"].to_numpy()[at], row=frame["row"].to_numpy()[at])


def pack(
    docs: DataFrame, config: PackConfig = PackConfig(), id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", cluster_col: str | None = None,
) -> DataFrame:
    """``(id, row, piece, start, words, bin, bin_offset)``: where the words of each document go.

    A document longer than a bin fills whole bins by itself; its rest, and every shorter document,
    goes to the bin with the least sufficient room that holds neither ``per_source`` pieces of its
    source nor any of its duplicate cluster (equal texts apart from case and blanks, or the values of
    ``cluster_col``).  If the tightest bin conflicts, the search goes on to the next larger residual
    until a bin is compatible, and opens a new one if none is.

    Documents are dealt by hash into shards of about ``shard_words`` words, so every shard holds a
    like mix of sources and a hot source or cluster is spread over all of them; conflicts are
    within bins, and bins within shards.  Only ids, sizes and hashes are shuffled, no text.

    NULL sources are one source; a document without words has one row with piece 0, no words and a
    NULL bin; rows that repeat are packed as separate documents (of one cluster); an empty table
    gives no rows.  ``row`` tells apart rows that repeat an id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(
        F.lower(F.trim(F.regexp_replace(text, BLANK, " "))),
    )
    sized = stage(docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), word_count(F.col(text_col)).alias("words"),
        F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))).alias("source"),
        cluster.alias("cluster"),
    ), "sized")
    total = sized.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, round(total / config.shard_words))
    dealt = sized.where("words > 0").withColumn("shard", F.pmod(F.xxhash64("id", "row"), F.lit(shards)))

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        placed = pack_shard(frame, config)
        placed["bin"] += int(key[0]) << 32
        return placed[["id", "row", "piece", "start", "words", "bin", "bin_offset"]]

    schema = PLACED.format(kind=kind)
    none = F.lit(None).cast("long")
    blank = sized.where("words = 0").select(
        "id", "row", *(F.lit(0).cast("long").alias(c) for c in ("piece", "start", "words")),
        none.alias("bin"), none.alias("bin_offset"),
    )
    return dealt.groupBy("shard").applyInPandas(packed, schema).unionByName(blank)
