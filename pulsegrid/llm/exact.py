"""Exact duplicates with heavy digests split off by Misra-Gries summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import BLANK, id_order
from pulsegrid.session import stage


def reduce_counters(counters: dict[bytes, int], size: int) -> dict[bytes, int]:
    """At most ``size`` counters: all are lowered by the largest count that does not fit."""
    if len(counters) <= size:
        return counters
    cut = int(np.partition(np.fromiter(counters.values(), np.int64), -size - 1)[-size - 1])
    return {k: v - cut for k, v in counters.items() if v > cut}


def heavy_hitters(digests: DataFrame, size: int = 1024) -> DataFrame:
    """Digests that may hold more than 2 / (size + 1) of the rows: ``size + 1`` rows at most.

    Every partition keeps a Misra-Gries summary of ``size`` counters.  Summaries add up: the sum of
    a digest's counters is at most its frequency, and short of it by at most n / (size + 1).  So all
    digests above twice that share pass the bar of one share, and no more than size + 1 can.
    """

    def summary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict[bytes, int] = {}
        for frame in frames:
            for digest, n in frame["digest"].value_counts().items():
                counters[digest] = counters.get(digest, 0) + int(n)
            counters = reduce_counters(counters, size)
        yield pd.DataFrame({"digest": list(counters), "n": np.array(list(counters.values()), dtype=np.int64)})

    rows = digests.count()
    sums = digests.select("digest").mapInPandas(summary, "digest binary, n long")
    bar = max(1.0, rows / (size + 1))
    return sums.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > bar).select("digest")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024,
) -> DataFrame:
    """``(id, keep_id, group_size, kept, digest)`` for every row of ``docs``.

    Texts are equal if they are after every run of blanks becomes one space; a NULL text counts as
    empty.  Of equal texts the row with the smallest id is kept; of rows that repeat an id and a
    text one is kept; a NULL id counts as larger than all others.  An empty table gives no rows.

    The digests of the whole texts are written once.  Misra-Gries finds the few that may be
    frequent; their exact counts and first rows are verified with partial sums and broadcast
    (``counters + 1`` rows at most, about 100 bytes each), so their copies are resolved where they
    lie.  All other digests are shuffled, and none of them holds more than 2 / (counters + 1) of
    the rows.
    """
    text = F.regexp_replace(F.coalesce(text_col, F.lit("")), BLANK, " ")
    digests = stage(docs.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    ), "digests")
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "row"))
    heavy = heavy_hitters(digests, counters)
    verified = stage(
        digests.join(F.broadcast(heavy), "digest", "left_semi")
        .groupBy("digest").agg(F.count("*").alias("group_size"), first.alias("first")),
        "heavy",
    )
    hot = digests.join(F.broadcast(verified), "digest").select(
        "id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest",
    )
    group = W.partitionBy("digest")
    ordered = group.orderBy(*id_order("id"), "row")
    rest = digests.join(F.broadcast(verified), "digest", "left_anti").select(
        "id", F.first("id").over(ordered).alias("keep_id"), F.count("*").over(group).alias("group_size"),
        (F.row_number().over(ordered) == 1).alias("kept"), "digest",
    )
    return hot.unionByName(rest)
