"""Joining per-tag tables to readings without trusting their size or the key distribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 256 << 20
SALTS = 64


@dataclass(frozen=True)
class SeriesProfile:
    """What one narrow scan tells about a series: tags, readings of the largest tag, tag width."""

    tags: int
    largest: int
    tag_bytes: int

    def with_groups(self, factor: int) -> "SeriesProfile":
        """The profile of a table with up to ``factor`` groups per tag."""
        return SeriesProfile(self.tags * factor, self.largest, self.tag_bytes)


def profile(series: DataFrame, keys: tuple[str, ...] = ("tag",)) -> SeriesProfile:
    """Measure a series; reads the key columns only and shuffles one partial count per tag."""
    width = sum((F.max(F.octet_length(F.col(k).cast("string"))) for k in keys), F.lit(0))
    row = (
        series.groupBy(*keys).count()
        .agg(F.count("*").alias("tags"), F.max("count").alias("largest"), width.alias("bytes"))
        .first()
    )
    return SeriesProfile(row["tags"], row["largest"] or 0, row["bytes"] or 0)


def attach(
    rows: DataFrame,
    stats: DataFrame,
    size: SeriesProfile,
    keys: tuple[str, ...] = ("tag",),
    how: str = "inner",
    rows_per_key: int = 1,
    bound: int | None = None,
) -> DataFrame:
    """Join a per-tag table to readings.

    ``size`` bounds the number of rows of ``stats`` (tags x ``rows_per_key``).  Below
    ``bound`` bytes (``BROADCAST_BYTES`` unless given) the table is broadcast and the readings do not move.  Beyond it both
    sides are shuffled on ``(keys, salt)``: each row of ``stats`` is repeated once per salt, so a
    tag that holds a large share of the readings is spread over ``SALTS`` tasks.
    """
    width = size.tag_bytes + 16 + sum(
        (f.dataType.simpleString() == "string" and 64) or 16 for f in stats.schema.fields
    )
    if size.tags * rows_per_key * width <= (BROADCAST_BYTES if bound is None else bound):
        return rows.join(F.broadcast(stats), list(keys), how)
    spread = [c for c in rows.columns if c not in keys] or list(keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
