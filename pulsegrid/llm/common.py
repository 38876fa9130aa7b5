"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import configure

BLANK = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast below so many bytes (rows counted, width known), else shuffled.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space, tab and line ends; 0 for NULL."""
    filled = F.coalesce(text, F.lit(""))
    return F.regexp_count(filled, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def id_order(key: str) -> list[Column]:
    """Ids ascending, missing ids last."""
    return [F.col(key).isNull(), F.col(key)]


def bounded(df: DataFrame, width: int, bound: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if its counted rows times ``width`` bytes stay below ``bound``.

    ``df`` should be a staged table, as it is counted first.
    """
    small = df.count() * width <= bound
    return (F.broadcast(df) if small else df), small


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
