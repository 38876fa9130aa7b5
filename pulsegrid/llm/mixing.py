"""A curriculum over sources: targets by weight, and training positions from schedules in time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded, unused, word_count
from pulsegrid.session import stage


@dataclass(frozen=True)
class MixConfig:
    """Weights and ramps repeat over the sources in order.

    A source's weight goes linearly from ``1 - ramp`` to ``1 + ramp`` times its mean over the
    training time 0 to 1.  ``cap`` is the largest multiple of its size that a source may give.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    ramps: tuple[float, ...] = (-0.5, 0.0, 0.5)
    cap: int = 3


def running_sums(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row of its group.

    Rows are dealt by ranges of ``(group, order)``, so a group of any size is spread over many
    tasks; what the earlier ranges of a group hold is added from a table of one row per range and group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(
        df.repartitionByRange(n, group, *order).withColumn("_part", F.spark_partition_id()), "ranges",
    )
    before = W.rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", group).agg(F.sum(value).alias("_total"))
    offsets = totals.select("_part", group, F.coalesce(
        F.sum("_total").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0),
    ).alias("_offset"))
    inside = W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        dealt.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, ["_part", group])
        .withColumn(out, F.col(out) + F.col("_offset")).drop("_part", "_offset")
    )


def source_targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """``(source, rank, source_size, weight, ramp, target)``, one row per source of ``sizes``.

    The total of all sizes is shared by weight; a share above ``cap`` times its source's size stops
    there and the excess is shared again among the others, until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.select("source", "source_size", F.lit(0).alias("all"), F.lit(1).alias("one"), F.col("source").isNull().alias("missing"))
    ranked = running_sums(totals, "all", ["missing", "source"], "one", "rank")

    def cycle(values: tuple, kind: str) -> Column:
        return F.get(F.array(*map(F.lit, values)), (F.col("rank") % len(values)).cast("int")).cast(kind)

    ranked = stage(ranked.select(
        "source", "rank", "source_size", cycle(config.weights, "long").alias("weight"), cycle(config.ramps, "double").alias("ramp"),
        (F.col("source_size") * config.cap).alias("most"),
    ), "sources")
    share, capped = None, 0
    while True:
        above = F.lit(False) if share is None else F.col("weight") * F.lit(share) > F.col("most")
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("most")).otherwise(0)).alias("stopped"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight"), F.count(F.when(above, 1)).alias("n"),
        ).first()
        if share is not None and row["n"] == capped:
            break
        capped = row["n"]
        share = (row["all"] - row["stopped"]) / row["weight"] if row["weight"] else 0.0
    return ranked.select(
        "source", "rank", "source_size", "weight", "ramp",
        F.least(F.col("weight") * F.lit(share), F.col("most").cast("double")).alias("target"),
    )


def training_time(done: Column, ramp: Column) -> Column:
    """The time at which a source has given the share ``done`` of its tokens.

    With weight ``1 + ramp (2 t - 1)`` the tokens given until t are ``(1 - ramp) t + ramp t^2``.
    """
    return 2 * done / ((1 - ramp) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * done))


def mix(
    docs: DataFrame, config: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", row_col: str | None = None,
) -> DataFrame:
    """``(row, id, size, source, source_size, target, taken, copies)`` for every row of ``docs``.

    A document's size is its number of words.  Each source gives its target, rounded to whole
    words: its documents, in an order fixed by the MD5 of their ids, are read again and again until
    the target is reached, which cuts the last document taken at the end of the demand.  ``taken``
    are the words taken of a document over all rounds.  ``copies`` are ``(part, words, time)``:
    the training time at which each round reaches the document, from the inverse of the source's
    integrated weight schedule.  Nothing is random, so reruns agree.

    NULL sources are one source, last in order; NULL and empty texts have size 0, take nothing and
    have no copies; rows that repeat an id are documents of their own; an empty table gives no rows.
    ``row_col`` names a column that tells rows apart, if there is one.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sizes = stage(docs.select(
        row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
    ), "sizes")
    targets = stage(source_targets(sizes, config), "targets")
    side, _ = bounded(targets.withColumnRenamed("source", "_source"), 256)
    told = sizes.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    told = running_sums(told, "rank", ["key", "id", "row"], "size", "before")
    demand = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(demand / F.col("source_size"))).otherwise(0).cast("long")
    rest = demand - F.col("rounds") * F.col("source_size")
    told = told.withColumn("demand", demand).withColumn("rounds", rounds)
    told = told.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before"))))
    parts = F.when(F.col("size") > 0, F.col("rounds") + (F.col("extra") > 0).cast("long")).otherwise(0)
    copies = F.when(parts > 0, F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.struct(
        k.alias("part"), F.when(k < F.col("rounds"), F.col("size")).otherwise(F.col("extra")).alias("words"),
        training_time((k * F.col("source_size") + F.col("before")) / F.col("demand"), F.col("ramp")).alias("time"),
    ))).otherwise(F.array().cast("array<struct<part:bigint,words:bigint,time:double>>"))
    return told.select(
        "row", "id", "size", "source", "source_size", "target",
        (F.col("rounds") * F.col("size") + F.col("extra")).alias("taken"), copies.alias("copies"),
    )


def mixed_documents(
    docs: DataFrame, config: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, in training order.

    Rows are sorted by training time over ranges, so the written files follow one another.  A
    source's last document is cut after the words that its target still asks for.
    """
    row, size, copy = (unused(docs, f"_mix_{c}") for c in ("row", "size", "copy"))
    own = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    plan = stage(
        mix(own, config, id_col, text_col, source_col, row).where("taken > 0")
        .select(F.col("row").alias(row), F.col("size").alias(size), F.explode("copies").alias(copy)), "plan",
    )
    side, _ = bounded(plan, 72)
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    first = F.regexp_extract(F.col(text_col), r"^[\x20\x09-\x0D]*", 0)
    text = F.when(F.col(f"{copy}.words") == F.col(size), F.col(text_col)).otherwise(
        F.concat(first, F.array_join(F.slice(words, F.lit(1), F.col(f"{copy}.words").cast("int")), "")),
    )
    order = [F.col(f"{copy}.time"), F.col(row), F.col(f"{copy}.part")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = own.join(side, row).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ordered.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
