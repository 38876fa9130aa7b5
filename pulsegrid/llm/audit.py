"""What every order of a set of filters removes, from one pass over the texts and folds in SQL functions."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import BLANK
from pulsegrid.session import stage

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> dict[str, Column]:
    """The conditions on one text under which the filters A to D remove it."""
    words = F.array_remove(F.split(text, BLANK), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    quality_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by the set of filters that they fail.

    Bit ``k`` of ``mask`` is the ``k``-th of ``FILTERS``.  E, being identical to a text with a smaller
    id, is found for all copies at once: of a text's rows those with the smallest id pass.  Rows are
    counted by (text, id) first and then by (text, part, label), so a text that fills a third of the
    table is partial sums wherever its rows lie, and what meets in one task is a row per part and
    label.

    NULL texts are empty; a NULL part is the empty string; a NULL id is larger than all others and
    has no labels.  Rows that repeat an id and a text are counted each, and neither is a copy of the
    other.  A document with several label rows is good or toxic if one of them says so.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(text).values())), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), bits.alias("bits"),
    )
    told = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col(quality_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"),
    )
    flag = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    known = rows.join(told, "id", "left").select("id", "part", "digest", "bits", *flag)
    place = F.struct(F.col("id").isNull().alias("missing"), "id")
    cell = ["digest", "part", "bits", "good", "toxic"]
    same = known.groupBy("id", *cell).agg(F.count("*").alias("rows"))
    copies = same.groupBy(*cell).agg(
        F.sum("rows").alias("rows"), F.min(place).alias("first"), F.min_by("rows", place).alias("at_first"),
    )
    least = F.min("first").over(W.partitionBy("digest"))
    split = copies.withColumn("least", least).withColumn(
        "passes", F.when(F.col("first").eqNullSafe(F.col("least")), F.col("at_first")).otherwise(0),
    )
    e = 1 << FILTERS.index("E")
    masks = F.inline(F.array(
        F.struct(F.col("bits").alias("mask"), F.col("passes").alias("n")),
        F.struct((F.col("bits") + e).alias("mask"), (F.col("rows") - F.col("passes")).alias("n")),
    ))

    def weighed(flagged: str) -> Column:
        return F.sum(F.col("n") * F.col(flagged))

    counted = split.select("part", "good", "toxic", masks).where("n > 0")
    return counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), weighed("good").alias("good"), weighed("toxic").alias("toxic"),
    )


def _counts(*values: Column) -> Column:
    return F.struct(*[v.cast("long").alias(c) for c, v in zip(COUNTS, values)])


def fold_orders(cells: DataFrame) -> DataFrame:
    """``(part, filter_order, step, counts..., shapley)`` from ``failure_cells``.

    The orders are one constant array.  Each cell folds along every order with ``aggregate``: the
    state is whether the documents are still there and what the steps so far did, so a cell gives
    one struct of weighted counts per order and step.  The cells of a part, at most one per set of
    filters, are merged by elementwise sums, and a filter's Shapley sum is taken from the merged
    array.
    """
    orders = F.array(*[F.array(*map(F.lit, order)) for order in permutations(range(len(FILTERS)))])
    n, good, toxic, mask = (F.col(c) for c in ("n", "good", "toxic", "mask"))

    def fold(order: Column) -> Column:
        def step(state: Column, f: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1), f)
            fails = mask.bitwiseAND(bit) != 0
            there = state["there"]
            goes = there & fails
            took = _counts(
                F.when(there & ~fails, n).otherwise(0), F.when(goes, n).otherwise(0), F.when(~there & fails, n).otherwise(0),
                F.when(mask == bit, n).otherwise(0), F.when(goes, good).otherwise(0), F.when(goes, toxic).otherwise(0),
            )
            return F.struct((there & ~fails).alias("there"), F.concat(state["took"], F.array(took)).alias("took"))

        nothing = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
        return F.aggregate(order, F.struct(F.lit(True).alias("there"), nothing.alias("took")), step, lambda s: s["took"])

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: _counts(*[x[c] + y[c] for c in COUNTS]))

    folded = cells.select("part", F.flatten(F.transform(orders, fold)).alias("took"))
    zeros = F.array_repeat(_counts(*[F.lit(0)] * len(COUNTS)), 600)
    merged = folded.groupBy("part").agg(F.collect_list("took").alias("all")).select(
        "part", F.aggregate("all", zeros, add).alias("took"), F.flatten(orders).alias("filters"),
    )

    def removed_by(f: int) -> Column:
        def more(total: Column, x: Column) -> Column:
            return total + F.when(x["filters"] == f, x["took"]["removed"]).otherwise(0)

        return F.aggregate(F.arrays_zip("took", "filters"), F.lit(0).cast("long"), more)

    shapley = F.array(*map(removed_by, range(len(FILTERS))))
    summed = merged.select("part", "filters", "took", shapley.alias("shapley"))
    rows = summed.select("part", "filters", "shapley", F.posexplode("took").alias("pos", "took"))
    size = len(FILTERS)
    first = F.floor(F.col("pos") / size).cast("int") * size
    letters = F.transform(F.slice("filters", first + 1, F.lit(size)), lambda f: F.substring(F.lit(FILTERS), f + 1, F.lit(1)))
    return rows.select(
        "part", F.array_join(letters, "").alias("filter_order"), (F.col("pos") % size + 1).cast("int").alias("step"),
        *[F.col(f"took.{c}").alias(c) for c in COUNTS], F.get("shapley", F.get("filters", F.col("pos"))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step; parts without documents have none.

    An empty table gives no rows.  Texts are read whole, once; what is kept of them is a digest and
    four bits, and after the counts a part is at most 32 rows.  See ``failure_cells`` for NULLs,
    repeated rows and the names of the columns.
    """
    return fold_orders(stage(failure_cells(docs, labels, **columns), "cells"))
