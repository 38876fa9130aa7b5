"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import stage


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest node of that neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = stage(_nearest(both).select("u", F.least("u", "m").alias("m")), "nearest")
    return (
        both.join(smallest, "u").where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the smallest of them."""
    tied = edges.join(stage(_nearest(edges), "nearest"), "u")
    rest = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    own = tied.select("u", F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; the root is the smallest node reached.

    Each half round is staged as a table, so that a lost executor costs one re-read.  Smallest
    neighbours come from partial sums and are a table too, so that the join of a node's links with
    its one row is a plain join, whose crowded keys Spark splits over tasks.
    The number of rounds grows with the logarithm of the longest chain.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    mark = _signature(edges)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        edges = stage(_small_star(stage(_large_star(edges), "links")), "links")
        before, mark = mark, _signature(edges)
        if before == mark:
            break
    else:
        raise RuntimeError(f"links are not settled after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
    ).first())


def merge_pairs(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the components of an array of local labels along pairs, in place.

    ``label[i]`` is the smallest position of i's component, before and after.
    """
    while len(left):
        a, b = label[left], label[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            return
        left, right, low, high = left[open_], right[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped
