"""SimHash near-duplicates: fingerprints within a few bits, found exactly with vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded, unused
from pulsegrid.llm.components import connected, merge_pairs
from pulsegrid.session import stage

SEED = 42
PIECE = 1 << 16  # shingles hashed at a time, so that very long texts need no more memory than others


@dataclass(frozen=True)
class SimHashConfig:
    """``shingle`` words per shingle; texts are linked at ``max_bits`` or fewer differing bits.

    ``shard`` is the intended number of fingerprints in a leaf of the tree.  The tree is fitted on
    one in ``sample_every`` fingerprints, ``sample_limit`` at most; every fingerprint is indexed.
    """

    shingle: int = 3
    max_bits: int = 2
    shard: int = 2048
    sample_every: int = 16
    sample_limit: int = 1 << 20


def simhash(text: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text (bytes.lower and bytes.split know ASCII only)."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), PIECE):
        pieces = map(joined.__getitem__, map(slice, starts[k:k + PIECE], ends[k:k + PIECE]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(set_bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long; NULL and blank texts have 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            values = (simhash(texts[i].as_py() or b"", shingle) for i in range(len(texts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, type=pa.int64(), size=len(texts))], ["id", "fp"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(hashed, f"id {kind}, fp long")


# The tree ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Node i splits by distance to ``pivot[i]``: at most ``radius[i]`` goes to ``inner[i]``, else ``outer[i]``.

    A negative child is leaf ``-child - 1``; a tree of one leaf has no node.
    """

    pivot: np.ndarray
    radius: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.pivot) + 1


def build_tree(sample: np.ndarray, leaf: int, slack: int, seed: int = 1) -> Tree:
    """A tree with about ``leaf`` sample points per leaf.

    Of a few pivots and radii, each node takes the split with the fewest points in the band of
    ``slack`` bits beyond the radius (those are looked up on both sides), among fairly even splits.
    """
    rng = np.random.default_rng(seed)
    pivot, radius, inner, outer, leaves = [], [], [], [], 0
    stack = [(np.unique(sample.astype(np.uint64)), -1, False)]
    while stack:
        points, parent, is_inner = stack.pop()
        split = _split(points, slack, rng) if len(points) > leaf else None
        if split is None:
            own, leaves = -leaves - 1, leaves + 1
        else:
            own = len(pivot)
            pivot.append(split[0]), radius.append(split[1]), inner.append(0), outer.append(0)
            near = np.bitwise_count(points ^ split[0]) <= split[1]
            stack += [(points[~near], own, False), (points[near], own, True)]
        if parent >= 0:
            (inner if is_inner else outer)[parent] = own
    return Tree(*(np.array(x, dtype=t) for x, t in (
        (pivot, np.uint64), (radius, np.int64), (inner, np.int64), (outer, np.int64),
    )))


def _split(points: np.ndarray, slack: int, rng) -> tuple[np.uint64, int] | None:
    best = None
    for pivot in rng.choice(points, 6, replace=False) if len(points) >= 6 else points:
        counts = np.bincount(np.bitwise_count(points ^ pivot), minlength=65)
        within = np.cumsum(counts)
        for r in range(64):
            share = within[r] / len(points)
            if 0.25 <= share <= 0.75 or (best is None and 0 < within[r] < len(points)):
                band = (within[min(64, r + slack)] - within[r]) / len(points)
                cost = (not 0.25 <= share <= 0.75, band + abs(share - 0.5) / 4)
                if best is None or cost < best[0]:
                    best = (cost, pivot, r)
    return None if best is None else (np.uint64(best[1]), best[2])


def route(tree: Tree, points: np.ndarray, slack: int, home: np.ndarray | None = None):
    """``(leaf, position, is_home)`` arrays: each point's own leaf, and the leaves it must query.

    Of a linked pair whose leaves part at a node, the outer point is within ``slack`` of the inner
    one's side, so it is sent there too: one direction finds every pair exactly once.
    """
    everything = np.arange(len(points))
    home = np.ones(len(points), dtype=bool) if home is None else home
    if not len(tree.pivot):
        return np.zeros(len(points), dtype=np.int64), everything, home
    found, stack = [], [(0, everything, home)]
    while stack:
        node, at, own = stack.pop()
        if not len(at):
            continue
        if node < 0:
            found.append((np.full(len(at), -node - 1), at, own))
            continue
        d = np.bitwise_count(points[at] ^ tree.pivot[node]).astype(np.int64)
        near = d <= tree.radius[node]
        to_inner = near | (d <= tree.radius[node] + slack)
        to_outer = np.where(own, ~near, d > tree.radius[node] - slack)
        stack.append((tree.inner[node], at[to_inner], (own & near)[to_inner]))
        stack.append((tree.outer[node], at[to_outer], own[to_outer]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (everything, everything, home)


def leaf_links(points: np.ndarray, home: np.ndarray, max_bits: int, leaf: int = 2048):
    """``(a, b)`` positions that tie together all linked points of a leaf, one pair a point at most."""
    label = np.arange(len(points))
    homes = int(home.sum())
    if homes > 2 * leaf:  # a crowded leaf gets a tree of its own
        tree = build_tree(points[home], leaf, max_bits)
        if len(tree.pivot):
            where, at, own = route(tree, points, max_bits, home)
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            for part in np.split(order, cuts):
                _scan(points, at[part], own[part], max_bits, label)
            a = np.flatnonzero(label != np.arange(len(points)))
            return a, label[a]
    _scan(points, np.arange(len(points)), home, max_bits, label)
    a = np.flatnonzero(label != np.arange(len(points)))
    return a, label[a]


def _scan(points: np.ndarray, at: np.ndarray, own: np.ndarray, max_bits: int, label: np.ndarray) -> None:
    homes = at[own]
    for k in range(0, len(at), 512):
        block = at[k:k + 512]
        for m in range(0, len(homes), 8192):
            close = np.bitwise_count(points[block][:, None] ^ points[homes[m:m + 8192]][None, :]) <= max_bits
            i, j = np.nonzero(close)
            merge_pairs(label, block[i], homes[m:m + 8192][j])


# The operator --------------------------------------------------------------------------------


def fingerprint_links(distinct: DataFrame, config: SimHashConfig) -> DataFrame:
    """``(a, b)`` links that connect all distinct fingerprints ``fp`` within ``max_bits`` of each other."""
    spark = distinct.sparkSession
    n = distinct.count()
    every = max(config.sample_every, -(-n // config.sample_limit))
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(2 * config.sample_limit)
    points = np.array([r.fp for r in sample.collect()], dtype=np.int64).view(np.uint64)
    tree = build_tree(points, max(8, config.shard // every), config.max_bits)
    shared, slack, leaf = spark.sparkContext.broadcast(tree), config.max_bits, config.shard

    def routed(frames):
        for frame in frames:
            values = frame["fp"].to_numpy()
            where, at, own = route(shared.value, values.view(np.uint64), slack)
            yield pd.DataFrame({"leaf": where, "fp": values[at], "home": own})

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame["fp"].to_numpy()
        a, b = leaf_links(values.view(np.uint64), frame["home"].to_numpy(), slack, leaf)
        return pd.DataFrame({"a": values[a], "b": values[b]})

    shards = distinct.select("fp").mapInPandas(routed, "leaf long, fp long, home boolean")
    return shards.groupBy("leaf").applyInPandas(linked, "a long, b long")


def near_duplicates(
    docs: DataFrame, config: SimHashConfig = SimHashConfig(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``.

    A text is lower-cased (A-Z), cut into words at blanks and into shingles of ``config.shingle``
    words (a shorter text is one shingle); a bit of the fingerprint is set if over half of the
    shingles' XXH64 have it.  Rows are linked when their fingerprints differ in at most
    ``config.max_bits`` bits, and ``component_id`` is the smallest id reachable by links.

    Equal fingerprints collapse to one before the search, so a large group of copies costs one
    point.  The distinct fingerprints are dealt into the leaves of a vantage-point tree; a point
    near a boundary also queries the leaves beyond it, which the triangle inequality bounds, so
    every pair within reach is compared and found.  Groups, ties and repeated rows share a
    component.  NULL and empty texts have fingerprint 0, linked like any other; NULL ids keep
    their row but cannot be a component's id, which is NULL only if no id of it is known.
    """
    marked = stage(fingerprints(docs, config.shingle, id_col, text_col), "fingerprints")
    return marked.join(component_classes(marked, config), "fp").select("id", "fp", "component_id")


def component_roots(distinct: DataFrame, config: SimHashConfig) -> DataFrame:
    """``(fp, root)`` for distinct fingerprints ``fp``; linked ones share a root."""
    tied = stage(connected(fingerprint_links(distinct, config)), "tied")
    return distinct.select("fp").join(tied.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
    )


def component_classes(marked: DataFrame, config: SimHashConfig) -> DataFrame:
    """``(fp, component_id)`` for the distinct fingerprints of ``marked (id, fp)``, as a table."""
    distinct = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    tied = stage(distinct.join(component_roots(distinct, config), "fp"), "roots")
    smallest = stage(tied.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    return stage(tied.join(smallest, "root").select("fp", "component_id"), "classes")


def keep_representatives(
    docs: DataFrame, config: SimHashConfig = SimHashConfig(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the first by id, NULL ids last.

    Rows are numbered in a written copy, so that of rows that repeat an id one stays too.  The numbers
    to keep are joined back to the texts, broadcast below a counted size and shuffled beyond.
    """
    row = unused(docs, "_row")
    own = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    keyed = own.select(F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("key"), text_col)
    marked = stage(fingerprints(keyed, config.shingle, "key", text_col), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("id").alias("least"))
    distinct = stage(least, "distinct")
    roots = stage(component_roots(distinct, config), "roots")
    keep = stage(distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row)), "keep")
    side, _ = bounded(keep, 16)
    return own.join(side, row, "left_semi").drop(row)


def fingerprint_hex(fp):
    """16 lowercase hex digits of a fingerprint column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
