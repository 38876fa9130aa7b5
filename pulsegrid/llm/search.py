"""Ranked lexical search: term-at-a-time over blocks of documents, with limited accumulators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.session import stage

# Fixed values of the scoring rule.
LENGTH_PERCENT = 75
WEIGHT_SCALE, SCORE_SCALE, TERM_SCALE, LENGTH_SCALE = 1000, 1_000_000_000, 1000, 8

#: ASCII letters become small; every other ASCII character that is no digit parts terms.
_TABLE = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256)
)


@dataclass(frozen=True)
class SearchConfig:
    """The ``k`` best documents per item.

    ``block`` documents share an index and accumulators in a task.  Items are taken in groups of
    about ``item_bytes`` bytes of text, whose terms every task holds; each group reads the documents anew.
    """

    k: int = 10
    block: int = 1 << 14
    item_bytes: int = 16 << 20


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, repeats included; none for NULL."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _matched(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, tfs)``: each document's length and its occurrences of the items' terms."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, ends, own, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                found = terms(text)
                lengths.append(len(found))
                counted = Counter(p for p in map(known.get, found) if p is not None)
                own += counted.keys()
                tfs += counted.values()
                ends.append(len(own))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(own, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
            ], names=["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(read, f"id {kind}, n long, terms array<int>, tfs array<long>"), "matched")


def impacts(
    weights: np.ndarray, of: np.ndarray, tf: np.ndarray, length: np.ndarray, documents: int, occurrences: int,
) -> np.ndarray:
    """What one occurrence of a term in an item adds to each document that holds it, in integers."""
    norm = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * length * documents) // max(1, occurrences)
    return weights[of] * ((SCORE_SCALE * tf) // (TERM_SCALE * tf + LENGTH_SCALE * norm))


def rank_block(
    order: list[tuple[int, int]], postings: dict[int, tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the ``k`` best for one item, their exact scores, and accumulators made.

    ``order`` has the item's ``(term, repeats)``, rarest first; ``postings`` a term's documents, ascending, and
    impacts.  A document gets an accumulator when a term first meets it, until the terms left
    together cannot lift a new document to the ``k``-th partial score (or ``floor``, a score that ``k``
    documents reach elsewhere).  From then on terms only add to the accumulators that are left,
    each of which is dropped as soon as its own bound falls below that score.  Equal scores are
    never dropped, because ids decide between them.
    """
    own = [(repeats, *postings[term]) for term, repeats in order if term in postings]
    bounds = [repeats * int(impact.max()) for repeats, _, impact in own]
    left = sum(bounds)
    scores, made = np.zeros(size, np.int64), np.zeros(size, bool)
    alive, created = None, 0

    def kth(values: np.ndarray) -> int:
        return max(floor, int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0)

    for (repeats, at, impact), bound in zip(own, bounds):
        if alive is None and left < kth(scores[made]):
            alive = np.flatnonzero(made)
            created = len(alive)
        if alive is None:
            scores[at] += repeats * impact
            made[at] = True
        elif len(alive):
            place = np.minimum(np.searchsorted(at, alive), len(at) - 1)
            hit = at[place] == alive
            scores[alive[hit]] += repeats * impact[place[hit]]
        left -= bound
        if alive is not None:
            held = scores[alive]
            alive = alive[held + left >= kth(held)]
    if alive is None:
        alive = np.flatnonzero(made)
        created = len(alive)
    return alive, scores[alive], created


def _best(matched: DataFrame, items: dict[int, list[tuple[int, int]]], weights: np.ndarray, documents: int, occurrences: int, config: SearchConfig) -> DataFrame:
    """``(item, id, score)``: the best of every task, ties at its last score included."""
    spark = matched.sparkSession
    shared = spark.sparkContext.broadcast((items, weights))
    kind = matched.schema["id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        held = {item: (np.zeros(0, np.int64), []) for item in items}

        def rank(block: pa.Table) -> None:
            ids = block.column("id").to_pylist()
            lists = block.column("terms").combine_chunks()
            counts = np.diff(lists.offsets.to_numpy())
            of = lists.flatten().to_numpy()
            tf = block.column("tfs").combine_chunks().flatten().to_numpy()
            doc = np.repeat(np.arange(len(ids)), counts)
            length = block.column("n").to_numpy()[doc]
            impact = impacts(weights, of, tf, length, documents, occurrences)
            by = np.lexsort((doc, of))
            of, doc, impact = of[by], doc[by], impact[by]
            cuts = np.flatnonzero(np.diff(of)) + 1
            heads = of[np.concatenate([[0], cuts])] if len(of) else of
            postings = dict(zip(heads.tolist(), zip(np.split(doc, cuts), np.split(impact, cuts))))
            for item, order in items.items():
                scores, names = held[item]
                floor = int(scores[config.k - 1]) if len(scores) >= config.k else 0
                at, found, _ = rank_block(order, postings, len(ids), config.k, floor)
                at, found = at[found > 0], found[found > 0]
                if not len(at):
                    continue
                scores = np.concatenate([scores, found])
                names = names + [ids[p] for p in at]
                down = sorted(range(len(names)), key=lambda p: (-scores[p], names[p] is None, names[p] if names[p] is not None else 0))[:config.k]
                held[item] = scores[down], [names[p] for p in down]

        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= config.block:
                rank(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
        if waiting:
            rank(pa.Table.from_batches(waiting))
        for item, (scores, names) in held.items():
            if len(names):
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(names), pa.int64()), pa.array(names, id_type), pa.array(scores, pa.int64()),
                ], names=["item", "id", "score"])

    return matched.mapInArrow(read, f"item long, id {kind}, score long")


def _search_group(docs: DataFrame, group: list, config: SearchConfig, id_col: str, text_col: str) -> DataFrame:
    """``(item, id, score)`` for a bounded group of ``(number, text)`` items."""
    bags = {number: Counter(terms(text)) for number, text in group}
    vocabulary = {term: p for p, term in enumerate(sorted({t for bag in bags.values() for t in bag}))}
    matched = _matched(docs, vocabulary, id_col, text_col)
    totals = matched.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("occurrences")).first()
    documents, occurrences = totals["documents"], totals["occurrences"] or 0
    frequency = np.zeros(len(vocabulary), np.int64)
    for row in matched.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        frequency[row["term"]] = row["count"]
    weights = np.floor(WEIGHT_SCALE * np.log((2 * documents + 2) / (2 * frequency + 1))).astype(np.int64)
    items = {
        number: sorted(((vocabulary[t], repeats) for t, repeats in bag.items()), key=lambda p: (frequency[p[0]], p[0]))
        for number, bag in bags.items() if bag
    }
    return _best(matched, items, weights, documents, occurrences, config)


def search(
    docs: DataFrame, items: DataFrame, config: SearchConfig = SearchConfig(), id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(item_id, rank, id, score)``: the ``k`` best documents above 0 for every row of ``items``.

    Two passes: one over the texts, which writes each document's length and its counts of the items'
    terms, and one over that table, in which every task ranks its documents block by block and hands
    on at most ``k`` rows an item.  No postings are shuffled, and no task holds more than a block, whatever the
    frequency of a term.  Scores are exact integers; equal scores are ordered by id, missing ids last.

    NULL and empty texts have no terms; an item without terms, or whose terms are in no document,
    has no rows; rows of ``items`` that repeat an id are ranked each on its own; rows of ``docs`` that
    repeat an id are documents of their own; very long texts are read whole; if either table is
    empty, so is the result.  Ids of documents are integers.
    """
    spark = docs.sparkSession
    own = stage(items.select(
        F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"), F.monotonically_increasing_id().alias("item"),
    ), "items")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 + size // config.item_bytes
    parts = []
    for g in range(groups):
        chosen = own.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).select("item", "text")
        group = [(r["item"], r["text"]) for r in chosen.collect()]
        if group:
            parts.append(_search_group(docs, group, config, id_col, text_col))
    if not parts:
        kind = docs.select(id_col).schema[0].dataType.simpleString()
        parts = [spark.createDataFrame([], f"item long, id {kind}, score long")]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(
        W.partitionBy("item").orderBy(F.desc("score"), F.col("id").isNull(), "id"),
    )).where(F.col("rank") <= config.k)
    return ranked.join(own.drop("text"), "item").select("item_id", "rank", "id", "score")
