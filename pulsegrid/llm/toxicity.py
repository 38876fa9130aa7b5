"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a hashed linear scorer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import held_out
from pulsegrid.llm.weak import LabelModel, fit_label_model, fit_linear, unpack
from pulsegrid.session import stage

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
MASKED = re.compile(r"\b[^\W\d_]\*{2,}[^\W\d_]*")
SHOUTED = re.compile(r"\b[^\W\d_]{4,}!{2,}")
PATTERNS = 3


@dataclass(frozen=True)
class ToxicityConfig:
    """Bounds of what is learned from: ``labelled`` labelled texts, ``training`` texts of either class.

    Words and stems make up ``lexicons`` lexicons each; a term needs ``support`` toxic texts and ``odds``
    times the clean rate, and every term that has both is in one.
    """

    labelled: int = 12000
    training: int = 4000
    lexicons: int = 4
    support: int = 4
    odds: float = 20.0
    buckets: int = 1 << 20

    @property
    def voters(self) -> int:
        return 2 * self.lexicons + PATTERNS


@dataclass(frozen=True)
class ToxicityModel:
    words: dict[str, int]  # term -> number of its lexicon
    stems: dict[str, int]
    label_model: LabelModel
    weights: dict[int, float]
    intercept: float
    config: ToxicityConfig


def term_set(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def stem_set(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in STEMS if len(w) > k}


def vote(text: str | None, words: dict[str, int], stems: dict[str, int], config: ToxicityConfig) -> int:
    """The votes on a text as bits: word lexicons, stem lexicons, then the patterns."""
    found = term_set(text)
    bits, hits = 0, 0
    for word in found & words.keys():
        bits |= 1 << words[word]
        hits += 1
    for stem in stem_set(found) & stems.keys():
        bits |= 1 << (config.lexicons + stems[stem])
    base = 2 * config.lexicons
    bits |= (hits >= 2) << base
    if text:
        bits |= bool(MASKED.search(text)) << (base + 1) | bool(SHOUTED.search(text)) << (base + 2)
    return bits


def features(words: set[str], buckets: int) -> set[int]:
    """Hashed words and stems of a text."""
    found = {crc32(b"=" + w.encode("utf-8", "replace")) % buckets for w in words}
    found.update(crc32(s.encode("utf-8", "replace")) % buckets for s in stem_set(words))
    return found


def _labelled(docs, labels, config, id_col, text_col, label_id, label_col) -> DataFrame:
    """A bounded sample of the texts whose labels may be learned from."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull() & ~held_out(F.col(label_id))).select(
        F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("toxic"), F.pmod(F.xxhash64(label_id), F.lit(1 << 20)).alias("draw"),
    )
    usable = stage(usable.groupBy("id", "draw").agg(F.max("toxic").alias("toxic")), "labels")
    n = usable.count()
    bar = (1 << 20) if n <= config.labelled else round(config.labelled / n * (1 << 20))
    some = usable.where(F.col("draw") < bar).select("id", "toxic")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")


def mine_lexicons(sample: DataFrame, config: ToxicityConfig) -> tuple[dict[str, int], dict[str, int]]:
    """Words and stems far more frequent in toxic texts, dealt over the lexicons in order of support.

    Ties in support go by fewer clean texts, then by the term.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for frame in frames:
            for label, text in zip(frame["toxic"], frame["text"]):
                words = term_set(text)
                side = toxic if label == 1 else clean
                side.update("w" + w for w in words)
                side.update("s" + s for s in stem_set(words))
        keys = list(toxic.keys() | clean.keys())
        yield pd.DataFrame({
            "term": np.array(keys, dtype=object), "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys],
        }).astype({"toxic": "int64", "clean": "int64"})

    classes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic_n, clean_n = max(1, classes.get(1, 0)), max(1, classes.get(0, 0))
    odds = (F.col("toxic") / toxic_n) / ((F.col("clean") + 0.5) / clean_n)
    counted = (
        sample.mapInPandas(count, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= config.support) & (odds >= config.odds))
    )
    lexicons: list[dict[str, int]] = []
    for mark in ("w", "s"):
        best = counted.where(F.col("term").startswith(mark)).orderBy(F.desc("toxic"), "clean", "term").collect()
        lexicons.append({r["term"][1:]: k % config.lexicons for k, r in enumerate(best)})
    return lexicons[0], lexicons[1]


def fit(
    docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), id_col: str = "doc_id",
    text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic",
) -> ToxicityModel:
    """Fit voters, label model and scorer.

    Lexicons are mined from a bounded sample of labelled texts.  All texts are voted on; a row per
    pattern of votes and label (there are ``2^voters`` patterns) comes to the driver, where
    expectation-maximisation estimates the voters' accuracies and, along a tree, their
    correlations; labels that may be learned from are held fixed, and a labelled text counts once.  Texts
    that are held out take part here without their labels, and never in training.  The posterior labels of a
    bounded sample of the other texts, labelled or not, train a sparse linear model of hashed words and stems.

    NULL and empty texts get no votes; rows that repeat count as often as they come; texts are read whole,
    however long; a NULL label teaches nothing.  Without a label, as in an empty table, there are no lexicons,
    and only the patterns vote.
    """
    sample = stage(_labelled(docs, labels, config, id_col, text_col, label_id, label_col), "labelled")
    words, stems = mine_lexicons(sample, config)
    shared = docs.sparkSession.sparkContext.broadcast((words, stems))

    def votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({
                "bits": np.array([vote(t, *shared.value, config) for t in frame["text"]], dtype=np.int64),
                **{c: frame[c] for c in frame.columns if c != "text"},
            })

    texts = docs.select(
        F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held"),
        F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1 << 20)).alias("draw"),
    )
    counted = stage(
        texts.mapInPandas(votes, "bits long, held boolean, draw long")
        .groupBy("bits").agg(F.count("*").alias("n"), F.count(F.when(~F.col("held"), 1)).alias("usable")), "votes",
    ).toPandas()
    told = sample.select("text", "toxic").mapInPandas(votes, "bits long, toxic int").groupBy("bits", "toxic").agg(F.count("*").alias("n")).toPandas()
    known_n = counted["bits"].map(told.groupby("bits")["n"].sum()).fillna(0).astype("int64")
    counted["n"] = np.maximum(counted["n"] - known_n, 0)
    bits = np.concatenate([counted["bits"], told["bits"]]).astype(np.int64)
    known = np.concatenate([np.full(len(counted), -1), told["toxic"]]).astype(np.int64)
    number = np.concatenate([counted["n"], told["n"]]).astype(float)
    pattern = unpack(bits, config.voters)
    label_model = fit_label_model(pattern, number, known, np.where(bits > 0, 0.8, 0.02), correlated=True)
    posterior = dict(zip(bits.tolist(), label_model.posterior(pattern).tolist()))

    usable = counted.assign(q=[posterior[b] for b in counted["bits"]])
    toxic_n = max(1.0, float(usable.loc[usable["q"] >= 0.5, "usable"].sum()))
    clean_n = max(1.0, float(usable.loc[usable["q"] < 0.5, "usable"].sum()))
    rates = tuple(min(1.0, config.training / n) for n in (clean_n, toxic_n))
    judged = docs.sparkSession.sparkContext.broadcast(posterior)

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            q = np.array([judged.value.get(vote(t, *shared.value, config), 0.0) for t in frame["text"]], dtype=float)
            rate = np.where(q >= 0.5, rates[1], rates[0])
            take = frame["draw"].to_numpy() < np.ceil(rate * (1 << 20))
            part = [np.fromiter(features(term_set(t), config.buckets), np.int32) for t in frame["text"][take]]
            yield pd.DataFrame({"q": q[take], "weight": 1.0 / rate[take], "ids": part})

    drawn = texts.where(~F.col("held") & (F.col("draw") < int(np.ceil(max(rates) * (1 << 20))))).select("text", "draw")
    train = drawn.mapInPandas(chosen, "q double, weight double, ids array<int>").toArrow()
    lists = train.column("ids").combine_chunks()
    owner = np.repeat(np.arange(train.num_rows), np.asarray(lists.value_lengths()))
    weights, intercept = fit_linear(
        np.asarray(lists.flatten()), owner, np.asarray(train.column("q")), np.asarray(train.column("weight")), config.buckets,
    )
    active = np.flatnonzero(weights)
    return ToxicityModel(words, stems, label_model, dict(zip(active.tolist(), weights[active].tolist())), intercept, config)


class Scorer:
    """Scores texts; remembers which features of a word have a weight."""

    def __init__(self, model: ToxicityModel, memory: int = 300_000):
        self.model, self.memory, self.known = model, memory, {}

    def score(self, text: str | None) -> float:
        if len(self.known) > self.memory:
            self.known = {}
        weights, known, found = self.model.weights, self.known, set()
        for word in term_set(text):
            active = known.get(word)
            if active is None:
                active = known[word] = tuple(features({word}, self.model.config.buckets) & weights.keys())
            if active:
                found.update(active)
        z = self.model.intercept + sum(weights[k] for k in sorted(found))
        return float(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))


def score(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
) -> DataFrame:
    """``(id, score, predicted)`` for every row and its whole text.

    NULL and empty texts get the score of a text without features; rows that repeat get the same; texts are
    read whole, however long; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for frame in frames:
            found = np.array([scorer.score(t) for t in frame["text"]], dtype=float)
            yield pd.DataFrame({"id": frame["id"], "score": found, "predicted": (found >= threshold).astype("int32")})

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(scored, f"id {kind}, score double, predicted int")
