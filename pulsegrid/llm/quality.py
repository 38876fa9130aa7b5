"""Text quality by weak supervision: heuristic labellers, EM, and a hashed linear scorer."""

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

from pulsegrid.llm.weak import LabelModel, fit_label_model, fit_linear, unpack
from pulsegrid.session import stage

SYMBOL_END = re.compile(r"[^\w\s.,;:!?'\"()\[\]{}<>-]{2,}(?=[\s.,;:!?]|$)")
LABELLERS = (
    "symbol_words", "symbol_bytes", "capitals", "exclaimed", "repeated_neighbours", "few_distinct", "top_word",
    "bars", "bar_lines", "digits", "no_words", "repeated_lines",
)


@dataclass(frozen=True)
class QualityConfig:
    """``training`` texts of either class, at most about, train the scorer: the bound of its sample."""

    training: int = 6000
    buckets: int = 1 << 16


@dataclass(frozen=True)
class QualityModel:
    label_model: LabelModel
    accuracies: np.ndarray  # (labellers, 2): P(vote low | high quality), P(vote low | low quality)
    weights: np.ndarray
    intercept: float
    config: QualityConfig


def measures(text: str | None) -> dict[str, float]:
    """Shares and counts of a whole text that the labellers and features are made from."""
    text = text or ""
    words = text.split()
    n = len(words)
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    digits = int(counts[48:58].sum())
    spaces = int(counts[[32, 9, 10, 11, 12, 13]].sum())
    usual = int(counts[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    ascii_other = int(counts[33:127].sum()) - upper - lower - digits - usual
    size = max(1, len(data) - spaces)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    distinct = Counter(words)
    top = distinct.most_common(1)[0][1] if n else 0
    bars = distinct.get("|", 0)
    return {
        "words": n,
        "symbol_words": len(SYMBOL_END.findall(text)) / max(1, n) if ascii_other else 0.0,
        "symbol_bytes": ascii_other / size,
        "capitals": upper / max(1, upper + lower),
        "exclaimed": int(counts[33]) / max(1, n),
        "neighbours": sum(map(str.__eq__, words, words[1:])) / max(1, n),
        "distinct": len(distinct) / n ** 0.75 if n else 1.0,
        "top": top / max(1, n),
        "bars": bars / max(1, n),
        "bar_lines": sum(" | " in x for x in lines) / max(1, len(lines)),
        "digits": digits / size,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
    }


def vote(m: dict[str, float]) -> int:
    """A bit for each labeller that says the text is of low quality, in the order of ``LABELLERS``."""
    long = m["words"] >= 20
    votes = (
        m["symbol_words"] > 0.1, m["symbol_bytes"] > 0.08, m["capitals"] > 0.5, m["exclaimed"] > 0.3,
        m["neighbours"] > 0.1, long and m["distinct"] < 0.8, long and m["top"] > 0.2,
        m["bars"] > 0.1, m["bar_lines"] > 0.3, m["digits"] > 0.3, m["words"] < 3, m["lines"] > 0.3,
    )
    return sum(bool(v) << k for k, v in enumerate(votes))


def features(m: dict[str, float], text: str | None, buckets: int) -> list[int]:
    """Hashed steps of every measure, and hashed endings of words that are not letters."""
    found = set()
    for name, value in m.items():
        step = int(np.log2(value + 1) * 2) if name == "words" else int(min(value, 3.0) * 20)
        found.add(crc32(f"{name}={step}".encode()) % buckets)
        if name != "words":
            found.update(crc32(f"{name}>{k}".encode()) % buckets for k in range(1, min(step, 20) + 1))
    found.update(crc32(b"end=" + x.encode("utf-8", "replace")) % buckets for x in set(SYMBOL_END.findall(text or "")))
    return sorted(found)


def fit_and_score(
    docs: DataFrame, config: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text",
) -> tuple[QualityModel, DataFrame]:
    """The fitted model, and ``(id, score, votes, predicted)`` for every row; score 1 is high quality.

    Overlapping heuristic labellers vote on every whole text; no true label is used.  The texts are
    read once: votes and hashed features are written as a narrow table.  A row per pattern of votes
    comes to the driver (at most ``2^labellers``), where expectation-maximisation estimates how
    often each labeller is right on texts of either quality.  The posterior labels of a bounded
    sample, drawn by hash from either class, train a sparse linear scorer of hashed features.

    NULL and empty texts have no words, so a labeller votes against them and they get a low score;
    rows that repeat get the same score; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bits, ids = [], []
            for text in frame["text"]:
                m = measures(text)
                bits.append(vote(m))
                ids.append(np.array(features(m, text, config.buckets), dtype=np.int32))
            yield pd.DataFrame({"id": frame["id"], "draw": frame["draw"], "votes": np.array(bits, dtype=np.int64), "ids": ids})

    texts = docs.select(
        F.col(id_col).alias("id"), F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 20)).alias("draw"), F.col(text_col).alias("text"),
    )
    told = stage(texts.mapInPandas(read, f"id {kind}, draw long, votes long, ids array<int>"), "votes")
    counted = told.groupBy("votes").agg(F.count("*").alias("n")).toPandas()
    bits = counted["votes"].to_numpy(dtype=np.int64)
    pattern, n = unpack(bits, len(LABELLERS)), counted["n"].to_numpy(dtype=float)
    label_model = fit_label_model(pattern, n, np.full(len(bits), -1), np.where(bits > 0, 0.9, 0.02), correlated=False)
    low = dict(zip(bits.tolist(), label_model.posterior(pattern).tolist()))

    sizes = [max(1.0, float(n[[(low[b] >= 0.5) == side for b in bits.tolist()]].sum())) if len(bits) else 1.0 for side in (False, True)]
    rates = [min(1.0, config.training / s) for s in sizes]
    is_low = F.col("votes").isin([b for b, q in low.items() if q >= 0.5])
    bar = F.when(is_low, round(rates[1] * (1 << 20))).otherwise(round(rates[0] * (1 << 20)))
    train = told.where(F.col("draw") < bar).select("votes", "ids").toArrow()
    lists = train.column("ids").combine_chunks()
    q = np.array([low[v] for v in np.asarray(train.column("votes")).tolist()], dtype=float)
    owner = np.repeat(np.arange(train.num_rows), np.asarray(lists.value_lengths()))
    weights, intercept = fit_linear(
        np.asarray(lists.flatten()), owner, 1 - q, 1 / np.where(q >= 0.5, rates[1], rates[0]), config.buckets,
    )
    model = QualityModel(label_model, label_model.accuracies(pattern, n), weights, intercept, config)
    shared = docs.sparkSession.sparkContext.broadcast((weights, intercept))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = shared.value
        for frame in frames:
            z = np.array([b + w[np.asarray(ids)].sum() for ids in frame["ids"]], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pd.DataFrame({
                "id": frame["id"], "votes": frame["votes"], "score": score, "predicted": (score >= 0.5).astype("int32"),
            })

    return model, told.select("id", "votes", "ids").mapInPandas(scored, f"id {kind}, votes long, score double, predicted int")
