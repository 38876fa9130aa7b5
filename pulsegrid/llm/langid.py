"""Language identification: scripts narrow the candidates, Viterbi labels spans of mixed texts."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import held_out

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"

# First and last code points of the main blocks of scripts, from the Unicode charts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
}
OTHER = len(SCRIPTS)
_RANGES = sorted((a, b, k) for k, parts in enumerate(SCRIPTS.values()) for a, b in parts)
_FIRST = np.array([a for a, _, _ in _RANGES])
_LAST = np.array([b for _, b, _ in _RANGES])
_KIND = np.array([k for _, _, k in _RANGES])


@dataclass(frozen=True)
class LanguageConfig:
    """``sample`` labelled texts per language, about, fit the model: the bound of what it learns from.

    Words are scored by hashed byte n-grams up to ``order``; changing the language between two
    words costs ``penalty``.  A language is a candidate in a script that has ``script_share`` of
    its words.  ``block`` words are labelled at a time.
    """

    sample: int = 4000
    order: int = 5
    buckets: int = 1 << 16
    penalty: float = 8.0
    script_share: float = 0.01
    block: int = 1 << 19


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    score: np.ndarray  # (buckets, languages), log probabilities
    candidates: np.ndarray  # (scripts + 1, languages)
    config: LanguageConfig


def scripts(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    points = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=len(words))
    at = np.searchsorted(_FIRST, points, side="right") - 1
    inside = (at >= 0) & (points <= _LAST[np.maximum(at, 0)])
    return np.where(inside, _KIND[np.maximum(at, 0)], OTHER)


def word_grams(words: list[str], order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, word position)`` of all byte n-grams of words between blanks, n from 1 to ``order``."""
    data = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    blanks = np.flatnonzero(data == 32)
    owner = np.zeros(len(data), dtype=np.int64)
    owner[blanks[1:-1]] = 1
    owner = np.cumsum(owner)
    last = blanks[1:][owner]  # where each byte's word ends
    position = np.arange(len(data))
    found, owners = [], []
    code = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, order + 1):
        code = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1:] + np.uint64(1)
        whole = position[: len(code)] + n - 1 <= last[: len(code)]
        if n == 1:
            whole &= data != 32
        mixed = code[whole] * np.uint64(0x9E3779B97F4A7C15)
        found.append(((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[: len(code)][whole])
    return np.concatenate(found), np.concatenate(owners)


def word_scores(words: list[str], model: LanguageModel) -> np.ndarray:
    """``(words, languages)``: log likelihood of each word's n-grams, less that of its best language."""
    if not words:
        return np.zeros((0, len(model.languages)))
    grams, owner = word_grams(words, model.config.order, model.config.buckets)
    scores = np.stack([
        np.bincount(owner, weights=model.score[grams, k], minlength=len(words)) for k in range(len(model.languages))
    ], axis=1) / model.config.order
    scores[~model.candidates[scripts(words)]] -= 1e6
    return scores - scores.max(axis=1, keepdims=True)


def viterbi(ids: np.ndarray, lengths: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word of several texts, laid end to end, all stepped together."""
    labels = np.zeros(len(ids), dtype=np.int16)
    if not len(ids):
        return labels
    order = np.argsort(-lengths, kind="stable")
    offsets = (np.cumsum(lengths) - lengths)[order]
    counts = lengths[order]
    active = np.searchsorted(-counts, -np.arange(counts[0]), side="left")  # texts longer than t
    width = scores.shape[1]
    own = np.arange(width, dtype=np.int16)[None, :]
    back = np.empty((len(ids), width), dtype=np.int16)
    state = np.zeros((len(counts), width))
    for t in range(counts[0]):
        k = active[t]
        at, now = offsets[:k] + t, state[:k]
        best = now.argmax(axis=1)
        switched = (now[np.arange(k), best] - penalty)[:, None]
        stay = now >= switched
        back[at] = np.where(stay, own, best[:, None])
        state[:k] = np.where(stay, now, switched) + scores[ids[at]]
    current = state.argmax(axis=1)
    for t in range(counts[0] - 1, -1, -1):
        k = active[t]
        at = offsets[:k] + t
        labels[at] = current[:k]
        current[:k] = back[at, current[:k]]
    return labels


class Labeller:
    """Labels the words of texts; keeps the scores of words it has seen, up to a block of them."""

    def __init__(self, model: LanguageModel):
        self.model, self.known, self.scores = model, {}, np.zeros((0, len(model.languages)))

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language number of each word of each text."""
        if len(self.known) > self.model.config.block:
            self.known, self.scores = {}, self.scores[:0]
        known, fresh = self.known, []
        ids = []
        for words in texts:
            row = []
            for word in words:
                at = known.get(word)
                if at is None:
                    at = known[word] = len(known)
                    fresh.append(word)
                row.append(at)
            ids.append(np.array(row, dtype=np.int64))
        if fresh:
            self.scores = np.concatenate([self.scores, word_scores(fresh, self.model)])
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        labels = viterbi(np.concatenate(ids) if ids else np.zeros(0, np.int64), lengths, self.scores, self.model.config.penalty)
        return np.split(labels, np.cumsum(lengths)[:-1]) if ids else []


def _has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(map(str.isalpha, w)) for w in words)


def fit(
    docs: DataFrame, config: LanguageConfig = LanguageConfig(), id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Count n-grams of a bounded sample of labelled texts that may be learned from.

    About ``config.sample`` texts of every language are taken by a hash of their id.  The counts
    (a row per language and bucket at most) and the shares of scripts come to the driver.  Rows with a NULL
    text or language teach nothing; rows that repeat count as often as they come; sampled texts are read whole,
    however long.  Without a row to learn from, as in an empty table, the model has no language.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(id_col), F.lit(1 << 20)).alias("draw"), F.col(text_col).alias("text"),
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((config.buckets, 0)), np.ones((OTHER + 1, 0), dtype=bool), config)
    bar = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1 << 20, round(config.sample / counts[k] * (1 << 20))))))
    sample = labelled.where(F.col("draw") < bar[F.col("lang")]).select("lang", "text")
    first_script = config.buckets

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                words = WORD.findall(text.lower())
                if words:
                    total = totals.setdefault(lang, np.zeros(first_script + OTHER + 1, dtype=np.int64))
                    total[:first_script] += np.bincount(word_grams(words, config.order, config.buckets)[0], minlength=first_script)
                    total[first_script:] += np.bincount(scripts(words), minlength=OTHER + 1)
        for lang, total in totals.items():
            slot = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "slot": slot, "n": total[slot]})

    rows = sample.mapInPandas(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((first_script + OTHER + 1, len(languages)))
    table[rows["slot"], [languages.index(x) for x in rows["lang"]]] = rows["n"]
    grams, seen = table[:first_script] + 0.5, table[first_script:]
    candidates = seen >= config.script_share * np.maximum(seen.sum(axis=0), 1)
    candidates[~candidates.any(axis=1)] = True
    return LanguageModel(languages, np.log(grams / grams.sum(axis=0)), candidates, config)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row: the language of most words, and its share of the words.

    Whole texts are labelled.  A NULL text and one without a letter are ``und`` with score 0, as is
    every text if no language was learned.  Ties go to the language first in order.  Rows that repeat get the
    same; very long texts are labelled in one piece; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for frame in frames:
            found: list[tuple[str, float]] = []
            for block in blocks(frame["text"], shared.value.config.block):
                found += summaries(labeller, block)
            yield pd.DataFrame({
                "id": frame["id"], "lang_pred": np.array([x for x, _ in found], dtype=object), "score": np.array([y for _, y in found], dtype=float),
            })

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(predict, f"id {kind}, lang_pred string, score double")


def keep(
    docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with a share of ``least`` of its words.

    Rows pass through the labelling with all their columns, so nothing is shuffled or joined.  Texts
    without a letter are rejected, NULL and empty ones too.  A model without a language can judge nothing, so
    it warns and all rows stay.
    """
    if not model.languages:
        warnings.warn("no language was learned: all documents stay", stacklevel=2)
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def chosen(batches):
        labeller = Labeller(shared.value)
        for batch in batches:
            found: list[tuple[str, float]] = []
            for block in blocks((x.as_py() for x in batch.column(at)), shared.value.config.block):
                found += summaries(labeller, block)
            yield batch.filter(pa.array([lang != UNKNOWN and share >= least for lang, share in found], type=pa.bool_()))

    return docs.mapInArrow(chosen, docs.schema)


def blocks(texts, size: int) -> Iterator[list[list[str]]]:
    """The words of texts in groups of about ``size`` words."""
    block, n = [], 0
    for text in texts:
        words = WORD.findall(text.lower()) if text else []
        block.append(words)
        n += len(words)
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def summaries(labeller: Labeller, block: list[list[str]]) -> list[tuple[str, float]]:
    languages = labeller.model.languages
    if not languages:
        return [(UNKNOWN, 0.0)] * len(block)
    found = []
    for words, labels in zip(block, labeller.label(block)):
        if not words or not _has_letter(words):
            found.append((UNKNOWN, 0.0))
            continue
        counts = np.bincount(labels, minlength=len(languages))
        best = int(counts.argmax())
        found.append((languages[best], counts[best] / len(words)))
    return found


def spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, end, lang)``: the runs of words in one language, in code points, end exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        languages = shared.value.languages
        for frame in frames:
            out: list[tuple] = []
            for key, text in zip(frame["id"], frame["text"]):
                places = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
                if not places or not languages:
                    continue
                labels = labeller.label([[text[a:b].lower() for a, b in places]])[0]
                edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
                out += [(key, places[a][0], places[b - 1][1], languages[labels[a]]) for a, b in zip(edges, edges[1:])]
            yield pd.DataFrame(out, columns=["id", "start", "end", "lang"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(cut, f"id {kind}, start long, end long, lang string")
