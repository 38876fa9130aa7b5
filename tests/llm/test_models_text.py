import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import langid, quality, toxicity, weak
from pulsegrid.llm.common import held_out, table

SMALL = "/root/testdata/sf0.01"


def test_held_out_rows_follow_crc32(spark):
    found = spark.range(0, 500).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in found)
    assert spark.sql("SELECT CAST(NULL AS long) AS id").select(held_out(F.col("id"))).first()[0] is False


# Languages -----------------------------------------------------------------------------------


def viterbi_brute(emission, penalty):
    """Plain recursion over one text."""
    state, back = np.zeros(emission.shape[1]), []
    for e in emission:
        options = state[None, :] - penalty * (1 - np.eye(len(state)))
        best = np.where(np.diag(options) >= options.max(axis=1), np.arange(len(state)), options.argmax(axis=1))
        back.append(best)
        state = options[np.arange(len(state)), best] + e
    path = [int(state.argmax())]
    for best in reversed(back[1:]):
        path.append(int(best[path[-1]]))
    return path[::-1]


def test_viterbi_steps_texts_together_like_one_by_one():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(50, 3)) * 3
    lengths = np.array([5, 0, 40, 1, 17, 40, 0])
    ids = rng.integers(0, 50, lengths.sum())
    labels = np.split(langid.viterbi(ids, lengths, scores, 2.5), np.cumsum(lengths)[:-1])
    for mine, part in zip(labels, np.split(ids, np.cumsum(lengths)[:-1])):
        if len(part):
            assert mine.tolist() == viterbi_brute(scores[part], 2.5)


def grams_brute(word, order):
    data = b" " + word.encode() + b" "
    return [data[i:i + n] for n in range(1, order + 1) for i in range(len(data) - n + 1) if not (n == 1 and data[i:i + 1] == b" ")]


def test_word_grams_are_those_of_each_word():
    words = ["a", "über", "straße", "xyxyx"]
    bucket, owner = langid.word_grams(words, 4, 1 << 20)
    for k, word in enumerate(words):
        alone = langid.word_grams([word], 4, 1 << 20)[0]
        assert sorted(bucket[owner == k]) == sorted(alone) and len(alone) == len(grams_brute(word, 4))
        assert len(set(alone)) == len(set(grams_brute(word, 4)))


def test_languages_of_mixed_scripts_and_odd_rows(spark, docs, odd_docs, no_docs):
    parts = {"en": "the and of with house river stone", "de": "der die und mit haus fluss stein", "ru": "дом река камень и но"}
    rows = [(k, " ".join(np.random.default_rng(k).choice(t.split(), 30)), lang) for lang, t in parts.items() for k in range(ord(lang[0]), ord(lang[0]) + 40)]
    model = langid.fit(docs(rows))
    assert model.languages == ["de", "en", "ru"]
    assert model.candidates[list(langid.SCRIPTS).index("cyrillic")].tolist() == [False, False, True]
    text = "The river and stone of the house, " * 3 + "der Fluss und die Steine mit Haus und Fluss. " + "Река и дом"
    spans = [(r["lang"], text[r["start"]:r["end"]]) for r in langid.spans(docs([(1, text), (2, None)]), model).collect()]
    assert [x for x, _ in spans] == ["en", "de", "ru"] and spans[2][1] == "Река и дом"
    found = {}
    for r in langid.identify(odd_docs, model).collect():
        found.setdefault(r["id"], []).append((r["lang_pred"], r["score"]))
    assert sum(map(len, found.values())) == 11 and found[2] == found[3] == found[4] == found[7] == [("und", 0.0)]
    assert ("und", 0.0) in found[None] and found[6][0] == found[6][1] and found[5][0][0] == "en"
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.fit(no_docs)
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    kept = langid.keep(odd_docs, model, 0.5)
    assert kept.columns == odd_docs.columns and kept.where("text IS NULL OR doc_id = 4").count() == 0


def test_held_out_languages(spark):
    docs = table(spark, SMALL, "documents")
    found = langid.identify(docs, langid.fit(docs)).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").where(held_out(F.col("id")))
    right, rows = found.agg(F.count(F.when(F.col("lang") == F.col("lang_pred"), 1)), F.count("*")).first()
    assert rows > 200 and right / rows >= 0.98


# Label model ---------------------------------------------------------------------------------


def test_label_model_recovers_accuracies_and_correlations():
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.3
    accuracy = [(0.05, 0.8), (0.1, 0.7), (0.02, 0.6), (0.2, 0.9)]
    votes = np.stack([rng.random(len(y)) < np.where(y, b, a) for a, b in accuracy], axis=1).astype(int)
    echo = np.where(rng.random(len(y)) < 0.9, votes[:, 2], rng.random(len(y)) < 0.1).astype(int)  # follows voter 2
    votes = np.column_stack([votes, echo])
    pattern, n = np.unique(votes, axis=0, return_counts=True)
    model = weak.fit_label_model(pattern, n.astype(float), np.full(len(pattern), -1), np.where(pattern.sum(axis=1) >= 2, 0.8, 0.1), True)
    assert abs(model.prior - 0.3) < 0.05
    assert np.abs(model.accuracies(pattern, n)[:4] - accuracy).max() < 0.06
    assert max(model.correlation, key=model.correlation.get) in {(2, 4), (4, 2)}
    assert weak.unpack(np.array([0, 5, 7]), 3).tolist() == [[0, 0, 0], [1, 0, 1], [1, 1, 1]]


def test_sparse_model_keeps_the_telling_features():
    rng = np.random.default_rng(7)
    target = (rng.random(400) < 0.4).astype(float)
    rows = [[1 if t else 2, *rng.integers(10, 200, 20)] for t in target]
    ids, owner = np.concatenate(rows), np.repeat(np.arange(400), 21)
    weights, _ = weak.fit_linear(ids, owner, target, np.ones(400), 256, l1=1e-2)
    assert weights[1] > 1 > -1 > weights[2] and np.count_nonzero(weights) < 30
    assert weak.fit_linear(ids[:0], owner[:0], target[:0], target[:0], 256)[0].sum() == 0


# Toxicity and quality ------------------------------------------------------------------------


def test_held_out_toxicity(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).join(labels, F.col("id") == F.col("doc_id")).where(held_out(F.col("id"))).toPandas()
    hit, wanted = found["predicted"] == 1, found["toxic"] == 1
    assert (hit & wanted).sum() / max(1, wanted.sum()) >= 0.5 and (hit & wanted).sum() / max(1, hit.sum()) >= 0.7


def test_a_labelled_text_counts_once_and_no_telling_term_is_left_out(spark, docs, monkeypatch):
    rows = [(k, f"calm words {k}" + (f" vile{k % 7 * 'x'}" if k % 3 == 0 else "")) for k in range(400)]
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 400, 2)], "doc_id long, toxic int")
    seen = {}

    def watch(votes, weight, known, start, **rest):
        seen.update(weight=weight, known=known)
        return weak.fit_label_model(votes, weight, known, start, **rest)

    monkeypatch.setattr(toxicity, "fit_label_model", watch)
    model = toxicity.fit(docs(rows), marks)
    told = sum(1 for k in range(0, 400, 2) if zlib.crc32(str(k).encode()) % 4 != 2)
    assert seen["weight"].sum() == 400 and seen["weight"][seen["known"] >= 0].sum() == told
    assert {f"vile{k * 'x'}" for k in range(7)} <= model.words.keys()


def test_toxicity_takes_odd_rows(spark, docs, odd_docs, no_docs):
    rows = [(k, f"quiet words {k % 17} about the weather" + (" vilewort nastyx" if k % 4 == 0 else "")) for k in range(300)]
    marks = spark.createDataFrame([(k, int(k % 4 == 0), "x") for k in range(300)] + [(None, 1, "x"), (5, None, "x"), (4, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs(rows + [(None, None), (301, "")]), marks)
    found = {r["id"]: r["predicted"] for r in toxicity.score(docs(rows), model).collect()}
    assert found == {k: int(k % 4 == 0) for k in range(300)}
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == 11 and all(0 <= r["score"] <= 1 for r in odd) and len({r["score"] for r in odd if r["id"] in (2, 3, 4)}) == 1
    assert toxicity.score(no_docs, model).count() == 0
    nothing = toxicity.fit(no_docs, marks.limit(0))
    assert toxicity.score(odd_docs, nothing).count() == 11


def test_quality_agrees_with_labels_it_never_saw(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model, scores = quality.fit_and_score(docs)
    found = scores.join(labels, F.col("id") == F.col("doc_id")).toPandas()
    assert (found["predicted"] == found["quality"]).mean() >= 0.97
    low = model.accuracies[:, 1] > model.accuracies[:, 0]
    assert low[: len(quality.LABELLERS) - 3].all()


def test_quality_takes_odd_rows(odd_docs, no_docs):
    found = quality.fit_and_score(odd_docs)[1].collect()
    assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found)
    assert quality.fit_and_score(no_docs)[1].count() == 0


@pytest.mark.parametrize("text, bit", [
    ("bad### word$$$ is&&& here***", 0), ("ALL LOUD TEXT HERE", 2), ("one one one one two", 4), ("a | b | c | d", 7), (None, 10), ("", 10),
])
def test_labellers(text, bit):
    assert quality.vote(quality.measures(text)) >> bit & 1
    assert quality.vote(quality.measures("A clean sentence of some usual words, with marks.")) == 0
