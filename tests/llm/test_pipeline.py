import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import mixing, simhash
from pulsegrid.session import stage
from tests_llm_helpers import connected_brute, fingerprint_brute

SMALL = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    tables = [docs]
    for name, step in corpus_pipeline.STAGES:
        tables.append(stage(step(spark, tables[-1], SMALL), name))
    start, language, lines, near, mixed, packed = tables
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    assert all(t.columns == start.columns for t in tables[:-1])
    assert language.count() >= 0.99 * start.count() and language.exceptAll(start).isEmpty()
    assert lines.count() == language.count()
    assert lines.where(F.col("n_chars") != F.length("text")).isEmpty()
    prints = {r["doc_id"]: fingerprint_brute(r["text"]) for r in lines.collect()}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(connected_brute(prints).values()))
    plan = {r["id"]: len(r["copies"]) for r in mixing.mix(near).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {k: n for k, n in plan.items() if n}
    words = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    given = {}
    for r in mixed.collect():
        given[r["doc_id"]] = given.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == given
    assert packed.groupBy("bin").agg(F.sum("words").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_planted_copies_go_and_clean_documents_stay(spark, docs):
    import numpy as np

    rng = np.random.default_rng(11)
    clean = [(k, " ".join(f"w{rng.integers(900)}" for _ in range(120))) for k in range(40)]
    near = [(100 + k, t + " ") for k, t in clean[:10]]
    kept = simhash.keep_representatives(docs(clean + near))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def test_a_corpus_without_labels_stays_whole(spark, odd_docs, no_docs):
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    with pytest.warns(UserWarning, match="no language was learned"):
        kept = corpus_pipeline.language(spark, unlabelled, SMALL)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() == unlabelled.count()
    with pytest.warns(UserWarning):
        assert corpus_pipeline.language(spark, no_docs, SMALL).count() == 0


def test_every_stage_takes_odd_rows(spark, odd_docs):
    """NULLs, empty and very long texts, repeated rows and clashing columns: each stage by itself."""
    total = odd_docs.count()
    lines = corpus_pipeline.lines(spark, odd_docs, SMALL)
    assert lines.columns == corpus_pipeline.COLUMNS and lines.count() == total
    near = corpus_pipeline.near_duplicates(spark, odd_docs, SMALL)
    assert near.columns == corpus_pipeline.COLUMNS and 0 < near.count() < total
    mixed = corpus_pipeline.mixture(spark, odd_docs, SMALL)
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.where("n_chars IS NOT NULL AND n_chars <> length(text)").isEmpty()
    words = F.size(F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    given = odd_docs.where("text IS NOT NULL").agg(F.sum(words)).first()[0]
    assert corpus_pipeline.packed(spark, odd_docs, SMALL).agg(F.sum("words")).first()[0] == given


def test_every_stage_takes_an_empty_table(spark, no_docs):
    for _, step in corpus_pipeline.STAGES[1:]:
        assert step(spark, no_docs, SMALL).count() == 0
