"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage takes whole texts, however long, and tables with columns beside those of ``documents``, which it
drops.  Repeated rows are rows like others, unless a stage says otherwise; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import langid, linededup, mixing, packing, simhash
from pulsegrid.llm.common import table
from pulsegrid.session import discard, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SHARE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it now is."""
    length = F.length("text").cast(df.schema["n_chars"].dataType)
    return df.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are mostly in one learned language; the others go.

    NULL and empty texts, and others without a letter, are in no language and go.  Where nothing can be
    learned, because no row that may be learned from has a language, all rows stay.  No text is shuffled.
    """
    model = langid.fit(docs)
    return langid.keep(docs, model, LEAST_SHARE).select(*COLUMNS)


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that occur earlier; a copy keeps its row and no text.

    NULL texts stay NULL; of equal runs the one of the smallest id stays.
    """
    return _documents(linededup.remove_repeated_lines(docs))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose id is the component's.

    NULL and empty texts share one fingerprint, so one of them stays; of rows that repeat an id, too.
    """
    return simhash.keep_representatives(docs).select(*COLUMNS)


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order; a document comes once for each time that it is taken.

    NULL and empty texts hold no words; a NULL source is a source of its own.
    """
    return _documents(mixing.mixed_documents(docs))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the words of each copy go: bins of one training sequence each.

    A text without a word has one row, without a bin.
    """
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
    ("source_mixing", mixture), ("best_fit_packing", packed),
]

#: Language models, components of fingerprints and best-fit search are beyond SQL; tests/llm compares
#: the stages with brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``.

    A stage's input is deleted when its output has been written, so two copies of the texts exist at most.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        written = stage(step(spark, docs, sf_dir), f"corpus-{name}")
        if before is not None:
            discard(before)
        docs = before = written
    return STAGES[-1][1](spark, docs, sf_dir)
