"""The operators over the driver's tables: ``QUERIES`` and, where SQL can express them, ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import (
    audit, embeddings, exact, langid, linededup, mixing, packing, quality, search, secrets, simhash, tokens, toxicity,
)
from pulsegrid.llm.common import held_out, table

Query = Callable[..., DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op2_exact_dedup(spark, folder):
    found = exact.exact_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query
def op4_best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id").drop("row")


@query
def op5_line_dedup(spark, folder):
    return linededup.remove_repeated_lines(table(spark, folder, "documents")).select("doc_id", "text", "removed")


@query
def op9_simhash_near_dedup(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id",
    )


@query
def op10_source_mixing(spark, folder):
    found = mixing.mix(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.round(F.get("copies", F.lit(0))["time"], 6).alias("first_time"),
    )


@query
def op7_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", "predicted",
    )


@query
def op8_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.fit(docs)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score",
    )


@query
def op1_secret_scan(spark, folder):
    found = secrets.scan(table(spark, folder, "documents"), secrets.Ledger(spark))

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        F.col("id").alias("doc_id"), number("assign"), number("access"), number("hex"),
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"), F.col("blob").alias("blob"),
    )


@query
def op6_quality_classifier(spark, folder):
    _, scores = quality.fit_and_score(table(spark, folder, "documents"))
    return scores.select(F.col("id").alias("doc_id"), "votes", "score", "predicted")


@query
def op3_embedding_near_dedup(spark, folder):
    return embeddings.near_duplicates(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op11_token_output(spark, folder):
    import public_tokenizers

    files = tokens.write_shards(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_documents(files).withColumnRenamed("id", "doc_id")


@query
def op12_filter_audit(spark, folder):
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op13_lexical_search(spark, folder):
    found = search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")
