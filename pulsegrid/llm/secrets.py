"""Secret scans over an incremental ledger of blobs: every content is scanned once per rule version."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import BROADCAST_BYTES
from pulsegrid.session import scratch_folder, stage


FEW_NEW = 0.1  # share of rows with unseen blobs up to which their list is sent to the texts


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlaps; a match counts if its group ``kept`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    kept: int
    least: int


ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: In the order in which kinds are listed.  Long runs are matched as such: a shorter run is no match
#: of its own and hides none, so leaving it out changes nothing.  Assignments that are too short are
#: matched and dropped afterwards, because they do hide what they cover.
RULES = (
    Rule("assign", 1, ASSIGN, 1, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 1),
)


def blob_id(text: Column) -> Column:
    """The address of a content: SHA-256 of its UTF-8 bytes; NULL counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(blobs: DataFrame, rule: Rule) -> DataFrame:
    """``(blob, kind, version, start, end)`` of one rule, in code points, end exclusive.

    Each piece is the gap since the last match and the match; ``\\G`` ties it to the end of the
    piece before, so a text is read once.  Running sums of the lengths are the positions.
    """
    piece = rf"\G([\s\S]*?)({rule.pattern})"
    group = 2 if rule.kept == 0 else 2 + rule.kept
    whole, match, kept = (F.regexp_extract_all("text", F.lit(piece), F.lit(g)) for g in (0, 2, group))
    pieces = F.transform(whole, lambda w, i: F.struct(
        F.length(w).alias("whole"), F.length(F.get(match, i)).alias("match"), F.length(F.get(kept, i)).alias("kept"),
    ))
    hit = blobs.where(F.col("text").rlike(rule.pattern)).select("blob", F.posexplode(pieces).alias("at", "piece"))
    end = F.sum("piece.whole").over(W.partitionBy("blob").orderBy("at"))
    return (
        hit.withColumn("end", end.cast("long")).where(F.col("piece.kept") >= rule.least)
        .select("blob", F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"),
                (F.col("end") - F.col("piece.match")).alias("start"), "end")
    )


class Ledger:
    """What has been scanned, and what was found, as two tables that only grow.

    ``scanned (blob, kind, version)`` has a row for every pair of blob and rule version that is done,
    ``findings`` the matches.  A scan appends findings first and its pairs last, so a scan that
    breaks off is done again; its findings are then there twice, and are read once.
    """

    SCHEMAS = {
        "scanned": "blob string, kind string, version int",
        "findings": "blob string, kind string, version int, start long, end long",
    }

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{scratch_folder(spark)}/blob-ledger-{uuid.uuid4().hex}"

        for name, schema in self.SCHEMAS.items():
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.folder}/{name}").distinct()

    def scanned(self) -> DataFrame:
        return self._read("scanned")

    def findings(self) -> DataFrame:
        return self._read("findings")

    def append(self, findings: DataFrame, pairs: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        pairs.write.mode("append").parquet(f"{self.folder}/scanned")


def unseen(blobs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, carrier, kinds)``: blobs with rule versions that the ledger lacks."""
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    done = ledger.scanned().groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    open_ = F.array_except(wanted, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>")))
    return blobs.join(done, "blob", "left").select("blob", "carrier", open_.alias("open")).where(F.size("open") > 0)


def scan(
    versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id, blob, spans)`` for every row of ``versions``, ``spans`` being sorted ``(start, order, kind, end)``.

    Every content is addressed by its SHA-256, so copies and unchanged later versions are one blob.
    Pairs of blob and rule version that the ledger lacks are scanned in one carrier row of each
    blob; the findings are added to the ledger and joined back to all rows that hold the blob.
    A new version of a rule scans all blobs again, for that rule only.

    NULL counts as empty and has no spans; rows that repeat get the same spans; NULL ids keep their
    row; an empty table gives no rows.  In an increment, where few blobs are unseen, their list
    (below a counted size) is broadcast and no text moves; otherwise texts are shuffled to it, once.
    """
    addressed = stage(versions.select(
        F.col(id_col).alias("id"), blob_id(F.col(text_col)).alias("blob"),
        F.xxhash64(F.col(id_col)).alias("carrier"),
    ), "addressed")
    blobs = addressed.groupBy("blob").agg(F.min("carrier").alias("carrier"))
    todo = stage(unseen(blobs, ledger, rules), "unseen")
    new, all_ = todo.count(), addressed.count()
    if new * 400 <= BROADCAST_BYTES and new <= FEW_NEW * all_:
        todo = F.broadcast(todo)
    texts = versions.select(
        F.xxhash64(F.col(id_col)).alias("carrier"), blob_id(F.col(text_col)).alias("blob"), F.coalesce(text_col, F.lit("")).alias("text"),
    ).join(todo, ["blob", "carrier"])
    any_rule = F.col("text").rlike("|".join(r.pattern for r in rules))
    hit = stage(  # the condition names both sides, so that only unseen blobs meet it
        texts.where(F.when(F.size("open") > 0, any_rule).otherwise(False)).select("blob", "text", "open").dropDuplicates(["blob"]), "hit",
    )
    found = None
    for rule in rules:
        due = hit.where(F.array_contains("open", F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))))
        part = _matches(due, rule)
        found = part if found is None else found.unionByName(part)
    ledger.append(found, todo.select("blob", F.explode("open").alias("o")).select("blob", "o.kind", "o.version"))
    order = F.lit(len(rules))
    for k, rule in enumerate(rules):
        order = F.when((F.col("kind") == rule.kind) & (F.col("version") == rule.version), k).otherwise(order)
    current = ledger.findings().withColumn("order", order).where(F.col("order") < len(rules))
    per_blob = stage(current.groupBy("blob").agg(F.array_sort(F.collect_list(
        F.struct("start", F.col("order").cast("int").alias("order"), "kind", "end"),
    )).alias("spans")), "spans")
    size = per_blob.agg((F.count("*") * 96 + F.coalesce(F.sum(F.size("spans")), F.lit(0)) * 48).alias("bytes")).first()["bytes"]
    side = F.broadcast(per_blob) if size <= BROADCAST_BYTES else per_blob
    empty = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    return addressed.join(side, "blob", "left").select("id", "blob", F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
