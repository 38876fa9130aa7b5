"""Repeated runs of lines, found by winnowing and removed everywhere but at their first place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import BLANK, BROADCAST_BYTES, unused
from pulsegrid.session import stage

EDGE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineConfig:
    """A repeated run counts if it has ``window`` lines, or a line of ``long_words`` words."""

    window: int = 3
    long_words: int = 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _body(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def line_table(docs: DataFrame, config: LineConfig, id_col: str, text_col: str) -> DataFrame:
    """``(id, body, lines)``: the lines that are not blank as ``(pos, h, c, long)``, in order.

    A line is known by 96 bits of two hashes of its text without blanks at its ends.
    """
    numbered = F.transform(
        _lines(F.col(text_col)), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(EDGE)).alias("x")),
    )
    lines = F.transform(
        F.filter(numbered, lambda e: e["x"] != ""),
        lambda e: F.struct(
            e["pos"].alias("pos"), F.xxhash64(e["x"]).alias("h"), F.crc32(e["x"].cast("binary")).alias("c"),
            (F.size(F.split(e["x"], BLANK)) >= config.long_words).alias("long"),
        ),
    )
    return docs.select(F.col(id_col).alias("id"), _body(text_col).alias("body"), lines.alias("lines"))


def _starts(size: int) -> Column:
    """First positions of all windows of ``size`` lines."""
    last = F.size("lines") - size
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def fingerprints(lines: DataFrame, config: LineConfig) -> DataFrame:
    """``(fp)``, a row for each selected place: window minima (the last of equal ones) and long lines.

    Any run of ``window`` lines contains a selected place, and equal runs select equal places.
    """
    minima = F.transform(
        _starts(config.window),
        lambda s: F.array_min(F.transform(
            F.slice("lines", s + 1, config.window), lambda e: F.struct(e["h"].alias("h"), (-e["pos"]).alias("p")),
        )),
    )
    long = F.transform(
        F.filter("lines", lambda e: e["long"]), lambda e: F.struct(e["h"].alias("h"), (-e["pos"]).alias("p")),
    )
    return lines.select(F.explode(F.array_union(minima, long)).alias("place")).select(F.col("place.h").alias("fp"))


def _grams(size: int, config: LineConfig) -> Column:
    """The runs of ``size`` lines that count, each under its fingerprint."""

    def gram(s: Column) -> Column:
        run = F.slice("lines", s + 1, size)
        chosen = run if size == config.window else F.filter(run, lambda e: e["long"])
        return F.struct(
            F.array_min(F.transform(chosen, lambda e: e["h"])).alias("fp"),
            F.transform(run, lambda e: e["pos"]).alias("at"),
            F.xxhash64(F.transform(run, lambda e: e["h"])).alias("g"),
            F.xxhash64(F.transform(run, lambda e: e["c"])).alias("k"),
        )

    return F.filter(F.transform(_starts(size), gram), lambda e: e["fp"].isNotNull())


def repeated_lines(lines: DataFrame, config: LineConfig) -> DataFrame:
    """``(id, body, gone)``: positions of the lines to delete, for documents that have any."""
    repeated = stage(
        fingerprints(lines, config).groupBy("fp").count().where("count > 1").select("fp"), "repeated",
    )
    if repeated.count() * 16 <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)
    runs = F.concat(*[_grams(n, config) for n in range(1, config.window + 1)])
    found = (
        lines.select("id", "body", F.explode(runs).alias("run")).select("id", "body", "run.*")
        .join(repeated, "fp", "left_semi")
        .select(F.size("at").alias("n"), "g", "k", F.struct(
            F.col("id").isNull().alias("missing"), "id", "body", F.col("at")[0].alias("start"),
        ).alias("place"), "at")
    )
    found = stage(found, "runs")
    first = (
        found.groupBy("n", "g", "k").agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where("first < last").drop("last")
    )
    later = found.join(first, ["n", "g", "k"]).where("place > first")
    return (
        later.select("place.id", "place.body", F.explode("at").alias("pos")).distinct()
        .groupBy("id", "body").agg(F.collect_list("pos").alias("gone"))
    )


def remove_repeated_lines(
    docs: DataFrame, config: LineConfig = LineConfig(), id_col: str = "doc_id", text_col: str = "text",
    removed_col: str = "removed",
) -> DataFrame:
    """``docs`` with repeated runs of lines cut out of the text, and their number in ``removed_col``.

    A column of that name is replaced; all others are passed through.

    Lines are compared without blanks at their ends; blank lines do not count and stay.  A run of
    consecutive lines goes where it is not its first occurrence, by id and position, if it has
    ``config.window`` lines or a line of ``config.long_words`` words.  Winnowing selects places
    whose fingerprints any such run must share; a first pass counts fingerprints, and only around
    those that repeat are the lines on both sides compared: all runs through a matched place, up to
    ``window`` lines, are joined to their first occurrence.  Their union is the maximal extension
    of every match.  Deleted lines of overlapping runs still exist at an earlier place.

    NULL text stays NULL and empty text empty; a document may lose all its text but keeps its row.
    Rows that repeat an id and a text are one document and keep the same text; NULL ids come last.
    A frequent line is one partial sum and a join side that Spark can split; the positions to
    delete are broadcast only below a size that is counted first.
    """
    lines = stage(line_table(docs, config, id_col, text_col), "lines")
    gone = stage(repeated_lines(lines, config), "gone")
    size = gone.agg((F.count("*") * 48 + F.coalesce(F.sum(F.size("gone")), F.lit(0)) * 4).alias("bytes")).first()["bytes"]
    key, body, gone_col = (unused(docs, f"_gone_{c}") for c in ("id", "body", "at"))
    side = gone.select(F.col("id").alias(key), F.col("body").alias(body), F.col("gone").alias(gone_col))
    if size <= BROADCAST_BYTES:
        side = F.broadcast(side)
    joined = docs.join(side, F.col(id_col).eqNullSafe(F.col(key)) & (_body(text_col) == F.col(body)), "left")
    parts, gone_at = _lines(F.col(text_col)), F.col(gone_col)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone_at)
    kept = F.array_join(F.transform(stay, lambda p: F.get(parts, p)), "\n")
    text = F.when(gone_at.isNull(), F.col(text_col)).otherwise(kept)
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != removed_col]
    removed = F.when(gone_at.isNull(), F.lit(0)).otherwise(F.size(gone_at)).cast("long")
    return joined.select(*columns, removed.alias(removed_col))
