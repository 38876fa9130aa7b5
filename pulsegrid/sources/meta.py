"""Series metadata: lookup, field listing, search, display names."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import stage

FORECAST_PREFIX = "forecast_of_"
MISSING = "N/A"
BLOCK, GROUP = 1 << 18, 1 << 16  # texts and queries that meet in a task of a fuzzy search


def lookup(tags: DataFrame, meta: DataFrame) -> DataFrame:
    """Unit, description and links of each tag; unknown tags keep a row with the defaults."""
    found = meta.select(
        F.col("external_id").alias("tag"), "unit", "description", "asset_id", "data_set_id"
    )
    return tags.select("tag").join(found, "tag", "left").select(
        "tag", F.coalesce("unit", F.lit(MISSING)).alias("unit"),
        F.coalesce("description", F.lit(MISSING)).alias("description"), "asset_id", "data_set_id",
    )


def unpivot(meta: DataFrame, selection: dict[str, str] | None = None) -> DataFrame:
    """``(external_id, position, field, value)``: fixed fields, the selection made, custom metadata.

    Custom entries come last, in key order, as ``metadata.{key}``.
    """
    def or_missing(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))

    def entry(field: Column, value: Column) -> Column:
        return F.struct(field.alias("field"), value.alias("value"))

    fixed = ["name", "unit", "asset_id", "data_set_id", "is_string", "is_step"]
    entries = [entry(F.lit("external_id"), F.col("external_id"))]
    for name in fixed:
        entries.append(entry(F.lit(name), or_missing(name)))
        if name == "name":
            described = F.coalesce(F.col("description"), F.col("external_id"))
            entries.append(entry(F.lit("description"), described))
    entries += [entry(F.lit(k), F.lit(v)) for k, v in (selection or {}).items()]
    custom = F.transform(
        F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))),
        lambda e: entry(F.concat(F.lit("metadata."), e["key"]), e["value"]),
    )
    rows = F.concat(F.array(*entries), custom)
    return meta.select("external_id", F.posexplode(rows).alias("position", "e")).select(
        "external_id", "position", "e.field", "e.value"
    )


def has_valid_id(external_id: Column) -> Column:
    return (
        external_id.isNotNull() & (F.trim(external_id) != "") & (external_id != MISSING)
        & ~external_id.startswith(FORECAST_PREFIX)
    )


def search(meta: DataFrame, query: str = "", limit: int | None = None, exact_match: bool = False) -> DataFrame:
    """Series whose name matches, then those whose description does, each once, in id order.

    An exact search (or a query in double quotes) looks for the text anywhere, ignoring case; other
    queries need every word to occur.  An empty query lists everything.
    """
    valid = meta.where(has_valid_id(F.col("external_id")))
    text = query.strip()
    quoted = len(text) > 2 and text.startswith('"') and text.endswith('"')
    text = text[1:-1] if quoted else text
    if not text:
        ranked = valid.withColumn("match_rank", F.lit(0))
    else:
        words = [text] if quoted or exact_match else text.split()

        def hit(column: str) -> Column:
            found = F.lit(True)
            for word in words:
                found = found & F.lower(F.col(column)).contains(word.lower())
            return found

        rank = F.when(hit("name"), 0).when(hit("description"), 1)
        ranked = valid.withColumn("match_rank", rank).where(F.col("match_rank").isNotNull())
    first = Window.partitionBy("id").orderBy("match_rank", "external_id")
    unique = ranked.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") == 1).drop("_copy")
    return unique if limit is None else unique.orderBy("match_rank", "id").limit(limit)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of each word of a text, in small letters, with two blanks before and one behind a word."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_index(meta: DataFrame) -> DataFrame:
    """``(gram, id, field, size)``: the inverted index of names (field 0) and descriptions (field 1).

    ``size`` is the number of trigrams of the entry's text.  Written once (partitioned or bucketed by
    ``gram`` as a table), it serves any number of searches.
    """
    valid = meta.where(has_valid_id(F.col("external_id")))
    texts = valid.select("id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("field"), trigrams(F.col(c)).alias("grams")) for k, c in enumerate(("name", "description"))
    ])))
    # Rows that repeat an entry become one before its trigrams become rows of their own.
    once = texts.where(F.size("grams") > 0).groupBy("id", "field", F.size("grams").alias("size")).agg(
        F.array_distinct(F.flatten(F.collect_set("grams"))).alias("grams"),
    )
    return once.select(F.explode("grams").alias("gram"), "id", "field", "size")


def _joined(gram: str) -> Column:
    """A group's trigrams as one text; they hold small letters, digits and blanks only."""
    return F.array_join(F.array_sort(F.collect_list(gram)), ",")


def _shares(texts: pa.Table, asked: pa.Table, least: float, rare: int, limit: int) -> pa.Table:
    """The ``limit`` best of a block's texts in every field for each query, weights added from the rarest trigram on."""
    count, postings = texts.num_rows, {}
    for k, grams in enumerate(texts["grams"].to_pylist()):
        for gram in grams.split(","):
            postings.setdefault(gram, []).append(k)
    # A trigram that an entry has twice counts twice.
    postings = {g: np.unique(np.array(own, np.int64), return_counts=True) for g, own in postings.items()}
    fields, sizes = texts["field"].to_numpy(), texts["size"].to_numpy()
    turn = pc.rank(texts["first"], null_placement="at_start").to_numpy() if count else np.zeros(0)
    numbers, places, overlaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for number, grams, weights in zip(*[asked[c].to_pylist() for c in ("number", "grams", "weights")]):
        told, near = np.zeros(count), np.zeros(count, bool)
        for place, (gram, weight) in enumerate(zip(grams.split(","), weights)):
            if place == rare and not near.any():
                break
            if gram in postings:
                own, times = postings[gram]
                told[own] += weight * times
                if place < rare:
                    near[own] = True
        met = np.flatnonzero(near)
        overlap = told[met] / sum(weights)
        level = np.round(overlap, 9)
        for field in np.unique(fields):
            own = np.flatnonzero((level >= least) & (fields[met] == field))
            if len(own) > limit:  # what is below the limit-th overlap need not be ordered
                own = own[level[own] >= np.partition(level[own], -limit)[-limit]]
            own = own[np.lexsort((turn[met[own]], sizes[met[own]], -level[own]))[:limit]]
            numbers.append(np.full(len(own), number, np.int64))
            places.append(met[own])
            overlaps.append(overlap[own])
    found = texts.select(["first", "field", "size"]).take(pa.array(np.concatenate(places)))
    found = found.add_column(0, "number", pa.array(np.concatenate(numbers)))
    return found.append_column("overlap", pa.array(np.concatenate(overlaps)))


def _grid(texts: int, queries: int, tasks: int) -> tuple[int, int]:
    """``(blocks, groups)``: as many blocks of texts and groups of queries as make ``tasks`` pairs with little to copy.

    A query costs about ten times a text, as its best ones leave every block.
    """
    groups = min(tasks, max(1, round(math.sqrt(tasks * 10 * queries / max(1, texts)))))
    return max(math.ceil(tasks / groups), math.ceil(texts / BLOCK)), max(groups, math.ceil(queries / GROUP))


def search_fuzzy(
    index: DataFrame, queries: DataFrame, least: float = 0.5, rare: int = 4, limit: int = 20,
) -> DataFrame:
    """``(query_id, rank, id, field, overlap)``: the entries nearest to each of ``(query_id, query)``.

    A trigram weighs ``ln(1 + entries / entries that hold it)``.  ``overlap`` is the weight that a
    query shares with an entry's text over the query's whole weight; entries of ``least`` or more are
    ranked by it, names before descriptions, then texts with fewer trigrams, then ids.  Candidates come
    from the ``rare`` rarest trigrams of a query that the index has, so they are what shares one of these;
    common trigrams only add to the weight of candidates.  Each entry is listed once, with its better
    field.  Trigrams that no entry has weigh as if one had them.  The names are not read: the plan
    joins the index to the queries' trigrams.  NULL and empty queries find nothing.

    Texts with the same trigrams are compared once, for their ``limit`` smallest ids; no other of their
    entries can be listed.  Blocks of texts meet groups of queries in tasks, which give at most ``limit``
    texts a query and field, so what is shuffled follows entries and queries, not the pairs that share a trigram.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.explode(trigrams(F.col("query"))).alias("gram"))
    asked = asked.groupBy("query_id").agg(_joined("gram").alias("text"))
    held = stage(index.groupBy("id", "field").agg(_joined("gram").alias("grams"), F.min("size").alias("size")), "entries")
    entries = held.count()

    same = Window.partitionBy("grams", "field", "size").orderBy(F.col("id").asc_nulls_first())
    members = held.withColumn("_at", F.row_number().over(same)).where(F.col("_at") <= limit)
    members = stage(members.withColumn("first", F.first("id").over(same)), "members")
    texts = members.where("_at = 1").select("grams", "field", "size", "first")

    numbers = asked.select("text").distinct().withColumn("number", F.monotonically_increasing_id())
    numbers = stage(numbers, "asked")
    grams = numbers.select("number", F.explode(F.split("text", ",")).alias("gram"))
    df = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    weight = F.ln(1 + F.lit(entries) / F.coalesce("df", F.lit(1)))
    place = F.struct(F.col("df").isNull().alias("unknown"), "df", "gram", weight.alias("weight"))
    weighed = grams.join(df, "gram", "left").groupBy("number").agg(F.array_sort(F.collect_list(place)).alias("told")).select(
        "number", F.array_join("told.gram", ",").alias("grams"), F.col("told.weight").alias("weights"),
    )

    blocks, groups = _grid(texts.count(), numbers.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    pair = ["block", "group"]

    def dealt(frame, own, n, other, m, *key):
        """The rows in ``n`` parts by ``key``, each copied for all ``m`` parts of the other side."""
        part = F.pmod(F.xxhash64(*key), F.lit(n)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return frame.select("*", part, every).repartition(blocks * groups, *pair).groupBy(*pair)

    left = dealt(texts, "block", blocks, "group", groups, "grams", "field", "size")
    right = dealt(weighed, "group", groups, "block", blocks, "number")
    schema = f"number long, first {dict(texts.dtypes)['first']}, field int, size int, overlap double"
    hits = left.cogroup(right).applyInArrow(lambda t, a: _shares(t, a, least, rare, limit), schema)

    level = F.round("overlap", 9)
    part = Window.partitionBy("number", "field").orderBy(F.desc(level), "size", F.col("first").asc_nulls_first())
    nearest = hits.withColumn("_part", F.row_number().over(part)).where(F.col("_part") <= limit).alias("n")
    listed = nearest.join(members.alias("m"), F.expr("n.first <=> m.first AND n.field = m.field")).select(
        "number", "overlap", "n.field", "n.size", "id",
    )
    order = [F.desc(level), F.col("field"), F.col("size"), F.col("id")]
    once = Window.partitionBy("number", "id").orderBy(*order[:2])
    best = listed.withColumn("_own", F.row_number().over(once)).where("_own = 1")
    own = Window.partitionBy("number").orderBy(*order)
    ranked = best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= limit)
    return asked.join(numbers, "text").join(ranked, "number").select("query_id", "rank", "id", "field", "overlap")


def field_filter(found: DataFrame, field: str | None, prefixes: dict[str, str]) -> DataFrame:
    """Keep series whose id starts with the prefix of ``field``; an unknown field keeps all."""
    prefix = prefixes.get(field, "") if field else ""
    return found.where(F.col("external_id").startswith(prefix)) if prefix else found


def display_name() -> Column:
    """``unit (area/system): description (unit of measure)`` from a dotted name."""
    name, parts = F.col("name"), F.split("name", r"\.")
    size = F.size(parts)
    middle = F.array_join(F.slice(parts, 3, F.greatest(size - 4, F.lit(0))), "/")
    short = F.concat(F.element_at(parts, -2), F.lit(" ("), middle, F.lit(")"))

    def given(column: str) -> Column:
        return F.col(column).isNotNull() & (F.col(column) != "") & (F.col(column) != MISSING)

    text = F.concat(
        F.when(size > 3, short).otherwise(name),
        F.when(given("description"), F.concat(F.lit(": "), "description")).otherwise(""),
        F.when(given("unit"), F.concat(F.lit(" ("), F.col("unit"), F.lit(")"))).otherwise(""),
    )
    return F.when(given("name"), text).otherwise(F.lit(MISSING))


def selection_list(found: DataFrame) -> DataFrame:
    """The entries offered for selection."""
    def shown(column: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(MISSING)).alias(column)

    return found.select(
        "id", "external_id", display_name().alias("display_name"),
        shown("name"), shown("unit"), shown("description"),
    )
