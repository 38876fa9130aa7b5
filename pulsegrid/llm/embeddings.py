"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import bounded
from pulsegrid.llm.components import connected, merge_pairs
from pulsegrid.session import stage

KEY = ["space", "part", "code", "left", "right"]
SMALL = 32  # groups up to this size are compared together
NEAREST = 3  # vertices considered for probes, of each of the two hashes


@dataclass(frozen=True)
class PolytopeConfig:
    """``tables`` hash tables; a bucket joins the nearest vertices of two rotations, and a vector is
    put in the ``probes`` likeliest buckets of each table.  Buckets above ``block`` vectors are compared
    in blocks.
    """

    threshold: float = 0.98
    tables: int = 8
    probes: int = 4
    block: int = 4096
    seed: int = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, x = x.shape[1], x.copy()
    half = 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def bucket_codes(vectors: np.ndarray, config: PolytopeConfig) -> np.ndarray:
    """``(rows, tables, probes)``: the likeliest buckets of each unit vector, the first its own."""
    rows, dim = vectors.shape
    wide = 1 << max(1, int(dim - 1).bit_length())
    padded = np.zeros((rows, wide))
    padded[:, :dim] = vectors
    rng = np.random.default_rng([config.seed, wide])
    out = np.empty((rows, config.tables, config.probes), dtype=np.int64)
    near = min(NEAREST, wide)
    for table in range(config.tables):
        vertex, loss = [], []
        for _ in range(2):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide))
            size = np.round(np.abs(y), 9)  # equal vectors have equal codes, whatever else is in the batch
            top = np.argsort(-size, axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, top, axis=1)
            strength = np.take_along_axis(size, top, axis=1)
            vertex.append(2 * top + (value < 0))
            loss.append((strength[:, :1] - strength) ** 2)
        cost = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(rows, -1)
        code = (vertex[0][:, :, None] * (2 * wide) + vertex[1][:, None, :]).reshape(rows, -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, : config.probes]
        if best.shape[1] < config.probes:
            best = np.pad(best, ((0, 0), (0, config.probes - best.shape[1])), mode="edge")
        out[:, table] = np.take_along_axis(code, best, axis=1)
    return out


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _by_width(raw: pd.Series) -> Iterator[np.ndarray]:
    """Positions of vectors of equal length."""
    lengths = raw.map(len).to_numpy()
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _close_pairs(
    vectors: np.ndarray, start: np.ndarray, size: np.ndarray, side: np.ndarray, two: np.ndarray, threshold: float,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within groups of adjacent rows whose cosine reaches the threshold.

    A group with ``two`` holds two blocks of a bucket, of which only pairs across are wanted.
    Small groups of one size are compared together, large ones in strips.
    """
    for s in np.unique(size[size <= SMALL]).tolist():
        first = start[size == s]
        step = max(1, (1 << 21) // (s * vectors.shape[1]))
        upper = np.triu(np.ones((s, s), dtype=bool), 1)
        for k in range(0, len(first), step):
            at = first[k:k + step, None] + np.arange(s)
            g, i, j = np.nonzero((vectors[at] @ vectors[at].transpose(0, 2, 1) >= threshold) & upper)
            a, b = at[g, i], at[g, j]
            wanted = ~two[a] | (side[a] != side[b])
            yield a[wanted], b[wanted]
    for first, s in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        at = np.arange(first, first + s)
        left, right = (at[~side[at]], at[side[at]]) if two[first] else (at, at)
        for k in range(0, len(left), 512):
            strip = left[k:k + 512]
            i, j = np.nonzero(vectors[strip] @ vectors[right].T >= threshold)
            a, b = strip[i], right[j]
            wanted = (a < b) | two[first]
            yield a[wanted], b[wanted]


def group_links(
    vectors: np.ndarray, number: np.ndarray, part: np.ndarray, code: np.ndarray, side: np.ndarray, two: np.ndarray,
    start: np.ndarray, size: np.ndarray, config: PolytopeConfig,
) -> tuple[np.ndarray, np.ndarray]:
    """For rows in groups by bucket: the links that are counted here, and local components.

    A pair that shares several buckets is counted in the first of them only; codes are worked out
    again for rows that have a link at all.
    """
    rows = len(vectors)
    label, links = np.arange(rows), np.zeros(rows, dtype=np.int64)
    place, codes = np.full(rows, -1), np.empty((0, config.tables, config.probes), dtype=np.int64)
    for a, b in _close_pairs(vectors, start, size, side, two, config.threshold):
        if not len(a):
            continue
        merge_pairs(label, a, b)
        fresh = np.unique(np.concatenate([a, b]))
        fresh = fresh[place[fresh] < 0]
        if len(fresh):
            place[fresh] = len(codes) + np.arange(len(fresh))
            codes = np.concatenate([codes, bucket_codes(vectors[fresh], config)])
        for k in range(0, len(a), 1 << 18):
            _count(a[k:k + (1 << 18)], b[k:k + (1 << 18)], place, codes, part, code, number, links)
    return links, label


def _count(a, b, place, codes, part, code, number, links) -> None:
    for t in range(codes.shape[1]):
        left, right = codes[place[a], t], codes[place[b], t]
        same = (left[:, :, None] == right[:, None, :]).any(axis=2)
        earlier = same.any(axis=1) & (t < part[a])
        least = np.where(same, left, np.iinfo(np.int64).max).min(axis=1)
        keep = ~earlier & ((t != part[a]) | (least == code[a]))
        a, b = a[keep], b[keep]
        if not len(a):
            return
    np.add.at(links, a, number[b])
    np.add.at(links, b, number[a])


def near_duplicates(
    rows: DataFrame, config: PolytopeConfig = PolytopeConfig(), id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    Vectors link if their labels are equal and not NULL, their lengths equal, and their cosine, in
    double precision, reaches ``config.threshold``.  ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` says that it is the row's own.  A vector
    that is NULL, empty, zero, or holds a NULL or non-finite component links with nothing, nor does
    one without a label: it is its own component.  A row with a NULL id keeps its place in the counts;
    a component of such rows alone has a NULL id.  Rows that repeat link with each other.

    Equal vectors of a label become one class, so copies cost one hash.  A class is put in the likeliest
    buckets of every table; only pairs that share a bucket are compared, all of them exactly.
    Vectors of a bucket that holds more than ``config.block`` are compared block by block in separate
    groups.  Groups hand on one row per vector: its count of links, each pair counted once, and
    the smallest member it is tied to.  No pairs are written.
    """
    double = isinstance(rows.schema[vector_col].dataType.elementType, T.DoubleType)
    number = "<f8" if double else "<f4"
    kind = rows.schema[id_col].dataType.simpleString()
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vector.isNotNull() & F.col(label_col).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)
    marked = rows.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.when(sound, vector).alias("vector"),
        F.xxhash64(F.col(label_col).cast("string"), F.size(vector)).alias("space"),
        F.concat_ws("|", F.col(label_col).cast("string"), F.size(vector).cast("string")).alias("named"),
    )

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = [None if v is None else (np.asarray(v, dtype=number) + 0.0).astype(number).tobytes() for v in frame["vector"]]
            yield frame.drop(columns="vector").assign(raw=np.array(raw + [None], dtype=object)[:-1])

    encoded = stage(marked.mapInPandas(encode, f"id {kind}, row long, space long, named string, raw binary"), "vectors")
    clash = encoded.where("raw IS NOT NULL").groupBy("space").agg(F.count_distinct("named").alias("n")).where("n > 1")
    if not clash.isEmpty():
        raise ValueError("two labels have one hash")
    classes = stage(
        encoded.where("raw IS NOT NULL").groupBy("space", "raw").agg(F.min("row").alias("class"), F.count("*").alias("n")), "classes",
    )

    def hashed(with_vectors: bool):
        def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in _by_width(frame["raw"]):
                    for k in range(0, len(at), 2048):
                        some = frame.iloc[at[k:k + 2048]]
                        codes = bucket_codes(unit(some["raw"].tolist(), number), config)
                        each = config.tables * config.probes
                        out = some.loc[some.index.repeat(each), ["space", "class", "n", "raw"] if with_vectors else ["space", "class"]]
                        out = out.assign(part=np.tile(np.repeat(np.arange(config.tables), config.probes), len(some)), code=codes.reshape(-1))
                        yield out.drop_duplicates(["class", "part", "code"])
        return emit

    places = classes.mapInPandas(hashed(False), "space long, class long, part int, code long")
    crowded = stage(
        places.groupBy("space", "part", "code").agg(F.count("*").alias("size")).where(F.col("size") > config.block)
        .withColumn("blocks", F.ceil(F.col("size") / config.block).cast("long")).drop("size"), "crowded",
    )
    dealt = classes.mapInPandas(hashed(True), "space long, class long, n long, raw binary, part int, code long")
    own = F.pmod(F.xxhash64("class"), F.coalesce("blocks", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))
    cut, _ = bounded(crowded, 64)  # one row per config.block places at most, so it grows with the input
    dealt = (
        dealt.join(cut, ["space", "part", "code"], "left").withColumn("own", own).withColumn("other", other)
        .withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other"))
        .withColumn("side", F.col("own") > F.col("other")).drop("own", "other", "blocks")
    )

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ready in _whole_groups(frames):
            keys = ready[KEY].to_numpy()
            start = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            size = np.diff(np.append(start, len(keys)))
            start, size = start[size > 1], size[size > 1]
            if not len(start):
                continue
            at = np.concatenate([np.arange(x, x + y) for x, y in zip(start.tolist(), size.tolist())])
            some, start = ready.iloc[at], np.cumsum(size) - size
            width = np.array([len(x) for x in some["raw"].to_numpy()[start]])
            for w in np.unique(width):  # groups of one vector length
                chosen = width == w
                mine = np.repeat(chosen, size)
                group, counts = some[mine], size[chosen]
                links, label = group_links(
                    unit(group["raw"].tolist(), number), group["n"].to_numpy(), group["part"].to_numpy(), group["code"].to_numpy(),
                    group["side"].to_numpy(dtype=bool), (group["left"] != group["right"]).to_numpy(),
                    np.cumsum(counts) - counts, counts, config,
                )
                tied = np.flatnonzero((links > 0) | (label != np.arange(len(group))))
                member = group["class"].to_numpy()
                yield pd.DataFrame({"class": member[tied], "links": links[tied], "root": member[label[tied]]})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stage(
        dealt.repartition(n, *KEY).sortWithinPartitions(*KEY).mapInPandas(linked, "class long, links long, root long"), "ties",
    )
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = stage(connected(found.select(F.col("class").alias("a"), F.col("root").alias("b"))), "roots")
    settled = stage(
        classes.drop("raw", "space").join(counts, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root")),
        "settled",
    )
    keyed = classes.select("space", "raw", "class").join(settled, "class")
    members = encoded.join(keyed, ["space", "raw"], "left").select("id", "row", F.coalesce("root", "row").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    members = stage(members, "members")
    least = stage(members.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return members.join(least, "root").select(
        "id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted frames cut anew so that no group of equal ``KEY`` goes over an edge."""
    held = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if held is None else pd.concat([held, frame])
        keys = frame[KEY].to_numpy()
        other = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = other[-1] + 1 if len(other) else 0
        held = frame.iloc[cut:]
        if cut:
            yield frame.iloc[:cut]
    if held is not None:
        yield held
