import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import components, embeddings, exact, simhash

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def test_heavy_hitters_find_every_frequent_digest(spark):
    rows = [(bytes([k % 7]) if k % 3 == 0 else f"{k}".encode(),) for k in range(3000)]
    found = exact.heavy_hitters(spark.createDataFrame(rows, "digest binary").repartition(5), 30)
    kept = {bytes(r["digest"]) for r in found.collect()}
    assert {bytes([k]) for k in range(7)} <= kept and len(kept) <= 31


def test_counters_never_exceed_and_bound_the_error():
    counters, n = {}, 0
    for k in range(500):
        key = b"hot" if k % 4 == 0 else str(k).encode()
        counters[key] = counters.get(key, 0) + 1
        counters = exact.reduce_counters(counters, 9)
        n += 1
        assert len(counters) <= 9
    assert 125 - n / 10 <= counters[b"hot"] <= 125


def exact_brute(rows):
    groups = {}
    for at, (key, text) in enumerate(rows):
        groups.setdefault(BLANK.sub(" ", text or ""), []).append((key is None, key or 0, at))
    out = []
    for text, members in groups.items():
        first = min(members)
        for m in members:
            out.append((None if m[0] else m[1], None if first[0] else first[1], len(members), m == first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_duplicates_equal_brute_force(docs, counters):
    rows = [(k, f"copy  {k % 5 if k % 2 else 'hot'}\n") for k in range(200)] + [(300, "copy hot "), (None, "copy hot\t"), (1, None), (2, "")]
    found = exact.exact_duplicates(docs(rows), counters=counters)
    got = [(r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in found.collect()]
    assert sorted(got, key=str) == exact_brute(rows)


def test_exact_duplicates_take_odd_rows(odd_docs, no_docs):
    found = exact.exact_duplicates(odd_docs).collect()
    assert len(found) == 11 and sum(r["kept"] for r in found) == 7
    assert [r["kept"] for r in found if r["id"] == 6] == [False, False]
    assert exact.exact_duplicates(no_docs).count() == 0


def naive_fingerprint(text):
    words = BLANK.sub(" ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).strip(" ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_brute(rows):
    prints = [naive_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] > label[j]:
                    label[i], changed = label[j], True
    least = {}
    for (key, _), root in zip(rows, label):
        if key is not None:
            least[root] = min(key, least.get(root, key))
    return sorted(((k, f"{p:016x}", least.get(r)) for (k, _), p, r in zip(rows, prints, label)), key=str)


def near_rows(n=120):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(n):
        words = list(rng.choice(vocabulary, rng.integers(1, 300)))
        rows.append((10 * k, " ".join(words)))
        if k % 3 == 0:
            words[len(words) // 2] = "Changed"
            rows.append((10 * k + 1, "  ".join(words)))
    return rows + [(5, None), (7, ""), (9, "Ä ß A\x0bB"), (None, "Ä ß a b"), (None, None)]


def test_simhash_equals_brute_force(docs):
    rows = near_rows()
    found = simhash.near_duplicates(docs(rows), simhash.SimHashConfig(shard=16, sample_every=2))
    got = found.select("id", simhash.fingerprint_hex(F.col("fp")), "component_id").collect()
    assert sorted(((tuple(r)) for r in got), key=str) == simhash_brute(rows)


def test_tree_finds_every_pair_once():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    near = points[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64))
    points = np.unique(np.concatenate([points, near, near ^ np.uint64(1 << 40)]))
    tree = simhash.build_tree(points[::3], 8, 2)
    leaf, at, home = simhash.route(tree, points, 2)
    assert tree.leaves > 20 and home.sum() == len(points)
    seen = {}
    for k in range(tree.leaves):
        mine, own = at[leaf == k], home[leaf == k]
        for i, x in enumerate(mine):
            for j, y in enumerate(mine):
                if own[j] and x != y and (not own[i] or i < j) and int(points[x] ^ points[y]).bit_count() <= 2:
                    pair = (min(x, y), max(x, y))
                    seen[pair] = seen.get(pair, 0) + 1
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    assert seen == dict.fromkeys(zip(i, j), 1)


def test_crowded_leaf_uses_a_tree():
    rng = np.random.default_rng(2)
    points = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.arange(64, dtype=np.uint64)]))
    label = np.arange(len(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    components.merge_pairs(label, i, j)
    a, b = simhash.leaf_links(points, np.ones(len(points), dtype=bool), 2, 16)
    mine = np.arange(len(points))
    mine[a] = b
    assert np.array_equal(mine, label)


def test_very_long_text_in_pieces(monkeypatch):
    text = " ".join(f"x{i % 313}" for i in range(5000))
    whole = simhash.simhash(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 97)
    assert simhash.simhash(text.encode()) == whole == np.uint64(naive_fingerprint(text)).astype(np.int64)


def test_simhash_takes_odd_rows(odd_docs, no_docs):
    found = {}
    for r in simhash.near_duplicates(odd_docs).collect():
        found.setdefault(r["id"], []).append((r["fp"], r["component_id"]))
    assert sum(map(len, found.values())) == 11
    assert found[2] == found[3] == found[4] == [(0, 2)] and (0, 2) in found[None] and found[6][0] == found[6][1]
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_representatives(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 6
    assert simhash.keep_representatives(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 400)] + [(7, 7)] + [(-5, 399)]
    found = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(61)) and all(found[k] == -5 for k in range(100, 400))
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, class string, raw string, side int"


def vector_rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    rows = []
    for k in range(400):
        v = base[k % 60] + rng.normal(size=24) * (0.02 if k % 2 else 0.3)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 60 % 3))
    rows += [(500 + k, rows[3][1], rows[3][2]) for k in range(20)]
    rows += [(600, None, 1), (601, [0.0] * 24, 1), (602, [1.0, None] * 12, 1), (603, [float("nan")] * 24, 1), (604, [float("inf")] * 24, 1), (605, rows[0][1], None), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1), (None, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (608, [], 1)]
    return rows


def vector_brute(rows):
    ok = [v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    label, links = np.arange(len(rows)), np.zeros(len(rows), int)
    for i, (_, v, l) in enumerate(rows):
        for j, (_, u, m) in enumerate(rows):
            if i != j and ok[i] and ok[j] and l == m and len(u) == len(v):
                x, y = np.array(u), np.array(v)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links[i] += 1
                    components.merge_pairs(label, np.array([i]), np.array([j]))
    least = {}
    for (key, _, _), root in zip(rows, label):
        if key is not None:
            least[root] = min(key, least.get(root, key))
    return sorted(((k, int(n), least.get(r), k is not None and k == least.get(r)) for (k, _, _), n, r in zip(rows, links, label)), key=str)


@pytest.mark.parametrize("block, broadcast", [(8, True), (8, False), (4096, True)])
def test_embeddings_equal_brute_force(spark, monkeypatch, block, broadcast):
    if not broadcast:
        monkeypatch.setattr(embeddings, "bounded", lambda df, width: (df, False))
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECTORS)
    found = embeddings.near_duplicates(frame, embeddings.PolytopeConfig(block=block))
    assert sorted((tuple(r) for r in found.collect()), key=str) == vector_brute(rows)


def test_embeddings_of_an_empty_table_and_doubles(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    pair = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1e-3], "a")], "vec_id int, embedding array<double>, label string")
    assert [tuple(r) for r in embeddings.near_duplicates(pair).orderBy("id").collect()] == [(1, 1, 1, True), (2, 1, 1, False)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = embeddings.hadamard(x)
    assert np.allclose((x * x).sum(axis=1), (y * y).sum(axis=1)) and np.allclose(embeddings.hadamard(y), x)
