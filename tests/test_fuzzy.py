import math
import re

from pulsegrid.sources import meta

NAMES = ["Pump Alpha pressure", "Pump Alpha flow", "Compressor beta", "Valve gamma", "pump alpha", None, "", "Übergabe 12"]


def grams(text):
    out = []
    for word in re.split("[^a-z0-9]+", (text or "").lower()):
        padded = f"  {word} " if word else ""
        out += [padded[k:k + 3] for k in range(len(padded) - 2)]
    return list(dict.fromkeys(out))


def brute(entries, queries, least=0.5, rare=4, limit=20):
    """``entries`` are ``(id, field, text)``."""
    own = [(k, field, set(grams(text))) for k, field, text in entries if grams(text)]
    df = {g: sum(g in e for _, _, e in own) for _, _, e in own for g in e}
    out = []
    for query_id, text in queries:
        asked = grams(text)
        weight = {g: math.log(1 + len(own) / df.get(g, 1)) for g in asked}
        chosen = set(sorted(asked, key=lambda g: (g not in df, df.get(g, 0), g))[:rare])
        found = {}
        for k, field, e in own:
            share = round(sum(weight[g] for g in asked if g in e) / sum(weight.values()), 9) if asked else 0
            if chosen & e and share >= least:
                found[k] = min(found.get(k, (9,)), (-share, field, len(e), k))
        out += [(query_id, r, k, field, -share) for r, (share, field, _, k) in enumerate(sorted(found.values())[:limit], 1)]
    return out


def table(spark):
    rows = [(k, f"x{k}", name, ["Alpha area", "pump house", None][k % 3]) for k, name in enumerate(NAMES)] + [(90, None, "Pump Alpha", "lost")]
    return spark.createDataFrame(rows, "id long, external_id string, name string, description string")


def test_fuzzy_search_equals_brute_force(spark):
    series = table(spark)
    queries = [(1, "Pmup Alpha"), (2, "compresor"), (3, "gama valv"), (4, None), (5, ""), (6, "zzz"), (7, "alpha pump flwo"), (8, "12")]
    entries = [(k, f, t) for k, x, n, d in series.collect() if x for f, t in ((0, n), (1, d))]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    for least, rare, limit in ((0.5, 4, 20), (0.2, 2, 2), (0.9, 50, 20)):
        found = meta.search_fuzzy(meta.trigram_index(series), asked, least, rare, limit)
        told = sorted((*tuple(r)[:4], round(r["overlap"], 9)) for r in found.collect())
        assert told == sorted(brute(entries, queries, least, rare, limit))
    best = meta.search_fuzzy(meta.trigram_index(series), asked).where("rank = 1")
    assert {r["query_id"]: r["id"] for r in best.collect()}[2] == 2


def test_the_names_are_not_read_by_a_search(spark, tmp_path):
    path = f"{tmp_path}/index"
    meta.trigram_index(table(spark)).write.parquet(path)
    asked = spark.createDataFrame([(1, "pump")], "query_id long, query string")
    plan = meta.search_fuzzy(spark.read.parquet(path), asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "description" not in plan
    assert meta.search_fuzzy(spark.read.parquet(path).limit(0), asked).count() == 0
    assert meta.search_fuzzy(spark.read.parquet(path), asked.limit(0)).count() == 0


def test_copies_blocks_and_groups_change_nothing(spark, monkeypatch):
    """Many entries of the same texts, rows that come twice, an id with two names, and small blocks: as brute force says."""
    monkeypatch.setattr(meta, "BLOCK", 2)
    monkeypatch.setattr(meta, "GROUP", 1)
    names = ["Pump Alpha", "alpha pump", "Pump Beta", "Pump Alpha flow", None]
    rows = [(k * 7919 % 1009, f"x{k}", names[k % 5], ["pump alpha", "area"][k % 2]) for k in range(60)]
    series = spark.createDataFrame(rows + rows[:9], "id long, external_id string, name string, description string")
    queries = [(k, ["Pump Alpa", "pump beta flow", "area"][k % 3]) for k in range(12)]
    entries = [(k, f, t) for k, _, n, d in rows for f, t in ((0, n), (1, d))]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    for least, rare, limit in ((0.5, 4, 20), (0.1, 3, 4), (0.3, 8, 1)):
        told = meta.search_fuzzy(meta.trigram_index(series), asked, least, rare, limit).collect()
        assert sorted((*tuple(r)[:4], round(r["overlap"], 9)) for r in told) == sorted(brute(entries, queries, least, rare, limit))


def test_pairs_that_share_a_trigram_are_not_shuffled(spark):
    """A block gives ``limit`` texts a query and field, however many texts share its trigrams."""
    import pyarrow as pa

    texts = pa.table({
        "grams": [f"  p, pu,pum,mp ,ump,x{k:02d}" for k in range(90)], "field": pa.array([k % 2 for k in range(90)], pa.int32()),
        "size": pa.array([6] * 90, pa.int32()), "first": pa.array(range(90, 0, -1)),
    })
    asked = pa.table({"number": [5, 6], "grams": [" pu,ump", "zzz"], "weights": [[1.0, 2.0], [1.0]]})
    found = meta._shares(texts, asked, 0.5, 4, 3).to_pydict()
    assert found["number"] == [5] * 6 and found["first"] == [2, 4, 6, 1, 3, 5] and found["overlap"] == [1.0] * 6
    series, queries = table(spark), spark.createDataFrame([(1, "pump")], "query_id long, query string")
    plan = meta.search_fuzzy(meta.trigram_index(series), queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan
