import io
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import audit, search, tokens
from pulsegrid.llm.wavelet import BLOCK, WaveletFile, encode

# Wavelet files and token output ----------------------------------------------------------------


def opened(ids, ends=None):
    ids = np.asarray(ids, np.uint32)
    return WaveletFile(io.BytesIO(encode(ids, np.array([len(ids)] if ends is None else ends), [7] if ends is None else list(range(len(ends))))))


@pytest.mark.parametrize("size, top", [(1, 1), (17, 1), (3000, 5), (BLOCK + 11, 50_257), (3 * BLOCK, 300)])
def test_wavelet_file_equals_the_plain_array(size, top):
    rng = np.random.default_rng(size)
    ids = (rng.zipf(1.4, size) % top).astype(np.uint32)
    file = opened(ids)
    assert (file.decode() == ids).all() and file.keys == [7] and file.ends.tolist() == [size]
    for at in rng.integers(0, size, 12):
        assert file.access(int(at)) == ids[at]
    for token in [*np.unique(ids)[:4].tolist(), int(ids[-1]), 60_000]:
        places = np.flatnonzero(ids == token)
        assert file.count(token) == len(places)
        assert file.count(token, size // 3, size // 2) == (ids[size // 3:size // 2] == token).sum()
        assert (file.occurrences(token) == places).all()
        assert (file.occurrences(token, 2, 5) == places[2:7]).all()


def test_wavelet_file_of_nothing_and_of_something_else():
    file = opened([], [])
    assert len(file.decode()) == 0 and file.count(3) == 0 and len(file.occurrences(3)) == 0
    with pytest.raises(IndexError):
        file.access(0)
    with pytest.raises(ValueError):
        WaveletFile(io.BytesIO(b"x" * 40))


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


ODD_TEXTS = [
    "", " ", "   ", "a", " a", "a ", "a  b", "a   b \n  c\n\n d", "don't  'll x's", "\x1c x \x85 y 　 z  w", "é é ² ½ x",
    "<|endoftext|>", "a  <|endoftext|>  b", "tab\t tab \t", "1,234.5 a1b2", "\U0001F600 \U0001F600x", "ab.\nCd ef,\r\ngh", "​ a​ b",
]


def test_pieces_give_the_ids_of_whole_texts(vocabulary, tokenizer):
    found = tokens.Encoder(vocabulary).encode(ODD_TEXTS)
    for text, ids in zip(ODD_TEXTS, found):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'sR.,1é ²\n\t\r \x1c　́<|>")) | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_pieces_give_the_ids_of_any_text(texts):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    encoder = tokens.encoder_of(path)
    wanted = [encoder._tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in encoder.encode(texts)] == wanted


ODD_CHARACTERS = [
    *"ab Zé'\n\t\r\v\f ., 12sretdmlv-_$×÷ʰ²中", "  ", "\n\n", "'s", "'re", "а", "ѿ", "\u0300", "\u0250", "\u0660", "\u0085", "\u00a0", "\u2003",
    "\u3000", "\x1c", "\x00", "\x7f", "\U0001F600", "\ufeff", "\u200b", "<|endoftext|>",
]


def test_cuts_beside_odd_characters_and_forgetting_keep_the_ids(vocabulary, tokenizer, monkeypatch):
    rng = np.random.default_rng(2)
    encoder = tokens.Encoder(vocabulary)
    for held in (1 << 20, 300, 1 << 20):
        monkeypatch.setattr(tokens, "HELD_PIECES", held)
        texts = ["".join(ODD_CHARACTERS[k] for k in rng.integers(0, len(ODD_CHARACTERS), rng.integers(0, 12))) for _ in range(3000)]
        wanted = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids.tolist() for ids in encoder.encode(texts)] == wanted


def test_a_word_is_encoded_once_whatever_stands_beside_it(vocabulary, tokenizer):
    """The same words before every sign and at line ends are no new pieces."""
    encoder, words = tokens.Encoder(vocabulary), [f"{a}{b}ing" for a in ("str", "fl", "wh") for b in "aeiou"]
    texts = [f" {v}{sign} {w}\n{w}{sign}\n{v}" for v in words for w in words for sign in ",.;:!?"]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder._seen) <= 2 * len(words) + 6 + 1


def test_pieces_that_are_met_again_outlast_the_others(vocabulary, monkeypatch):
    encoder = tokens.Encoder(vocabulary)
    encoder.encode(["often " + " ".join(f"once{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))])
    encoder.encode(["often"])
    monkeypatch.setattr(tokens, "HELD_PIECES", 40)
    encoder.encode(["more"])
    assert set(encoder._seen) == {b"often", b"more"}


def written(rows, tokenizer):
    """What op11 must give for ``(id, text)``, ids ascending and missing ones last."""
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(docs, vocabulary, tokenizer):
    rng = np.random.default_rng(3)
    rows = [(int(k), " ".join(f"w{rng.integers(90)}" for _ in range(rng.integers(0, 60)))) for k in rng.permutation(300)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(-5, None), (None, "no id")]
    manifest = tokens.write_shards(docs(rows), vocabulary, shard_tokens=500)
    assert manifest.count() > 8
    found = [tuple(r) for r in tokens.read_documents(manifest).orderBy("start").collect()]
    assert found == written(rows, tokenizer)
    assert manifest.agg(F.sum("tokens")).first()[0] == found[-1][1] + found[-1][2]

    ids = {key: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0] for key, text in rows}
    wanted = [0, ids[5][0] if ids[5] else 1, 49_999]
    counts = {r["token"]: r["n"] for r in tokens.token_counts(manifest, wanted).collect()}
    assert counts == {t: sum(own.count(t) for own in ids.values()) for t in wanted}
    places = sorted(((r["token"], r["id"] is None, r["id"] or 0, r["position"]) for r in tokens.token_occurrences(manifest, wanted, 7).collect()))
    assert places == sorted((t, k is None, k or 0, p) for t in set(wanted) for k, own in ids.items() for p, x in enumerate(own) if x == t)


def test_token_files_of_odd_and_of_no_rows(odd_docs, no_docs, vocabulary, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    found = tokens.read_documents(tokens.write_shards(odd_docs, vocabulary)).orderBy("start").collect()
    wanted = written(rows, tokenizer)
    assert [r["id"] for r in found] == [w[0] for w in wanted]
    assert Counter((r["id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((w[0], w[2], w[3]) for w in wanted)
    starts = np.cumsum([0] + [r["n_tokens"] for r in found])[:-1].tolist()
    assert [r["start"] for r in found] == starts
    assert tokens.read_documents(tokens.write_shards(no_docs, vocabulary)).count() == 0


# Filter audit ----------------------------------------------------------------------------------


def audit_brute(rows, labels):
    rows = [(k, t or "", p or "") for k, t, p in rows]
    marks = []
    for key, text, part in rows:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        earlier = any(t == text and k is not None and (key is None or k < key) for k, t, _ in rows)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": earlier,
        }
        good, toxic = (any(k == key and key is not None and v == 1 for k, v in side) for side in labels)
        marks.append((part, fails, good, toxic))
    out = {}
    for part in {m[0] for m in marks}:
        for order in permutations("ABCDE"):
            there = [m for m in marks if m[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [m for m in there if m[1][f]]
                redundant = sum(m[1][f] for m in gone)
                there, gone = [m for m in there if not m[1][f]], gone + removed
                unique = sum(m[0] == part and m[1][f] and sum(m[1].values()) == 1 for m in marks)
                out[part, "".join(order), step] = [len(there), len(removed), redundant, unique, sum(m[2] for m in removed), sum(m[3] for m in removed)]
    shapley = Counter()
    for (part, order, step), counts in out.items():
        shapley[part, order[step - 1]] += counts[1]
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def audited(found):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*audit.COUNTS, "shapley")] for r in found.collect()}


LABELS = "doc_id long, quality int, toxic int"


def test_audit_equals_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        text = " ".join(("W" if rng.random() < 0.1 else "w") + str(rng.integers(40 if k % 3 else 4000)) for _ in range(rng.integers(150, 260)))
        rows.append((k, text + (" #1" if k % 5 == 0 else ""), ["a", "b", None, ""][k % 4]))
    rows += [(100 + k, rows[3][1], ["a", "b", "c"][k % 3]) for k in range(30)]
    rows += [(200, None, "a"), (201, "", "b"), (None, rows[3][1], "a"), (None, rows[3][1], "a"), (3, rows[3][1], "b"), (50, rows[7][1], None)]
    labels = [(k, int(rng.integers(2)), int(rng.integers(2))) for k in range(0, 220, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1)]
    told = spark.createDataFrame(labels, LABELS)
    frame = docs([(k, t, "en", p) for k, t, p in rows])
    brute = audit_brute(rows, ([(k, q) for k, q, _ in labels], [(k, t) for k, _, t in labels]))
    found = audit.audit(frame, told)
    assert audited(found) == brute and len(brute) == 4 * 600


def test_audit_of_odd_and_of_no_rows(spark, odd_docs, no_docs):
    told = spark.createDataFrame([(1, 1, 0), (6, None, 1)], LABELS)
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text", "source").collect()]
    assert audited(audit.audit(odd_docs, told)) == audit_brute(rows, ([(1, 1)], [(6, 1)]))
    assert audit.audit(no_docs, told).count() == 0
    assert audit.audit(odd_docs, told.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


# Lexical search --------------------------------------------------------------------------------


def search_brute(rows, items, k=10):
    import math

    bags = [(key, Counter(search.terms(text))) for key, text in rows]
    sizes = [sum(b.values()) for _, b in bags]
    documents, occurrences = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (key, bag), n in zip(bags, sizes):
            score = 0
            for term, repeats in Counter(search.terms(text)).items():
                if bag[term]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[term] + 1)))
                    m = 25 + (75 * n * documents) // occurrences
                    score += repeats * w * ((10**9 * bag[term]) // (1000 * bag[term] + 8 * m))
            if score > 0:
                found.append((-score, key is None, key or 0))
        out += [(item, r, None if missing else key, -score) for r, (score, missing, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def ranked(found):
    return sorted(tuple(r) for r in found.select("item_id", "rank", "id", "score").collect())


@pytest.mark.parametrize("config", [search.SearchConfig(), search.SearchConfig(block=16), search.SearchConfig(k=3, block=7, item_bytes=300)])
def test_search_equals_brute_force(spark, docs, config):
    rng = np.random.default_rng(8)
    def text(n):
        return " ".join(("Ä" if rng.random() < 0.1 else "T") + str(int(rng.zipf(1.3)) % 300) for _ in range(n))
    rows = [(int(k), text(rng.integers(0, 80))) for k in rng.permutation(400)]
    rows += [(1000 + k, rows[5][1]) for k in range(40)]
    items = [(k, text(rng.integers(1, 40))) for k in range(12)] + [(50, rows[5][1]), (51, ""), (52, None), (53, "nowhere"), (54, "T1 t1-T1_t2")]
    found = search.search(docs(rows), spark.createDataFrame(items, "item_id long, text string"), config)
    assert ranked(found) == search_brute(rows, items, config.k)


def test_accumulators_are_limited_and_exact():
    """A rare term fills the first ranks; the frequent one behind it makes no accumulators."""
    rare, common = np.arange(20), np.arange(2000)
    postings = {0: (rare, np.full(20, 900)), 1: (common, np.full(2000, 10))}
    at, scores, made = search.rank_block([(0, 1), (1, 2)], postings, 2000, 10, 0)
    assert made == 20 and set(scores.tolist()) == {920} and set(at.tolist()) == set(range(20))
    _, _, made = search.rank_block([(0, 1), (1, 90)], postings, 2000, 10, 0)
    assert made == 2000  # the bound of the last term equals the tenth score, so ties must be seen
    at, scores, _ = search.rank_block([(0, 1), (1, 2)], postings, 2000, 10, 921)
    assert len(at) == 0


def test_search_of_odd_and_of_no_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "plain text"), (1, "plain text"), (2, "password word5x5 \U0001F600")], "item_id long, text string")
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert ranked(search.search(odd_docs, items)) == search_brute(rows, [tuple(r) for r in items.collect()])
    assert search.search(no_docs, items).count() == 0
    assert search.search(odd_docs, items.limit(0)).count() == 0


def test_terms_part_at_every_other_ascii_character():
    text = "".join(map(chr, range(256))) + "x_Y-z ÄÖ"
    pattern = __import__("re").compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert [t.decode() for t in search.terms(text)] == pattern.findall(lowered)


def test_an_encoder_holds_no_more_pieces_than_two_workers_have_room_for():
    """A piece takes about 200 bytes, so that each worker of an executor of 3000 MB holds 210 MB of them."""
    from pulsegrid.llm import tokens

    assert tokens.HELD_PIECES * 200 <= 210 << 20
