import random

import numpy as np
import xxhash

from corpus_pipeline import NEAR
from florilex.llm import simhash

from . import brute


def test_trie_pairs_equal_all_pairs():
    rng = np.random.default_rng(1)
    value = np.unique(rng.integers(0, 2**12, 400).astype(np.uint64))
    x, y = simhash.trie_pairs(np.zeros(len(value), np.int64), value, np.full(len(value), 12), 2)
    got = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for i in range(len(value)) for j in range(i + 1, len(value)) if bin(int(value[i]) ^ int(value[j])).count("1") <= 2}
    assert got == want


def expected(rows):
    prints = {}
    for doc, text in rows:
        words = brute.words((text or "").encode())
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return {d: (f"{f:016x}", c) for (d, f), c in zip(prints.items(), brute.components(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2).values(), strict=True)}


def test_components_equal_brute_force(spark):
    r = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "ÉTÉ", "x", "y", "delta"]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 60, 300]))] for _ in range(30)]
    rows = []
    for k in range(150):
        words = list(r.choice(base))
        if r.random() < 0.6:
            words[r.randrange(len(words))] = "new"
        rows.append((k * 3, r.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1000, ""), (1001, None), (1002, " \n"), (1003, "nbsp word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as fp", "3 as key")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.op_query(df).collect()}
    assert got == expected(rows)


def test_crowded_keys_are_divided_without_loss(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, (rng.getrandbits(12) | 5 << 50).to_bytes(8, "big")) for i in range(300)]
    nodes = spark.createDataFrame([(int.from_bytes(f, "big"), bytearray(f)) for _, f in rows], "node long, fp binary").distinct()
    monkeypatch.setattr(simhash, "CROWDED", 20)
    got = simhash.components(simhash.links(simhash.divided(simhash.rotated(nodes, 1, 64, 2), 2), 1, 2, 2)).collect()
    values = sorted({int.from_bytes(f, "big") for _, f in rows})
    want = brute.components(values, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert {x.node: x.root for x in got} == {k: v for k, v in want.items() if list(want.values()).count(v) > 1}


def test_wide_fingerprints_equal_brute_force(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    rows, base = [], [[r.choice(vocab) for _ in range(120)] for _ in range(8)]
    for k in range(90):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 1, 2, 6])):
            words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, 5, 8, 32, 2, 84, True).collect()}
    fps = {d: np.frombuffer(simhash.fingerprint(t.encode(), 5, 8, True), ">u4") for d, t in rows}

    def linked(a, b):
        diff = [bin(int(x)).count("1") for x in fps[a] ^ fps[b]]
        return min(diff) <= 2 and sum(diff) <= 84

    assert got == brute.components([d for d, _ in rows], linked)


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.op_query(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "only here no more")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id) for x in simhash.op_query(odd).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = brute.words(t.encode())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def similar_texts():
    """Groups of texts of 100 five-word shingles; one differs from the first of its group in the last words, so that similarities are from 0.65 to 1."""
    rows = []
    for g in range(40):
        words = [f"g{g}w{i}" for i in range(104)]
        for k, cut in enumerate([0, 5, 10, 11, 12, 15, 20][: 2 + g % 6]):
            rows.append((100 * g + k, " ".join(words[: 104 - cut] + [f"g{g}k{k}x{i}" for i in range(cut)])))
    return rows


def test_links_are_those_of_exact_jaccard(spark, monkeypatch):
    rows = similar_texts()
    texts = dict(rows)
    pairs = [(a, b) for a, _ in rows for b, _ in rows if a < b and a // 100 == b // 100]
    assert any(0.7 < jaccard(texts[a], texts[b]) < 0.8 for a, b in pairs) and any(0.8 <= jaccard(texts[a], texts[b]) < 0.85 for a, b in pairs)
    want = brute.components([d for d, _ in rows], lambda a, b: a // 100 == b // 100 and jaccard(texts[a], texts[b]) >= 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (2, 32):  # 2: groups of three and more take the second pass
        monkeypatch.setattr(simhash, "SMALL", small)
        got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, **NEAR).collect()}
        assert got == want


def test_no_link_of_a_dense_group_is_lost(spark, monkeypatch):
    """250 texts of 300 words, each with 26 words of its own somewhere: hardly any pair reaches 0.8, and all that do are connected."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(250):
        at = r.randrange(275)
        rows.append((k, " ".join(base[:at] + [f"d{k}x{i}" for i in range(26)] + base[at + 26 :])))
    linked = brute.similar(rows, 5, 0.8)
    want = brute.components([d for d, _ in rows], lambda a, b: (b, a) in linked)
    assert 100 < len(linked) < 3000 and 10 < len(set(want.values())) < 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, most in ((2048, 80), (40, 80), (40, 1)):  # one block; several; more than may be, so that keys are used once more
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "MOST_BLOCKS", most)
        got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, **NEAR).collect()}
        assert got == want


def test_short_texts_are_compared_exactly(spark):
    """Texts of up to nine shingles, one of which may be missing at either end."""
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(g % 13 + 1)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words[1:])), (10 * g + 2, " ".join(words[:-1])), (10 * g + 3, " ".join([*words, "more"]))]
    linked = brute.similar(rows, 5, 0.8)
    want = brute.components([d for d, _ in rows], lambda a, b: (b, a) in linked)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **NEAR).collect()}
    assert len(linked) > 60 and got == want


def test_pairs_of_a_cluster_once(spark, monkeypatch):
    """All pairs of different components within the budget, by blocks of any size, each once."""
    monkeypatch.setattr(simhash, "BLOCK", 7)
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, (5, 2), dtype=np.uint64)
    rows = []
    for k in range(70):
        fp = base[k % 5].copy()
        for bit in r.integers(0, 128, 6):
            fp[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        rows.append((int(r.integers(-(2**62), 2**62)), fp.astype(">u8").tobytes(), int(r.integers(80, 120)), k % 11, k % 3, -(-24 // 7)))
    df = spark.createDataFrame(rows, "node long, fp binary, n int, comp long, cluster long, blocks int")
    bits = lambda x, y: bin(int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).count("1")
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if a[4] == b[4] and a[3] != b[3] and bits(a[1], b[1]) <= 12 and min(a[2], b[2]) >= 0.8 * max(a[2], b[2]))
    assert sorted(tuple(x) for x in simhash.apart(df, 2, 12, 0.8).collect()) == want and len(want) > 20
