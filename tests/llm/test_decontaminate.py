import random
from collections import Counter

import numpy as np

from florilex.llm import decontaminate as dc


def brute(docs, items):
    out = {}
    for d, t in docs:
        seq = dc.words(t)
        for item, text in items:
            q = dc.words(text)
            if not q or not seq or (len(q) < 5 and len(seq) < len(q)):
                continue
            m, g = min(len(q), len(seq)), min(5, len(q), len(seq))
            grams = lambda s, n: Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
            if len(seq) < 5 <= len(q):
                continue
            y = grams(q, g)
            for i in range(len(seq) - m + 1):
                x = grams(seq[i : i + m], g)
                s = sum((x & y).values()) / sum((x | y).values())
                if s >= 0.8 and s > out.get((d, item), 0):
                    out[d, item] = s
    return out


def tables(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é,", "(it)", "The"]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(prose(r.randrange(12, 60)))) for k in range(25)] + [(90, "just three words"), (91, "five words make one shingle"), (92, ""), (93, None), (94, "...")]
    docs = []
    for k in range(400):
        words = prose(r.randrange(0, 60))
        if k % 4:
            q = r.choice(items[:27])[1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                if len(q) > 12:
                    q[r.randrange(len(q))] = "other"
            at = r.randrange(len(words) + 1)
            words = words[:at] + [w.upper() + "!" for w in q] + words[at:]
        docs.append((k, " \n".join(words)))
    return docs + [(900, None), (901, ""), (902, items[3][1]), (903, " ".join(items[4][1].split()[:-1]))], items


def test_against_brute_force(spark):
    docs, items = tables(4)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as similarity")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in dc.op_query(d, b).collect()}
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(want) > 40 and len(got) >= 0.99 * len(want)
    assert {k for k, v in want.items() if v > 0.9} <= set(got)
    kept = {x.doc_id for x in dc.clean(d, b).collect()}
    assert kept == {x for x, _ in docs} - {x for x, _ in got}
    assert dc.clean(d, b).columns == d.columns


def test_blocks_of_items_and_empty_tables(spark):
    docs, items = tables(5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(x) for x in dc.contaminated(d, b).collect()}
    assert {tuple(x) for x in dc.contaminated(d, b, 1500).collect()} == whole
    assert dc.contaminated(d, b.limit(0)).collect() == [] and dc.contaminated(d.limit(0), b).collect() == []
    assert dc.clean(d, b.limit(0)).count() == len(docs)


def test_null_ids_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b c d e f g h i j k l"), (8, "a b c d e f g h i j k l")], "item_id long, text string")
    got = sorted(((x.doc_id, x.item_id) for x in dc.op_query(d, b).collect()), key=repr)
    assert got == sorted([(None, 7), (None, 8), (1, 7), (1, 8), (1, 7), (1, 8)], key=repr)


def test_very_long_text_and_pieces(spark, monkeypatch):
    docs, items = tables(6)
    long = " ".join(t for _, t in docs if t)
    d = spark.createDataFrame([(1, long)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {x.item_id: (round(x.similarity, 9), x.first_word, x.n_words) for x in dc.op_query(d, b).collect()}
    finder = dc.Finder(items)
    monkeypatch.setattr(dc, "PIECE", 900)
    assert {items[n][0]: (round(s, 9), at, w) for n, s, at, w in finder.hits(long)} == got and len(got) > 15
    assert [w for base, seq in finder.pieces(long) for w in seq[-1:]][-1] == dc.words(long)[-1]


def test_what_the_multi_index_passes():
    """All fingerprints within the radius, and few others."""
    r = np.random.default_rng(3)
    shingles = [r.integers(0, 2**63, 60).astype(np.uint64) for _ in range(400)]
    c = dc.SizeClass(64, list(range(400)), shingles)
    assert min(b - a for a, b, *_ in c.blocks) >= 14
    far = r.integers(0, 2, (300, dc.BITS)).astype(np.uint8)
    assert len(c.met(far)) < 0.25 * 300 * 400
    close = c.prints[:300].copy()
    for k in range(300):
        close[k, r.choice(dc.BITS, dc.RADIUS, replace=False)] ^= 1
    w, i = c.near(close)
    assert {(k, k) for k in range(300)} <= set(zip(w.tolist(), i.tolist(), strict=True))


def test_recall_at_the_least_similarity():
    r, hit, total = random.Random(8), 0, 0
    for _ in range(300):
        item = [f"w{r.randrange(5000)}" for _ in range(45)]
        text = list(item)
        text[0] = text[1] = text[2] = text[3] = "other"  # four shingles: 37 / 45 = 0.82
        got = dc.Finder([(1, " ".join(item))]).hits(" ".join(["before"] + text + ["after"]))
        total += 1
        hit += bool(got)
    assert hit >= 0.99 * total
