import random
import re
from collections import Counter

from florilex.llm import divergence


def plain(rows, least=3, top=200):
    """Term by term in whole numbers."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == lang]
        df = Counter(t for x in mine for t in set(x[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter(t for x in mine if x[1] == s for t in x[2] if t in kept) for s in {x[1] for x in mine}}
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b, t: (p(a, t) - p(b, t)) ** 2 // p(b, t)
        for s, c in counts.items():
            pairs = [(-sum(f(c, d, t) for t in kept), o.encode()) for o, d in counts.items() if o != s]
            terms = [(-f(c, whole, t), t.encode()) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(found)) if part == "pair" or k < top}
    return out


def rows(seed, n=120, sources=7):
    r = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "éta", "Ünder", "x", "日本", "k'q", "a1b"] + [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(80)]
    source = lambda: "hot" if r.random() < 0.4 else f"s{r.randrange(sources)}"
    return [(" ".join(r.choices(words, k=r.randrange(40))), r.choice(["en", "de"]), source()) for _ in range(n)]


ODD = [(None, "en", "hot"), ("", "en", "none"), ("alpha beta", None, None), ("alpha 12 beta!", None, ""), ("alpha-alpha", "", None), ("solo word", "fr", "s1"), ("alpha", "en", "S0"), ("alpha", "en", "S0"), ("... 123", "it", "a"), ("", "it", "b"), ("\x00\x41\x7f", "en", "é"), ("🙂 🙂", "en", "é")]


def frame(spark, found):
    return spark.createDataFrame(found, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS value", "'x' AS item", "'y' AS chunk", "0 AS block")


def test_against_whole_numbers(spark):
    for seed, more in ((1, []), (2, ODD)):
        found = rows(seed) + more
        out = divergence.audit(frame(spark, found), top=9)
        assert {tuple(x) for x in out.collect()} == plain(found, top=9)
        assert out.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_many_blocks_and_packs(spark, monkeypatch):
    """Blocks of two groups, packs of a few terms, tiles that take them a few at a time."""
    monkeypatch.setattr(divergence, "CHUNKS", 3)
    monkeypatch.setattr(divergence, "CELLS", 5)
    found = rows(3, 200, 9) + ODD
    got = [tuple(x) for x in divergence.audit(frame(spark, found), side=2, width=4).collect()]
    assert set(got) == plain(found) and len(got) == len(set(got))


def test_very_long_text_and_empty_table(spark, monkeypatch):
    found = [("alpha beta " * 300_000 + "gamma", "en", "a"), ("gamma beta", "en", "b"), ("beta gamma", "en", "b")]
    assert {tuple(x) for x in divergence.op_query(frame(spark, found)).collect()} == plain(found)
    assert divergence.op_query(frame(spark, found).limit(0)).count() == 0


def test_large_counts_are_exact():
    import numpy as np

    counts, totals, v = np.array([[10**15 * 8, 3, 0], [7, 10**12, 10**12]]), np.array([8 * 10**15 + 9, 10**13]), 12345
    want = [[1 + 10**9 * (int(c) + 1) // (int(t) + v) for c in row] for row, t in zip(counts, totals, strict=True)]
    assert divergence._shares(counts, totals, v).tolist() == want


def test_decimal_shares_are_exact(spark):
    found = spark.createDataFrame([(8 * 10**15, 8 * 10**15 + 9, 12345), (0, 0, 1), (10**12, 10**13, 7)], "n long, t long, v long").select("n", "t", "v", divergence.share("n", "t", "v").alias("p")).collect()
    assert all(x.p == 1 + 10**9 * (x.n + 1) // (x.t + x.v) for x in found)
