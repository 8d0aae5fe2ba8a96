import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import islice

from florilex.llm import resample


def tokens(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain(docs, target, percent=10, least=20, most=1, buckets=10_000, seed=2024):
    """doc_id, n_features, weight, score, rank of each document, in the order of documents."""
    runs = lambda text: [b" ".join(w[k : k + n]) for w in [tokens(text)] for n in range(1, most + 1) for k in range(len(w) - n + 1)]
    found = [[zlib.crc32(f) % buckets for f in runs(text)] for _, text in docs]
    s, t = Counter(b for x in found for b in x), Counter(zlib.crc32(f) % buckets for text in target for f in runs(text))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for (doc_id, _), x in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append([doc_id, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    eligible = [k for k, (_, text) in enumerate(docs) if len(tokens(text)) >= least]
    eligible.sort(key=lambda k: (-out[k][3], math.inf if out[k][0] is None else out[k][0]))
    for rank, k in enumerate(eligible[: percent * len(eligible) // 100]):
        out[k][4] = rank + 1
    return [tuple(x) for x in out]


def corpus(seed, n):
    r = random.Random(seed)
    words = ["Quantum", "the", "É", "naïve", "x1", "42", "日本", "of"] + [f"w{k}" for k in range(300)]
    return [(k, " ".join(r.choices(words, k=r.randrange(60)))) for k in range(n)], [" ".join(r.choices(words[:40], k=12)) for _ in range(30)]


def frames(spark, docs, target):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rank", "'x' AS score", "2 AS weight", "3 AS row", "0 AS key")
    return d.repartition(5), spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "1 AS doc_id")


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_against_plain(spark):
    docs, target = corpus(1, 700)
    odd = [(None, None), (None, "word " * 25), (9001, ""), (9002, "- 's \x00"), (5, docs[5][1]), (9003, "same " * 30), (9003, "same " * 30)]
    d, t = frames(spark, docs + odd, [*target, None, ""])
    out = resample.op_query(d, t)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want, found = plain(docs + odd, [*target, None, ""]), got(out)
    assert sorted((x[:4] for x in want), key=repr) == sorted((x[:4] for x in found), key=repr)
    assert sorted((x[4], x[0]) for x in want if x[4]) == sorted((x[4], x[0]) for x in found if x[4])


def test_ranges_segments_and_runs(spark, monkeypatch):
    """Many ranges, segments of three rows, whatever part is drawn; runs of up to three words."""
    for name, value in (("SEGMENT", 3), ("RANGE", 20), ("SAMPLE", 90)):
        monkeypatch.setattr(resample, name, value)
    docs, target = corpus(2, 400)
    d, t = frames(spark, docs, target)
    for percent in (0, 1, 37, 100):
        assert got(resample.resample(d, t, percent=percent, least=5, most=3, buckets=512, seed=7)) == sorted(plain(docs, target, percent, 5, 3, 512, 7), key=repr)


def test_ties_go_to_the_smaller_number(spark):
    scores = spark.createDataFrame([(k, 1000 - k, 5) for k in range(900)] + [(900 + k, k, 4) for k in range(100)], "row long, doc_id long, score long").repartition(6)
    out = {x["row"]: x["rank"] for x in resample.drawn(scores, 905, 1000).collect()}
    assert out == {k: 900 - k for k in range(900)} | {900 + k: 901 + k for k in range(5)}


def test_tournament_and_merge(monkeypatch):
    r = random.Random(3)
    runs = [sorted(r.randrange(1000) for _ in range(r.randrange(1, 60))) for _ in range(37)]
    tree = resample.Tournament()
    rest = {tree.open((x[0], k)): (iter(x[1:]), k) for k, x in enumerate(runs)}
    out = []
    while (best := tree.least())[1] is not None:
        leaf, (value, k) = best
        out.append(value)
        following = next(rest[leaf][0], None)
        tree.put(leaf, None if following is None else (following, k))
    assert out == sorted(v for x in runs for v in x)
    segments = sorted([[(v, k, i + j) for j, v in enumerate(x[i : i + 4])] for k, x in enumerate(runs) for i in range(0, len(x), 4)])
    taken = []
    lazily = resample.merged((taken.append(x) or x) for x in segments)
    assert [x[0] for x in islice(lazily, 20)] == out[:20] and len(taken) < len(segments) / 3
    assert [x[0] for x in lazily] == out[20:]


def test_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(resample.WORDS.lists.__func__, "__defaults__", (10,))
    text = b"aa bbb cc dddddddddddddddddddd e ff g hh iii"
    words, runs = zip(*resample.features(text, 3), strict=True)
    w = text.split()
    assert sum(words) == len(w) and sorted(f for x in runs for f in x) == sorted(b" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))


def test_empty_and_very_long(spark):
    docs, target = corpus(4, 3)
    d, t = frames(spark, docs, target)
    assert got(resample.op_query(d.limit(0), t)) == []
    assert got(resample.op_query(d, t.limit(0))) == sorted(plain(docs, []), key=repr)
    long = [(1, "lorem Ipsum " * 400_000), (2, "x")]
    d, t = frames(spark, long, target)
    assert got(resample.resample(d, t, percent=100)) == sorted(plain(long, target, 100), key=repr)
