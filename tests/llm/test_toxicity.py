import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from florilex.llm import toxicity

SF = "/root/testdata/sf0.001"


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for k in range(n):
        sentences = [" ".join(r.choice(vocab) for _ in range(8)) for _ in range(r.randrange(1, 6))]
        toxic = r.random() < 0.3
        if toxic:
            at = r.randrange(len(sentences))
            sentences[at] += r.choice([" nasty", " vilest", " horrid"])
        rows.append((k, ". ".join(sentences) + "."))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_place(spark):
    rows, labels = corpus(900, 1)
    docs = spark.createDataFrame(rows + [(9000, ""), (9001, None), (None, "nasty word")], "doc_id long, text string").selectExpr("*", "'x' as score", "1 as toxic")
    lab = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.op_query(docs, lab).collect()}
    assert len(got) == 903 and got[9000].score == got[9001].score == 0
    want = {d: t for d, _, t in labels}
    held = [d for d in want if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (d in set(held)) for d in want)
    assert sum(got[d].predicted == want[d] for d in held) / len(held) > 0.97
    texts = dict(rows)
    hits = [d for d in held if want[d] and got[d].predicted]
    assert all(any(w in texts[d][got[d].worst_start : got[d].worst_end] for w in ("nasty", "vilest", "horrid")) for d in hits)


def plain(text, weights, bias):
    """The noisy-or of a text, written out."""
    p = lambda z: 1 / (1 + math.exp(-z))
    none = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        names = {f for w in re.findall(r"[^\W_]+", sentence.lower()) for f in [f"={w}", *(w[:k] for k in range(3, 8) if k <= len(w))]}
        z = bias + sum(weights.get(f, 0) for f in names)
        if z > bias + toxicity.MARGIN:
            none *= 1 - p(z)
    return 1 - none


def test_against_plain_scores(spark):
    model = ({"=bad": 9.0, "awf": 5.5, "=fine": -1.0, "the": 0.5}, -6.0)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [(x.doc_id, x.text) for x in docs.collect()] + [(-1, "fine. bad! fine"), (-2, "awful and fine\nthe bad"), (-3, None), (-4, "the the")]
    got = {x.doc_id: x for x in toxicity.scored(spark.createDataFrame(some, "doc_id long, text string"), *model).collect()}
    assert all(abs(got[d].score - plain(t, *model)) < 1e-9 for d, t in some)
    assert got[-1].score > 0.9 and (got[-1].worst_start, got[-1].worst_end) == (5, 9) and got[-3].score == got[-4].score == 0


def test_labels_of_the_tables(spark):
    """Held-out documents of a real table, and of texts without offence one of some MB."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("text", "toxic", toxicity.held_out().alias("held")).collect()
    scorer = toxicity.Scorer(*toxicity.fit([(x.text, x.toxic) for x in rows if not x.held]))
    scores = [(scorer.document(x.text)[0], x) for x in rows]
    good, bad = [s for s, x in scores if x.held and x.toxic], [s for s, x in scores if x.held and not x.toxic]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.95
    assert (sum(s >= 0.5 for s in good) + sum(s < 0.5 for s in bad)) / len(good + bad) > 0.97
    long = "\n".join(x.text for s, x in scores if not x.toxic and not s)
    assert len(long) > 3_000_000 and scorer.document(long)[0] == 0
    toxic = next(x.text for s, x in scores if x.toxic and s > 0.9)
    assert scorer.document(long + "\n" + toxic)[0] > 0.9


def test_sample_without_one_kind_is_an_error(spark):
    docs = spark.createDataFrame([(0, "nasty " * 2000), (2, "fine words"), (3, "more words")], "doc_id long, text string")
    lab = spark.createDataFrame([(0, 1, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").where(~toxicity.held_out())
    if lab.select("toxic").distinct().count() == 2:
        with pytest.raises(ValueError):
            toxicity.training_rows(docs, lab, 10, 1000)


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.score for x in toxicity.op_query(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.op_query(docs.limit(0), none).collect() == []


def test_bounded_sample(spark):
    rows, labels = corpus(200, 2)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(docs, lab, 50, 2000)
    assert 0 < sum(len(t) for t, _ in got) <= 2000 and len(got) <= 50


def test_giant_texts_do_not_end_the_sample(spark):
    rows, labels = corpus(200, 3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first = next(x.doc_id for x in lab.orderBy(F.xxhash64("doc_id")).collect() if zlib.crc32(str(x.doc_id).encode()) % 5)
    docs = spark.createDataFrame([(d, "giant " * 1000 if d == first else t) for d, t in rows], "doc_id long, text string")
    got = [len(t) for t, _ in toxicity.training_rows(docs, lab, 200, 4000)]
    assert 3500 < sum(got) <= 4000 and max(got) <= 1000


def plain_fit(rows, vocab, rounds, rate=0.1, l1=5e-5):
    """Training written out, sentence by sentence: first all sentences count, then those beyond the margin, and the worst one of a toxic text without any."""
    names = lambda s: {f for w in re.findall(r"[^\W_]+", s.lower()) for f in toxicity.features(w)} & set(vocab)
    bags = [[names(s) for s in re.findall(r"[^.!?\n]+", text)] for text, _ in rows]
    state = {f: [0.0, 0.0, 0.0] for f in vocab} | {"": [-6.0, 0.0, 0.0]}
    for t in range(1, rounds + 1):
        grad = {f: l1 * ((state[f][0] > 0) - (state[f][0] < 0)) for f in vocab} | {"": 0.0}
        for bag, (_, y) in zip(bags, rows, strict=True):
            z = [state[""][0] + sum(state[f][0] for f in s) for s in bag]
            counts = [True] * len(z)
            if t > rounds / 2:
                counts = [v > state[""][0] + toxicity.MARGIN for v in z]
                own = [k for k, s in enumerate(bag) if s]
                if y and own and not any(counts):
                    counts[max(own, key=lambda k: (z[k], -k))] = True
            none = sum(math.log1p(math.exp(v)) for v, c in zip(z, counts, strict=True) if c)
            pull = -1 / math.expm1(max(none, 1e-9)) if y else 1.0
            for s, v, c in zip(bag, z, counts, strict=True):
                for f in [*s, ""] if c else ():
                    grad[f] += pull / (1 + math.exp(-v)) / len(rows)
        for f, g in grad.items():
            x = state[f]
            x[1], x[2] = 0.9 * x[1] + 0.1 * g, 0.999 * x[2] + 0.001 * g * g
            x[0] -= rate * (x[1] / (1 - 0.9**t)) / (math.sqrt(x[2] / (1 - 0.999**t)) + 1e-8)
    return {f: x[0] for f, x in state.items()}


def test_fit_against_a_plain_version():
    found, labels = corpus(150, 6)
    rows = [(text, toxic) for (_, text), (_, _, toxic) in zip(found, labels, strict=True)]
    for rounds in (10, 60):
        weights, bias = toxicity.fit(rows, rounds=rounds)
        want = plain_fit(rows, list(weights), rounds) if rounds == 10 else None
        if want:  # features whose weight is no more than 0.001 aren't returned, and all others are
            assert abs(bias - want[""]) < 1e-6 and all(abs(w - want[f]) < 1e-6 for f, w in weights.items())
    long = toxicity.Scorer(weights, bias).document(". ".join(t for t, y in rows if not y) * 200)
    assert len(weights) > 3 and any("nasty".startswith(f.strip("=")) for f in weights) and long[0] < 0.5


def test_training_goes_on_with_what_counts():
    """With more rounds the plain version still agrees, beyond the point from which not all sentences count."""
    rows = [(f"w{k} is fine. {'a nasty word' if k % 3 == 0 else 'a clean word'}. end {k}", k % 3 == 0) for k in range(60)] + [("nothing to see", 1), ("", 0), (" . ", 1)]
    weights, bias = toxicity.fit(rows, rounds=80)
    vocab = {f for f, w in weights.items()}
    want = plain_fit(rows, vocab, 80)
    assert len(vocab) > 3 and abs(bias - want[""]) < 1e-6 and all(abs(w - want[f]) < 1e-6 for f, w in weights.items())
