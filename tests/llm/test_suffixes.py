import hashlib
import random

import numpy as np
import pytest

from florilex.llm import suffixes


def expected(rows, match=50):
    first = {}
    for d, t in rows:
        raw, rank = (t or "").encode(), suffixes.LAST if d is None else d
        for i in range(len(raw) - match + 1):
            w = raw[i : i + match]
            first[w] = min(first.get(w, rank), rank)
    out = []
    for d, t in rows:
        raw, rank = (t or "").encode(), suffixes.LAST if d is None else d
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - match + 1):
            if first[raw[i : i + match]] < rank:
                gone[i : i + match] = True
        n_spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        kept = bytes(x for x, g in zip(raw, gone, strict=False) if not g)
        out.append((d, len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    t = r.integers(0, 4, 300).astype(np.uint16)
    if seed == 2:
        t = np.where(t == 3, 300, t).astype(np.uint16)
    if seed == 3:
        t = np.concatenate([np.full(40, 2), [0], np.full(30, 2), [3], np.tile([1, 2], 30), [0]]).astype(np.uint16)
    sa = suffixes.suffix_array(t, 400)
    assert sorted(sa.tolist()) == list(range(len(t)))

    def key(i):
        s = t[i:].tolist()
        return s[: s.index(0) + 1] if 0 in s else s

    assert [key(i) for i in sa.tolist()] == sorted(key(i) for i in range(len(t)))


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["alpha", "béta", "gamma", "delta", "x", "yy", "\n", "omega"]
    prose = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [prose(r.randrange(8, 60)) for _ in range(8)]
    rows = []
    for k in range(n):
        parts = [r.choice(shared) if r.random() < 0.5 else prose(r.randrange(1, 40)) for _ in range(r.randrange(0, 5))]
        rows.append((k, r.choice(["", " "]).join(parts)))
    rows += [(n + i, rows[i][1]) for i in range(0, n, 5)]
    r.shuffle(rows)
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'a' as blob")
    assert sorted((tuple(x) for x in suffixes.op_query(df).collect()), key=repr) == expected(rows)


def test_against_brute_force(spark):
    check(spark, corpus(1, 60) + [(900, None), (901, ""), (902, "a" * 49), (903, "a" * 50), (904, "a" * 170), (None, "a" * 120), (None, "béta " * 30), (905, "béta " * 12), (905, "béta " * 12), (905, "béta " * 11)])


def test_pieces_and_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 300)
    monkeypatch.setattr(suffixes, "CROWDED", 3)
    monkeypatch.setattr(suffixes, "ARRAY_BYTES", 2000)
    check(spark, corpus(2, 50) + [(1000 + k, f"{k} a very common passage that well over sixty-four documents of this table share {k % 3}") for k in range(150)])


def test_empty(spark):
    assert suffixes.op_query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_by_way_of_groups_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 3000)
    monkeypatch.setattr(suffixes.gathered_anchors, "__defaults__", (4,))
    check(spark, corpus(6, 40) + [(1000 + k, f"{k} a very common passage that well over sixty-four documents of this table share {k % 3}") for k in range(80)])


def test_very_long_text(spark):
    r = random.Random(7)
    long = " ".join(str(r.randrange(10**6)) for _ in range(120_000))
    check_rows = [(1, long), (2, "own words before " + long[400_000:400_300] + " and after"), (3, long[:1000])]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffixes.op_query(spark.createDataFrame(check_rows, "doc_id long, text string")).collect()}
    assert got == {x[0]: tuple(x[1:4]) for x in expected(check_rows)}
