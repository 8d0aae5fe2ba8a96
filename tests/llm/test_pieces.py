import random

import pytest

from florilex.llm import pieces


@pytest.fixture(scope="module")
def proto(spark):
    return pieces.model_bytes(spark)


def texts(seed, n):
    r = random.Random(seed)
    words = ["international", "the", "aaaa", "a", "understanding", "éàü", "日本語", "鿿͸", "x1y2", "----------------", "\n\n", "  ", "\t", "==", "https://ex.org/a?b=c", "SpringFramework", "🎉"]
    out = []
    for _ in range(n):
        sep = r.choice([" ", "", "  "])
        out.append(sep.join(r.choice(words) for _ in range(r.randrange(20, 120))))
    return out


def test_chunked_equals_library(proto):
    p = pieces.Pieces(proto)
    for s in texts(1, 60) + ["a" * 500, " " * 300, "ab" * 300, "▁" * 90]:
        n = pieces.SPACE + s.replace(" ", pieces.SPACE)
        for size in (17, 40, 150):
            at = pieces.cuts(len(n), size)
            path = pieces.solve([p.transfer(n, a, b, a == 0) for a, b in zip(at, at[1:], strict=False)])
            ids = [i for a, b, x, y in zip(at, at[1:], path, path[1:], strict=False) for i in p.backtrace(n, a, b, x, y)]
            assert ids == p.sp.encode(s), (s, size)


def test_combination_is_associative(proto):
    p = pieces.Pieces(proto)
    n = pieces.SPACE + texts(5, 1)[0].replace(" ", pieces.SPACE)
    at = pieces.cuts(len(n), 30)
    m = [p.transfer(n, a, b, a == 0) for a, b in zip(at, at[1:], strict=False)][:3]
    assert pieces.combine(pieces.combine(m[0], m[1]), m[2]) == pieces.combine(m[0], pieces.combine(m[1], m[2]))


def test_packed_matrices(proto):
    p = pieces.Pieces(proto)
    for s in texts(7, 5):
        n = pieces.SPACE + s.replace(" ", pieces.SPACE)
        at = pieces.cuts(len(n), 40)
        for a, b in zip(at, at[1:], strict=False):
            m = p.transfer(n, a, b, a == 0)
            got = pieces.unpacked(pieces.packed(m))
            assert got == {"entries": [tuple(x) for x in m["entries"]], "exits": [tuple(x) for x in m["exits"]], "rows": m["rows"]}


def test_tree_of_combinations_equals_one_walk(spark, proto, monkeypatch):
    """Chunks over several levels of the tree: the states at all cuts are those of one walk from left to right."""
    monkeypatch.setattr(pieces, "RADIX", 2)
    p, rows, want = pieces.Pieces(proto), [], {}
    for k, s in enumerate(texts(8, 6)):
        n = pieces.SPACE + s.replace(" ", pieces.SPACE)
        at = pieces.cuts(len(n), (30, 60, 200, 5000)[k % 4])
        m = [p.transfer(n, a, b, a == 0) for a, b in zip(at, at[1:], strict=False)]
        path = pieces.solve(m)
        rows += [(k, j, bytearray(pieces.packed(x))) for j, x in enumerate(m)]
        want |= {(k, j): [*a, *b] for j, (a, b) in enumerate(zip(path, path[1:], strict=False))}
    got = pieces.scanned(spark.createDataFrame(rows, "_fx_row long, _fx_chunk int, matrix binary")).collect()
    assert {(x._fx_row, x._fx_chunk): x.states for x in got} == want and max(j for _, j in want) > 16


def test_query_against_library(spark, proto):
    p = pieces.Pieces(proto)
    rows = [(k, t) for k, t in enumerate(texts(2, 30))] + [(90, ""), (91, None), (92, "a▁b"), (93, "long " * 30_000), (93, "long " * 30_000), (None, "x"), (94, "y" * 120_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'a' as matrix")
    got = sorted(((x.doc_id, x.n_tokens, x.exact) for x in pieces.op_query(df).collect()), key=repr)
    assert got == sorted(((d, len(p.sp.encode(t or "")), "▁" not in (t or "")) for d, t in rows), key=repr)
    ids = {x.doc_id: list(x.ids) for x in pieces.encode(df.select("doc_id", "text"), proto, ["doc_id"], giant=200).collect()}
    assert all(ids[d] == p.sp.encode(t or "") for d, t in rows)
    assert all(x.ids == p.sp.encode(dict(rows)[x.doc_id] or "") for x in pieces.op_query(df.where("doc_id < 30"), keep_ids=True).collect())
    assert pieces.op_query(df.limit(0)).collect() == []
