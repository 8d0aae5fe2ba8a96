import numpy as np
import pytest
from pyspark.sql import functions as F

from florilex.llm import neighbours as nn


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute(rows, k=10, every=100):
    """By id: the k nearest ids with their distances; an id's distance is that of its nearest vector."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    out = {}
    for i, v in usable:
        if i % every == 0:
            for j, w in usable:
                if j != i:
                    out.setdefault(i, {}).setdefault(j, []).append(float(np.sqrt(((v - w) ** 2).sum())))
    return {i: [(j, x) for x, j in sorted((min(x), j) for j, x in far.items())[:k]] for i, far in out.items()}


def got(df):
    out = {}
    for x in sorted(df.collect(), key=lambda x: (x["query_id"], x["rank"])):
        out.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
        assert len(out[x["query_id"]]) == x["rank"]
    return out


def close(a, b):
    return a.keys() == b.keys() and all([j for j, _ in a[i]] == [j for j, _ in b[i]] and np.allclose([x for _, x in a[i]], [x for _, x in b[i]], atol=1e-9) for i in a)


def test_encoding_adds_up(spark):
    """Codes and remainder add up to the vector; a wider beam doesn't lose, and with one codebook the code is that of the nearest codeword."""
    rng = np.random.default_rng(3)
    x, books = rng.normal(size=(300, 12)).astype(np.float32), rng.normal(size=(4, 20, 12)).astype(np.float32) / np.array([1, 2, 4, 8], np.float32)[:, None, None]
    error = []
    for beam in (1, 4, 400):
        codes, left = nn.encode(x, books, beam)
        assert np.allclose(sum(b[c] for b, c in zip(books, codes.T, strict=True)) + left, x, atol=1e-5)
        error.append((left**2).sum())
    assert error[0] > error[1] >= error[2]
    codes, _ = nn.encode(x, books[:1])
    assert (codes[:, 0] == ((x[:, None] - books[0]) ** 2).sum(2).argmin(1)).all()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 24)).round(3)
    x[300:1600] = x[300]  # a third is one vector
    x[2000:2040] = x[2000] + rng.normal(size=(40, 24)).round(3) * 1e-3  # near copies
    return [(k, v) for k, v in enumerate(x.tolist())]


def test_recall_and_exact_scores(spark, vectors):
    rows = nn.usable(frame(spark, vectors))
    found, true = got(nn.neighbours(rows, F.col("vec_id") % 100 == 0, shortlist=100)), brute(vectors)
    scores = {i: {j: x for j, x in v} for i, v in brute(vectors, 4000).items()}
    assert found.keys() == true.keys() and all(abs(scores[i][j] - x) < 1e-9 for i, v in found.items() for j, x in v)
    assert sum(len({j for j, _ in found[i]} & {j for j, _ in true[i]}) for i in true) >= 0.9 * 10 * len(true)
    assert found[400] == [(j, 0.0) for j in range(300, 310)] and found[300] == [(j, 0.0) for j in range(301, 311)]


def test_exact_search_needs_no_shortlist(spark, vectors):
    rows = nn.usable(frame(spark, vectors[:1800]))
    found = nn.neighbours(rows, F.col("vec_id") % 100 == 0, shortlist=1, block=7, exact=True)
    assert close(got(found), brute(vectors[:1800]))


def test_what_takes_part(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [-0.0, 2.0]), (9, [1.0, 0.0]), (9, [5.0, 5.0]), (100, [0.0, 2.0]), (100, [3.0, 3.0])]
    df = frame(spark, rows).selectExpr("*", "1 AS rank", "'x' AS score", "2 AS query_id", "'y' AS vector", "0 AS ids")
    out = nn.op_query(df)
    assert close(got(out), brute(rows)) and [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "double"]
    assert nn.op_query(df.limit(0)).count() == 0 and nn.op_query(df.where("vec_id = 8")).count() == 0
    assert got(nn.op_query(df.where("vec_id = 0"))) == {}


def test_floats_and_few_candidates(spark):
    df = frame(spark, [(100 * k, [k / 3, 1.0]) for k in range(4)]).withColumn("embedding", F.col("embedding").cast("array<float>"))
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    assert close(got(nn.op_query(df)), brute(rows)) and all(len(v) == 3 for v in got(nn.op_query(df)).values())


def test_recall_on_the_embeddings(spark):
    """Of 2,000 vectors with hardly any structure, by the shortlist that the query has."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    true = brute([(x.vec_id, x.embedding) for x in df.collect()])
    found = got(nn.op_query(df))
    hits = sum(len({j for j, _ in found[i]} & {j for j, _ in true[i]}) for i in true)
    assert hits >= 0.98 * sum(map(len, true.values()))


def _rows(kind, n=3000, width=24):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, width))
    if kind == "lengths":  # of many magnitudes: codebooks are taken up by the long ones
        x *= np.exp(4 * rng.normal(size=(n, 1)))
    elif kind == "clusters":  # of more vectors than a shortlist has
        x = rng.normal(size=(3, width))[rng.integers(0, 3, n)] + 1e-4 * x
    elif kind == "far":  # from the origin
        x += 1e5
    elif kind == "one huge":
        x[5] *= 1e200
    return [(k, v) for k, v in enumerate(x.tolist())]


@pytest.mark.parametrize("kind", ["plain", "lengths", "clusters", "far", "one huge"])
def test_nothing_nearer_is_missed(spark, kind):
    """On vectors that a short list of codes tells badly apart."""
    rows = _rows(kind)
    found = nn.neighbours(nn.usable(frame(spark, rows)), F.col("vec_id") % 100 == 0, shortlist=20)
    assert close(got(found), brute(rows))
