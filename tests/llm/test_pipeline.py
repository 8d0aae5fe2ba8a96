import pytest
import sentencepiece

import corpus_pipeline as cp
from florilex.llm import pieces, simhash, toxicity

from . import brute
from .test_decontaminate import brute as leaks
from .test_lines import expected as removed_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows, on some documents of the smallest table."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500")
    out = []
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{top}/{k}")
        after = spark.read.parquet(f"{top}/{k}")
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def texts(rows):
    return [(x.doc_id, x.text) for x in rows]


def test_names_and_columns(stages):
    assert [n for n, *_ in stages] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece"]
    assert all(a == b for _, _, _, a, b in stages[:4])


def test_toxicity(spark, stages):
    _, before, after, *_ = stages[0]
    docs = spark.createDataFrame(texts(before), "doc_id long, text string")
    scorer = toxicity.Scorer(*toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {x.doc_id for x in after} == {d for d, t in texts(before) if scorer.document(t)[0] < 0.5}


def test_lines(stages):
    _, before, after, *_ = stages[1]
    rows = texts(before)
    gone = dict(zip((d for d, _ in rows), removed_lines(rows), strict=True))
    assert dict(texts(after)) == {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d]) for d, t in rows}
    assert all(x.n_chars == len(x.text) for x in after)


def test_near_duplicates(stages):
    _, before, after, *_ = stages[2]
    linked = brute.similar(texts(before), 5, 0.8)
    assert {x.doc_id for x in after} == set(brute.components(sorted(d for d, _ in texts(before)), lambda a, b: (b, a) in linked).values())


def test_recall_of_near_duplicates(spark):
    """All pairs of documents of a table whose exact similarity reaches 0.8: nearly all are in one group, and no group is larger than they make it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = texts(docs.collect())
    linked = brute.similar(rows, 5, 0.8)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs, **cp.NEAR).collect()}
    want = brute.components(sorted(got), lambda a, b: (b, a) in linked)
    found = [got[a] == got[b] for a, b in linked]
    assert len(found) > 50 and sum(found) >= 0.98 * len(found)
    assert all(want[d] == want[c] for d, c in got.items())


def test_decontamination(spark, stages):
    _, before, after, *_ = stages[3]
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {x.doc_id for x in after} == {d for d, _ in texts(before)} - {d for d, _ in leaks(texts(before), items)}


def test_tokens(stages):
    _, before, after, *_ = stages[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {x.doc_id: (x.ids, x.n_tokens, x.exact) for x in after} == {d: (sp.encode(t), len(sp.encode(t)), True) for d, t in texts(before)}


def test_null_and_empty_rows(spark, tmp_path):
    rows = [(None, "no number here", "en", "s", 14), (None, "no number here", "en", "s", 14), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "three", None, "s", 5), (3, "three", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for k, (_, stage) in enumerate(cp.STAGES):
            path = f"{tmp_path}/{empty}{k}"
            stage(spark, at, SF).write.parquet(path)
            at = spark.read.parquet(path)
        assert sorted((x.doc_id for x in at.collect()), key=repr) == ([] if empty else [1, 3, None])


def test_very_long_text_and_further_columns(spark, tmp_path):
    long = "\n".join(f"line {k} of a text that goes on and on, for {k * k} reasons" for k in range(6_000))
    rows = [(1, long, "en", "s", len(long)), (2, "quite short", "en", "s", 11), (3, long + "\nx", "en", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as score", "'d' as digest", "2 as _fx_pos", "'n' as node", "3 as h1", "4 as ids")
    names = docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        assert k == 0 or docs.columns == names
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    got = {x.doc_id: x for x in docs.collect()}
    assert got[1].n_chunks > 5 and got[1].exact and got[2].exact and got[3].n_tokens < 10


def test_near_dedup_deletes_what_it_shuffled(spark, tmp_path, monkeypatch):
    """The setting holds within the stage, and is as before after it."""
    import corpus_pipeline

    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key)
    monkeypatch.setattr(corpus_pipeline.simhash, "representatives", lambda docs, **_: seen.append(spark.conf.get(key)) or docs)
    corpus_pipeline.near_dedup(spark, spark.range(1), "")
    assert seen == ["true"] and spark.conf.get(key) == before
