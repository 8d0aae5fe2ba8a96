"""Models on workers, table functions in SQL, reports of a run, and words that arrive in pieces."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from florilex.functions import models, tables, vectors
from florilex.operators import sequence, similarity, verses
from florilex.plans import corpus
from florilex.streaming import runs


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    def load(device, folder, size):
        with open(f"{folder}/{os.getpid()}", "a") as out:
            out.write(f"{device}\n")
        return lambda texts: np.array([[len(t)] * size for t in texts], float)

    vector = models.embedding(load, str(tmp_path), 3, batch=7)
    df = spark.createDataFrame([("x" * k,) for k in range(100)] + [(None,)], "t string").repartition(3)
    got = df.select("t", vector(F.col("t")).alias("v")).collect()
    assert all(x.v == [float(len(x.t or ""))] * 3 for x in got)
    assert [(tmp_path / p).read_text() for p in os.listdir(tmp_path)] == ["cpu\n"] * len(os.listdir(tmp_path))
    assert models.device("cuda:1") == "cuda:1" and models.device() == "cpu"


def test_token_models_are_pooled_by_means(spark):
    def load(device):
        def tokenize(texts):
            ids = np.zeros((len(texts), 8), int)
            for row, t in zip(ids, texts, strict=True):
                row[: len(t)] = [ord(c) for c in t]
            return ids, ids > 0

        return models.TokenModel(lambda ids, mask: np.stack([ids, ids**2], axis=2), tokenize)

    df = spark.createDataFrame([("ab",), ("",), ("zzz",)], "t string")
    got = {x.t: x.v for x in df.select("t", models.embedding(load)(F.col("t")).alias("v")).collect()}
    assert got == {"ab": [97.5, (97**2 + 98**2) / 2], "": [0, 0], "zzz": [122, 122**2]}
    ids = F.transform(F.split("t", ""), F.ascii)
    got = {x.t: x.v for x in df.where("t <> ''").select("t", models.token_embedding(load, width=5)(ids).alias("v")).collect()}
    assert got == {"ab": [97.5, (97**2 + 98**2) / 2], "zzz": [122, 122**2]}


def test_whole_texts_by_windows(spark):
    """Texts of any length, in windows of three tokens: the mean over all tokens."""
    r = random.Random(1)
    rows = [(k, [r.randrange(1, 9) for _ in range(k)]) for k in range(12)]
    load = lambda device: models.TokenModel(lambda ids, mask: np.stack([ids, -(ids**2)], axis=2).astype(float))
    got = {x.k: x.vector for x in models.embed_whole(spark.createDataFrame(rows, "k int, ids array<int>"), "ids", load, keys=["k"], width=3).collect()}
    assert got.keys() == set(range(1, 12)) and all(np.allclose(got[k], [np.mean(v), -np.mean(np.square(v))]) for k, v in rows if v)


def test_triplets_by_a_model(spark):
    pairs = spark.createDataFrame([("in principio", "in principio erat"), ("jam", " ")], "sentence string, biblical_text string")
    texts = spark.createDataFrame([(1, "In principio erat verbum"), (2, "alia res"), (3, "")], "cand long, candidate string")
    by_model = similarity.triplets(pairs, texts, vector=models.embedding(lambda device: vectors.hashing_encoder)).collect()
    assert by_model == similarity.triplets(pairs, texts, vectors.hashing_encoder).collect() and len(by_model) == 1


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([("a", "<p>x, y<lb n='2'/>z</p>"), ("b", "<p>"), ("c", None)], "path string, xml string").createOrReplaceTempView("t_files")
    got = spark.sql("SELECT f.path, w.* FROM t_files f, LATERAL tei_words(f.xml) w").collect()
    assert [(x.path, x.pos, x.word, x.line) for x in sorted(got)] == [("a", 0, "x", None), ("a", 1, ",", None), ("a", 2, "y", None), ("a", 3, "z", "2")]
    rows = [(None, 1, "x"), ("p", 3, "b"), ("p", 1, "a"), ("p", 2, "a"), ("p", 4, None), ("p", 5, None), ("p", 6, "b")]
    spark.createDataFrame(rows, "path string, at int, v string").createOrReplaceTempView("t_rows")
    got = spark.sql("SELECT * FROM runs(TABLE(t_rows) PARTITION BY path ORDER BY (at), 'v')").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 1, "x", 1, 0, 0), ("p", 1, "a", 2, 0, 1), ("p", 2, "b", 1, 2, 2), ("p", 3, None, 2, 3, 4), ("p", 4, "b", 1, 5, 5)], key=repr)
    with pytest.raises(Exception, match="name of one of its columns"):
        spark.sql("SELECT * FROM runs(TABLE(t_rows) PARTITION BY path ORDER BY (at), 'none')").collect()


def test_reports_are_taken_on_the_way(spark, tmp_path):
    texts = spark.createDataFrame([("Matthew", 1, 2, "m2"), ("Psalms", 5, 1, "p1")], "book string, chapter int, verse int, text string")
    rows = spark.createDataFrame([("Mt", "1", "2-3", "Q", "5", "1"), ("Mt", "1", "9", "Q", "5", "1"), ("Xy", "1", "2", "A", "6", "2"), ("Mt", "", "2", "Q", "5", "1")], "nt_book string, nt_chapter string, nt_verse string, label string, ps_chapter string, ps_verse string")
    seen = Observation("parallel")
    verses.parallel_table(rows, texts, seen=seen).write.parquet(f"{tmp_path}/p")
    assert seen.get == {"n_rows": 3, "missing_nt": 2, "missing_ps": 1, "unresolved": 1}
    words = spark.createDataFrame([("/d", "d", k, "1", w, "Quotation" if r != "o" else "NaR", r, r) for k, (w, r) in enumerate([("a", "o"), (".", "o"), ("b", "Ps 1:1"), (".", "Ps 1:1"), ("c", "Mt 9:9")])], "source_path string, source_file string, word_index int, line string, word string, label string, reference string, `reference normalized` string")
    data, seen = corpus.observed(corpus.datasets(words, spark.createDataFrame([("Ps 1:1", "t")], "reference string, text string")))
    assert seen.keys() == {"sentences", "sets", "segments"}
    for name in seen:
        data[name].write.parquet(f"{tmp_path}/{name}")
    got = {x["name"]: tuple(x)[1:] for x in corpus.report(spark, seen).collect()}
    assert got["sentences"] == (3, 2, 1, 1) and got["sets"] == (2, 2, 1, 1)


def test_words_in_pieces_equal_a_batch(spark, tmp_path):
    """Cut anywhere, out of order, sent twice: sentences and runs are those of all words at once."""
    r = random.Random(2)
    rows = [(d, k, r.choice(["a", "b", ".", None, "?"]), r.choice(["o", "o", "Ps 1:1", None])) for d in ("x", "y", "z") for k in range(40)]
    schema = "source_path string, word_index long, word string, reference string"
    df = spark.createDataFrame(rows, schema)
    late = [x for x in rows if x[:2] != ("z", 20)]
    pieces = [r.sample(late, 50), r.sample(late, 70), late + [(None, 0, "a", "o"), ("x", None, "a", "o")], rows[-30:]]
    for k, piece in enumerate(pieces):
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    query = runs.numbered_words(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    seen = []

    def arrived(batch, _):
        seen.append([tuple(x) for x in batch.collect()])

    query.writeStream.foreachBatch(arrived).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = [x for batch in seen for x in batch]
    marked = sequence.mark_groups(sequence.mark_runs(df, ["source_path"], ["word_index"], F.col("reference")), ["source_path"], ["word_index"], F.coalesce(F.trim("word").isin(".", "?", "!", ";"), F.lit(False)))
    want = [tuple(x) for x in marked.select("source_path", "word_index", "word", "reference", "sentence_index", "run").collect()]
    assert len(got) == len(set(got)) and sorted(got, key=repr) == sorted(want, key=repr) and len([b for b in seen if b]) > 1
