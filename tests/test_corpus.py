import json

from pyspark.sql import functions as F

from florilex.functions import vectors
from florilex.operators import sequence
from florilex.plans import corpus
from florilex.sources import files, sinks
from florilex.streaming import words as stream

from .test_docx_tei import package, run

VERSES = [("Mt 1:1", "liber generationis"), ("Mt 1:2", "Abraham genuit Isaac")]


def test_from_documents_to_datasets(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.docx").write_bytes(package(run("(1)Ait. ") + run("liber generationis", "FF0000", 1) + run(" ; finis"), notes={1: "Mt 1,1"}))
    (tmp_path / "in/sub/a.docx").write_bytes(package(run("Abraham, ", "00FF00") + run("genuit", "00FF00", 1), notes={1: "Mt 1,1-2"}))
    words = corpus.words_from_docx(spark, f"{tmp_path}/in").cache()
    assert words.where("word_index = 0").count() == 2
    verses = spark.createDataFrame(VERSES, "reference string, text string")
    data = corpus.datasets(words, verses)
    sents = {(x.sentence_index, x.sentence): (x.reference, x.initial_reference, x.label, x.biblical_text) for x in data["sentences"].collect()}
    assert sents[1, "liber generationis;"] == ("Mt 1:1", "Mt 1,1", "Occurrence", "liber generationis")
    assert sents[0, "abraham, genuit"] == ("Mt 1:1-2", "Mt 1,1-2", "Occurrence", "liber generationis Abraham genuit Isaac")
    assert sents[0, "ait."] == ("o", "o", "NaR", "")
    assert sorted(x.reuse_tag_set for x in data["sets"].collect()) == ["abraham, genuit", "liber generationis"]
    assert data["segments"].count() == data["sentences"].count() and data["tags"].count() == words.count()
    assert {x.name: (x.with_reference, x.with_text) for x in corpus.summary(data).collect()} == {"sentences": (2, 2), "sets": (2, 2), "segments": (2, 2)}


def word_file(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("line\tword\tlabel\treference\treference normalized\n" + "".join("\t".join(r) + "\n" for r in rows))


def test_word_files_keep_order_words_and_paths(spark, tmp_path):
    word_file(tmp_path / "x/a_reuses.tsv", [("1", "null", "NaR", "o", "o"), ("", '"a ""q"""', "NaR", "o", "o"), ("2", "nan", "", "", "")])
    word_file(tmp_path / "y/a_reuses.tsv", [("1", "b", "NaR", "o", "o")])
    word_file(tmp_path / "y/other.tsv", [("1", "no", "NaR", "o", "o")])
    got = [(x.source_path.split("/")[-2], x.source_file, x.word_index, x.word, x.line) for x in files.word_files(spark, str(tmp_path)).orderBy("source_path", "word_index").collect()]
    assert got == [("x", "a_reuses.tsv", 0, "null", "1"), ("x", "a_reuses.tsv", 1, 'a "q"', ""), ("x", "a_reuses.tsv", 2, "nan", "2"), ("y", "a_reuses.tsv", 0, "b", "1")]


def test_other_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\n1\t2\t3\n4\t5\n")
    assert [tuple(x) for x in files.positional(spark, str(tmp_path / "t.tsv"), {0: "x", 2: "z"}, 3).collect()] == [("1", "3")]
    assert files.tsv(spark, str(tmp_path / "t.tsv")).columns == ["a", "b", "c"]
    assert [t for _, t in files.tsv(spark, str(tmp_path / "t.tsv"), infer=True).dtypes] == ["int", "int", "int"]
    (tmp_path / "p.csv").write_text("1 Col ,1 Co\n\nA,b,c\n")
    assert files.pairs(spark, str(tmp_path / "p.csv")) == [("1 Col ", "1 Co"), ("A", "b,c")]
    (tmp_path / "w.txt").write_text("et \nin\n")
    assert files.word_list(spark, str(tmp_path / "w.txt")) == ["et", "in"]
    (tmp_path / "x").mkdir()
    for name in ("a.xml", "B.XML", "c.txt"):
        (tmp_path / "x" / name).write_text("<p>é</p>")
    assert sorted((x.path[-5:], x.xml) for x in files.xml_files(spark, str(tmp_path / "x")).collect()) == [("B.XML", "<p>é</p>"), ("a.xml", "<p>é</p>")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 'x"y'), ("a", 1, ""), ("b", 1, "z")], "f string, k int, t string")
    sinks.write_tsv(df, f"{tmp_path}/tsv", by=["f"], order=["k"])
    assert sorted((x.f, x.k, x.t or "") for x in files.tsv(spark, f"{tmp_path}/tsv").collect()) == [("a", "1", ""), ("b", "1", "z"), ("b", "2", 'x"y')]
    texts = df.where("k = 1").selectExpr("f || '/' || f as name", "t")
    assert sorted(tuple(x) for x in sinks.write_files(texts, f"{tmp_path}/txt", "name", "t").collect()) == [("a/a", 0), ("b/b", 1)]
    assert (tmp_path / "txt/b/b").read_text() == "z"
    sinks.write_json_array(df.repartition(3).withColumn("at", F.col("k") * 10 + F.length("t")), f"{tmp_path}/array", "at")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*")))
    assert [x["t"] for x in json.loads(whole)] == ["", "z", 'x"y']
    sinks.write_json_lines(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 3
    assert [tuple(x) for x in sinks.distinct_markers(spark.createDataFrame([("m", "f"), ("m", "f"), ("", "g"), ("a", "g")], "m string, s string"), "m", "s").collect()] == [("a", "g"), ("m", "f")]


def test_what_sinks_write_sources_read(spark, tmp_path):
    rows = [(f"/in/{d}/doc.xml", "doc.xml", k, str(k // 2), w, "NaR", "o", "o") for d in "ab" for k, w in enumerate(["null", 'a "q"', "", ",", "end", "."])]
    words = spark.createDataFrame(rows, "source_path string, source_file string, word_index int, line string, word string, label string, reference string, `reference normalized` string")
    sinks.write_word_files(words, f"{tmp_path}/tsv", "/in")
    back = files.in_file_order(files.word_files(spark, f"{tmp_path}/tsv")).collect()
    assert [(x.source_path.split("/")[-2], x.source_file, x.word_index, x.line, x.word) for x in back] == [(d, "doc_reuses.tsv", k, str(k // 2), w) for d in "ab" for k, w in enumerate(["null", 'a "q"', "", ",", "end", "."])]
    sinks.write_raw_texts(words, f"{tmp_path}/raw", "/in")
    assert (tmp_path / "raw/b/doc.txt").read_text() == 'null a "q" , end.'
    xml = spark.createDataFrame([("/in/a.docx", "<p>é</p>")], "path string, xml string")
    sinks.write_xml(xml, f"{tmp_path}/xml")
    assert [(x.path.rpartition("/")[2], x.xml) for x in files.xml_files(spark, f"{tmp_path}/xml").collect()] == [("a.xml", "<p>é</p>")]
    sinks.write_markers(words, "word", "source_file", f"{tmp_path}/list", "markers.txt")
    assert (tmp_path / "list/markers.txt").read_text().split("\n")[0] == ",\tdoc.xml"


def test_broken_files_are_named(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(run("good")))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.xml").write_text("<p>x</q>")
    (tmp_path / "d.xml").write_text('<p><seg type="biblicalRef" ana="Quotation">Ps 1,1--3</seg></p>')
    assert [x.word for x in corpus.words_from_docx(spark, str(tmp_path)).collect()] == ["good"]
    assert sorted((x.path.rpartition("/")[2], x.kind) for x in corpus.bad_files(spark, str(tmp_path)).collect()) == [("b.docx", "docx"), ("c.xml", "xml")]


def test_models_are_loaded_once_a_worker(spark):
    def load(threshold):
        def segment(texts, own):
            return [[t[: int(threshold)], t[int(threshold) :]] for t in texts]

        return segment

    words = spark.createDataFrame([("p", "f", k, "1", w, "NaR", "o", "o") for k, w in enumerate(["a", "b", "c"])], "source_path string, source_file string, word_index int, line string, word string, label string, reference string, `reference normalized` string")
    assert [x.sentence for x in sequence.segments(words, loader=(load, 2)).orderBy("sentence_index").collect()] == ["a", "b c"]
    vector = spark.createDataFrame([("ab b",), (None,)], "t string").select(vectors.embed(F.col("t"), loader=(lambda size: lambda texts: [[float(len(x))] * size for x in texts], 2), batch=1).alias("v"))
    assert [x.v for x in vector.collect()] == [[4.0, 4.0], [0.0, 0.0]]


def test_stream_of_word_files(spark, tmp_path):
    word_file(tmp_path / "in/a_reuses.tsv", [("1", "a", "NaR", "o", "o"), ("1", ".", "NaR", "o", "o"), ("1", "b", "NaR", "o", "o")])
    for name in ("b", "c"):
        stream.stream_sentences(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        word_file(tmp_path / f"in/{name}_reuses.tsv", [("1", name, "NaR", "o", "o")])
    stream.stream_sentences(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(x.sentence for x in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a.", "b", "b", "c"]
