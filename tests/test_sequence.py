import random

from pyspark.sql import functions as F

from florilex.functions import text as fx
from florilex.operators import expand, sequence

COLUMNS = "source_path string, source_file string, word_index int, line string, word string, label string, reference string, `reference normalized` string"


def corpus(seed, n_files=4, n_words=90):
    r = random.Random(seed)
    rows = []
    for f in range(n_files):
        ref = "o"
        for k in range(n_words):
            if r.random() < 0.3:
                ref = r.choice(["o", "o", "Ps 1:1", "Mt 2:2"])
            rows.append((f"/d{f}/x.tsv", "x.tsv", k, r.choice(["3", "4.0", "", None]), r.choice(["a", "b", "c", ".", ",", ";", "?"]), "NaR" if ref == "o" else r.choice(["Quotation", "allusion"]), ref if r.random() < 0.9 else "o", ref))
    return rows


def distinct(values, drop):
    return list(dict.fromkeys(v for v in values if v not in drop))


def model(rows):
    """Sentences and runs by walking over the words one by one."""
    sents, sets = [], []
    for path in sorted({x[0] for x in rows}):
        words = sorted((x for x in rows if x[0] == path), key=lambda x: x[2])
        part, index, seen, run = [], 0, 0, []

        def sentence():
            lines = distinct([{None: "o", "": "o", "4.0": "4"}.get(w[3], w[3]) for w in part], {"o"})
            refs, initial, labels = distinct([w[7] for w in part], {"o"}), distinct([w[6] for w in part], {"o"}), distinct([w[5] for w in part], {"NaR", "o"})
            text = " ".join(w[4] for w in part)
            for m in ".,;:?!":
                text = text.replace(f" {m}", m)
            sents.append((path, index, "o" if not lines else lines[0] if len(lines) == 1 else f"{lines[0]}-{lines[-1]}", text, " ; ".join(labels) or "NaR", " ; ".join(initial) or "o", " ; ".join(refs) or "o"))

        def close():
            if run and run[0][7] != "o":
                sets.append((path, seen, run[0][5], run[0][6], run[0][7], len(run)))

        for w in words:
            if run and run[-1][7] != w[7]:
                close()
                run = []
            run.append(w)
            seen += w[4] in ".?!;"
            part.append(w)
            if w[4] in ".?!;":
                sentence()
                part, index = [], index + 1
        close()
        if part:
            sentence()
    return sents, sets


def test_sentences_and_sets_equal_a_walk(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, COLUMNS)
    sents, sets = model(rows)
    got = [(x.source_path, x.sentence_index, x.line, x.sentence, x.label, x.initial_reference, x.reference) for x in sequence.sentences(df).collect()]
    assert sorted(got) == sorted(sents)
    runs = sequence.reuse_sets(df).withColumn("n", F.size(fx.tokenize(F.col("reuse_tag_set"))))
    got = [(x.source_path, x.sentence_index, x.label, x.initial_reference, x.reference, x.n) for x in runs.collect()]
    assert sorted(got) == sorted(sets)


def test_scan_equals_windows(spark):
    """Chunks of one word and more, runs and sentences over many chunks, null keys and parts."""
    rows = corpus(3)
    df = spark.createDataFrame(rows, COLUMNS)
    for size in (1, 7, 1000):
        for one, two in ((sequence.sentences(df), sequence.sentences(df, size)), (sequence.reuse_sets(df), sequence.reuse_sets(df, size))):
            assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    r = random.Random(4)
    marks = [(r.choice([None, 1, 2]), k, r.choice([None, None, "a", "a", "b"])) for k in range(300)]
    df = spark.createDataFrame(marks, "p int, k int, v string")
    by = (["p"], ["k"])
    for scan, window in (
        (sequence.mark_runs(df, *by, F.col("v"), chunk=sequence.chunks("k", 9)), sequence.mark_runs(df, *by, F.col("v"))),
        (sequence.mark_groups(df, *by, F.col("v") == "a", chunk=sequence.chunks("k", 9)), sequence.mark_groups(df, *by, F.col("v") == "a")),
        (sequence.mark_runs(sequence.placed(df, *by), *by, F.col("v"), chunk=F.col("chunk")).drop("chunk"), sequence.mark_runs(df, *by, F.col("v"))),
    ):
        assert sorted(map(str, scan.select(*window.columns).collect())) == sorted(map(str, window.collect()))


def test_sums_of_chunks_in_two_levels(spark):
    ends = spark.createDataFrame([(c % 3, c, c * c % 7) for c in range(200)], "p int, c long, n long").withColumn("_fx_at", sequence._stretch(["p"], F.col("c")))
    got = {(x["p"], x["c"]): x["b"] for x in sequence._summed(ends, F.col("n"), fan=10).select("_fx_at.parts.p", F.col("_fx_at.chunk").alias("c"), F.col("_fx_before").alias("b")).collect()}
    assert got == {(c % 3, c): sum(k * k % 7 for k in range(c % 3, c, 3)) for c in range(200)}


def test_one_giant_document(spark):
    """A document of ten million words: a window of the scan sees 5,000 of them, and sums over all are right."""
    n = 10_000_000
    words = spark.range(n).select(F.lit("/one").alias("path"), F.col("id").alias("at"), (F.col("id") % 11 == 10).alias("ends"), F.floor(F.col("id") / 25_003).alias("ref"))
    marked = sequence.mark_groups(words, ["path"], ["at"], F.col("ends"), chunk=sequence.chunks("at"))
    wrong = marked.where(F.col("sentence_index") != F.floor(F.col("at") / 11)).count()
    runs = sequence.mark_runs(words, ["path"], ["at"], F.col("ref"), chunk=sequence.chunks("at"))
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert wrong == 0 and runs.where(F.col("run") != F.col("ref") + 1).count() == 0 and "windowspecdefinition(_fx_at" in plan and "windowspecdefinition(path" not in plan


def test_segments_cover_all_words_and_no_chunk_is_crossed(spark):
    rows = corpus(2)
    out = sequence.segments(spark.createDataFrame(rows, COLUMNS), chunk=37).orderBy("source_path", "sentence_index").collect()
    for path in {x[0] for x in rows}:
        words = [x[4] for x in sorted(rows, key=lambda x: x[2]) if x[0] == path]
        mine = [x.sentence for x in out if x.source_path == path]
        again = " ".join(mine)
        for m in ".,;?":
            again = again.replace(m, f" {m} ")
        assert again.split() == words
        want = []
        for a in range(0, len(words), 37):
            want += [len(s.split()) for s in sequence.rule_segmenter([" ".join(words[a : a + 37])])[0]]
        assert len(mine) == len(want)


def test_punctuation_thinning_and_raw_text(spark):
    words = [", , , .".split(), "a . . b ! ; ? c .".split(), "( a ) , « b »".split()]
    df = spark.createDataFrame([(d, k, w) for d, x in enumerate(words) for k, w in enumerate(x)], "d int, k int, w string")
    thin = sequence.thin_punctuation(df, ["d"], "k", "w", [".", ",", ";", ":", "!", "?"]).orderBy("d", "k").collect()
    assert [[x.w for x in thin if x.d == d] for d in (0, 1)] == [[",", "", ",", ""], ["a", ".", "", "b", "!", "", "?", "c", "."]]
    assert {x.d: x.text for x in sequence.raw_text(df, ["d"], "k", "w").collect()} == {0: ",,,.", 1: "a.. b!;? c.", 2: "(a), «b»"}


def test_text_functions(spark):
    row = spark.range(1).select(
        fx.tokenize(F.lit(" a,b . c d ")).alias("tokens"),
        fx.drop_punctuation_pairs(F.lit("x...y..z.")).alias("pairs"),
        fx.join_hyphenated(F.lit("ver- bum a-b")).alias("joined"),
        fx.normalize_word(F.lit("ÀB1œ×?")).alias("normal"),
        fx.drop_initials(F.lit("a.")).alias("initial"),
        fx.clean_whitespace(F.lit(" a ,  b. . ")).alias("clean"),
        fx.split_sentences(F.lit("One. Two!\n Three\nfour? ")).alias("sents"),
        fx.repair_line(F.lit("1.05.0")).alias("line"),
        fx.remove_stop_words(F.lit("in the end"), ["the"]).alias("stop"),
        fx.overlaps(F.lit(" AB c"), F.lit("b C ")).alias("over"),
    ).first()
    assert row.tokens == ["a", ",", "b", ".", "c", "d"] and row.pairs == "x.yz." and row.joined == "verbum ab" and row.normal == "àb×?" and row.initial == ""
    assert row.clean == "a  b." and row.sents == ["One.", "Two!", "Three\nfour?"] and row.line == "1.05" and row.stop == "in end" and row.over


def test_expansion_golden(spark):
    cases = [("Ps 1:1 ; Mt 2:2", "Quotation"), ("Ps 1:1", "Quotation ; allusion"), ("Ps 1:1 ; Mt 2:2 ; Lk 3:3", "Quotation ; allusion"), ("Ps 1:1 ;  Mt 2:2", "Quotation"), ("; Ps 1:1", "Quotation"), ("Ps 2:3.5-7", "any")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, reference string, label string")
    short = sorted((x.k, x.part_no, x.verse_no, x.reference, x.label) for x in expand.deagglomerate(df).collect())
    assert [x[3:] for x in short] == [
        ("Ps 1:1", "Quotation"), ("Mt 2:2", "Quotation"), ("Ps 1:1", "Quotation ; allusion"), ("Ps 1:1", "Quotation"), ("Mt 2:2", "allusion"), ("Lk 3:3", "allusion"), ("Ps 1:1", "Quotation"), ("Mt 2:2", "Quotation"), ("; Ps 1:1", "Quotation"), ("Ps 2:3", "any"), ("Ps 2:5-7", "any"),
    ]
    longest = sorted((x.k, x.part_no, x.reference, x.label) for x in expand.split_references(df, longest=True).where("k = 1").collect())
    assert longest == [(1, 0, "Ps 1:1", "Quotation"), (1, 1, "Ps 1:1", "allusion")]
    ranges = spark.createDataFrame([(v,) for v in ("3", "3 - 5", "6-8.10", "15 16", "5-3", "1-99999999999", "x")], "v string").select("v", expand.verse_ranges(F.col("v")).alias("n")).collect()
    assert {x.v: [tuple(y) for y in x.n] for x in ranges} == {"3": [(3, 3)], "3 - 5": [(3, 5)], "6-8.10": [(6, 6), (8, 8), (10, 10)], "15 16": [(15, 15), (16, 16)], "5-3": [(5, 3)], "1-99999999999": [(1, 99999999999)], "x": []}


def test_rows_of_words_and_arrays_of_words_agree(spark):
    """Sentences, thinning and running text within a row against the operators on words as rows."""
    r = random.Random(5)
    marks = [".", ",", ";", ":", "!", "?", "(", ")", "«", "»", "[", "]", "\\", "^", "-", "{", "a", "bc", "é", "a.", "..", "x"]
    lists = [[r.choice(marks) for _ in range(r.randrange(1, 30))] for _ in range(200)] + [["."], [".", "."], [",", ",", ","], ["(", ")"]]
    arrays = spark.createDataFrame(list(enumerate(lists)), "d int, w array<string>")
    rows = arrays.select("d", F.posexplode("w").alias("k", "w"))
    marked = sequence.mark_groups(rows, ["d"], ["k"], fx.is_boundary(F.col("w"))).groupBy("d", "sentence_index").agg(F.array_join(sequence.in_order(F.col("w"), ["k"]), " ").alias("s"))
    want = {(x.d, x.sentence_index, x.s) for x in marked.collect()}
    assert {tuple(x) for x in arrays.select("d", F.posexplode(fx.sentences_of(F.col("w")))).collect()} == want
    thin = sequence.thin_punctuation(rows, ["d"], "k", "w", [".", ",", ";", ":", "!", "?"]).groupBy("d").agg(sequence.in_order(F.col("w"), ["k"]).alias("w"))
    assert {x.d: x.w for x in arrays.select("d", fx.thinned(F.col("w"), [".", ",", ";", ":", "!", "?"]).alias("w")).collect()} == {x.d: x.w for x in thin.collect()}
    raw = {x.d: x.text for x in sequence.raw_text(rows, ["d"], "k", "w").collect()}
    assert {x.d: x.t for x in arrays.select("d", fx.running_text(F.col("w")).alias("t")).collect()} == raw
    none = spark.range(1).select(F.array().cast("array<string>").alias("w")).select(fx.sentences_of(F.col("w")).alias("s"), fx.thinned(F.col("w"), ["."]).alias("t"), fx.running_text(F.col("w")).alias("r")).first()
    assert tuple(none) == ([], [], "")
