from florilex.llm import units

A = "one two three four five six seven eight nine ten eleven."
B = "This other sentence also has a good many words in it, more than ten."


def plain_units(text, least=10):
    """(start, end, words) of each unit, word by word."""
    out, lines, at = [], [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), line))
        at += len(line) + 1
    paragraph = []
    for start, end, line in [*lines, (0, 0, "")]:
        words = line.lower().split()
        if not 0 < len(words) < least:
            if len(paragraph) > 1:
                out.append((paragraph[0][0], paragraph[-1][1], tuple(w for *_, ws in paragraph for w in ws)))
            paragraph = []
        if not words:
            continue
        out.append((start, end, tuple(words)))
        if len(words) < least:
            paragraph.append((start, end, words))
            continue
        sentences, begin = [], None
        for k, c in enumerate(line):
            if begin is None and not c.isspace():
                begin = k
            if begin is not None and (k == len(line) - 1 or c in ".!?" and k > begin and line[k + 1].isspace()):
                sentences.append((begin, k + 1))
                begin = None
        for i in range(len(sentences)):
            for j in range(i, len(sentences)):
                own = [w for a, b in sentences[i : j + 1] for w in line[a:b].lower().split()]
                if len(own) >= least:
                    if j - i + 1 < len(sentences):
                        out.append((start + sentences[i][0], start + sentences[j][1], tuple(own)))
                    break
    return out


def plain(rows):
    """The rule, stated over all units in rank order."""
    seen, out = {}, set()
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for start, end, words in sorted(plain_units(t or "")):
            if words in seen and seen[words] != (d, start):
                out.add((d, start, end, *seen[words]))
            seen.setdefault(words, (d, start))
    return out


def test_removals(spark):
    rows = [(4, f"{A}\nshort line\n{B}"), (2, f"x {B}  {A.upper()} tail"), (9, A + "\n" + A), (7, "nothing to see"), (8, None), (10, ""), (None, B), (11, f"{B} {A}"), (12, f"{B}\t{A}\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as d1", "2 as start")
    got = {tuple(x) for x in units.op_query(df).collect()}
    assert got == plain(rows) and {7, 8, 10}.isdisjoint({x[0] for x in got})
    texts = dict(rows)
    assert all(len(texts[d][s:e].split()) >= 10 for d, s, e, *_ in got)


def test_passage_of_short_sentences_amid_a_line(spark):
    passage = " ".join(f"Short sentence {k}." for k in range(20))
    rows = [(1, f"Begin here {passage} and so on."), (2, f"Quite other words go first. Then {passage} The end."), (3, "Begin here. Nothing else.")]
    got = units.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in got} == {2} and {x.first_doc_id for x in got} == {1}
    text = units.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 2").first().text
    assert "sentence 5" not in text and text.startswith("Quite other words go first. Then Short sentence 0.") and text.endswith("The end.")


def test_text_and_offsets(spark):
    rows = [(1, f"{A}\nkeep this"), (2, f"before {A}\n{A}\nkeep that"), (3, None), (4, "été 日本 " + A)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as spans", "6 as end", "7 as _fx_gone_", "8 as d1")
    got = {x.doc_id: x for x in units.deduplicated(df).collect()}
    assert got[1].text == rows[0][1] and got[3].text is None and got[2].text == f"before {A}\n\nkeep that"
    assert all("".join(t[s.start : s.end] for s in got[d].spans) == got[d].text for d, t in rows if t)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, A), (1, A)], "doc_id long, text string")
    assert units.op_query(df).collect() == []
    assert units.op_query(df.limit(0)).collect() == []


def test_short_lines_and_paragraphs(spark):
    rows = [(1, "One is here\nMIT License.\n\nroses are red\nviolets are blue"), (2, "Two is there\n  mit  license.\n \nx"), (3, "roses are\nred violets are blue\n\nlast words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, dict(rows)[x.doc_id][x.start : x.end], x.first_doc_id) for x in units.op_query(df).collect())
    assert got == [(2, "  mit  license.", 1), (3, "roses are\nred violets are blue", 1)]


def test_units_of_whole_documents(spark):
    for t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        got = [(a, b) for a, b, _ in units.units(t.text)]
        assert sorted(got) == sorted((a, b) for a, b, _ in plain_units(t.text))


def test_rows_are_told_apart_by_text(spark):
    """Documents without a number, or with the same one: only the one that repeats a line loses it."""
    for d in (None, 5):
        rows = [(d, f"{A}\n{A}\nrest"), (d, "A wholly different text of another character, that has no line in common with any.")]
        got = sorted(x.text for x in units.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == sorted([f"{A}\n\nrest", rows[1][1]])
        rows = [(d, f"{A}\none"), (d, f"{A}\ntwo")]
        got = [x.text for x in units.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert sum(A in x for x in got) == 1


def test_very_long_text(spark):
    body = "\n".join(f"line number {k} of a very long text" for k in range(60_000))
    rows = [(1, body), (2, "line number 59999 of a very long text\nand its own end"), (3, None)]
    got = {x.doc_id: x.text for x in units.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: body, 2: "\nand its own end", 3: None}
