import random

from florilex.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def expected(rows):
    """Per document: its line numbers with an earlier line within two byte edits."""
    flat = [(lines.LAST if d is None else d, k, p, x.encode()) for k, (d, t) in enumerate(rows) for p, x in enumerate((t or "").split("\n")) if x]

    def near(x, y):
        return x == y or min(len(x), len(y)) >= lines.MIN_BYTES and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2

    gone = {k: [] for k in range(len(rows))}
    for r, k, p, x in flat:
        if any((s, q) < (r, p) and near(x, y) for s, _, q, y in flat):
            gone[k].append(p)
    return [gone[k] for k in range(len(rows))]


def corpus(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé ") for _ in range(r.randrange(20, 34))) for _ in range(12)]
    rows = []
    for k in range(n):
        out = []
        for _ in range(r.randrange(0, 5)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 1, 2, 3])):
                at = r.randrange(len(x))
                x[at : at + r.choice([0, 1])] = r.choice(["", "z", "é"])
            out.append("".join(x))
        rows.append((k * 2, "\n".join(out)))
    r.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = corpus(1, 70) + [(901, None), (902, ""), (903, "short\nshort"), (None, corpus(1, 70)[0][1]), (None, "a line that only this one has, twice"), (904, "x" * 5000), (905, "x" * 5001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h1", "'a' as line", "2 as first")
    got = sorted(((x.doc_id, x.n_lines, x.n_removed, x.removed) for x in lines.op_query(df).collect()), key=repr)
    want = sorted(((d, (t or "").count("\n") + 1, len(g), ",".join(map(str, g))) for (d, t), g in zip(rows, expected(rows), strict=True)), key=repr)
    assert got == want and sum(x[2] for x in got) > 50
    texts = {x.doc_id: x.text for x in lines.deduplicated(df).collect()}
    for (d, t), g in zip(rows, expected(rows), strict=True):
        if d is not None:
            assert texts[d] == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in g))
    assert lines.deduplicated(df).columns == df.columns


def test_banded_distance(spark):
    r = random.Random(9)
    rows = []
    for _ in range(400):
        a = "".join(r.choice("abé") for _ in range(r.randrange(5, 30)))
        x = list(a)
        for _ in range(r.randrange(0, 5)):
            at = r.randrange(len(x))
            x[at : at + r.choice([0, 1])] = r.choice(["", "z", "é"])
        b = "".join(x)
        if len(a.encode()) >= 3 and len(b.encode()) >= 3:
            rows.append((bytearray(a.encode()), bytearray(b.encode())))
    df = spark.createDataFrame(rows, "a binary, b binary")
    for edits in (1, 2, 3):
        got = df.where(f"abs(octet_length(a) - octet_length(b)) <= {edits}").select("a", "b", lines.banded_distance("a", "b", edits).alias("d")).collect()
        assert len(got) > 100
        for x in got:
            want = distance(bytes(x.a), bytes(x.b))
            assert x.d == want if want <= edits else x.d > edits


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(corpus(2, 5), "doc_id long, text string")
    plan = lines.op_query(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "one line that is long enough\nother line that is long enough")] * 2, "doc_id long, text string")
    assert [x.n_removed for x in lines.op_query(df).collect()] == [0, 0]
    assert lines.op_query(df.limit(0)).collect() == []


def test_rows_without_number(spark):
    a, b = "the same line of text in two\nA", "the same line of text in two!\nB"
    df = spark.createDataFrame([(None, a), (None, b), (None, b)], "doc_id long, text string")
    assert sorted(x.n_removed for x in lines.op_query(df).collect()) in ([0, 0, 1], [0, 1, 1])
    assert sorted(x.text.count("\n") for x in lines.deduplicated(df).collect()) in ([0, 1, 1], [0, 0, 1])


def test_variants_of_boilerplate(spark):
    """Lines that differ in digits share all their segments but one; candidates stay a small multiple of them, and no pair is lost."""
    r = random.Random(4)
    numbers = r.sample(range(100_000, 1_000_000), 10_000)
    text = [f"Posted by {'the editor' if k % 3 else 'a visitor'} of this page, ticket number {n} is now closed" for k, n in enumerate(numbers)]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    rows = lines.line_rows(df)
    by_hash = dict((x.h1, x.line) for x in rows.collect())
    lookup = spark.createDataFrame(list(by_hash.items()), "h1 long, line string")
    found = {frozenset((by_hash[x.a1], by_hash[x.b1])) for x in lines.candidates(rows, 2, lambda h: lookup.join(h, "h1")).collect()}
    want = set()
    have = set(text)
    for x in text:
        at = next(k for k, c in enumerate(x) if c.isdigit())
        for i in range(at, at + 6):
            for j in range(i + 1, at + 6):
                for c in "0123456789":
                    for d in "0123456789":
                        y = x[:i] + c + x[i + 1 : j] + d + x[j + 1 :]
                        if y != x and y in have:
                            want.add(frozenset((x, y)))
    assert want <= found
    assert len(found) < 100 * len(text), len(found) / len(text)


def test_copies_of_a_line_changed_in_many_places(spark):
    r = random.Random(6)
    base = " ".join(f"word{k}" for k in range(14))
    rows = []
    for k in range(220):
        x = base
        for _ in range(r.choice([1, 1, 2])):
            at = r.randrange(len(x))
            x = x[:at] + "".join(r.choice("xyz") for _ in range(r.choice([0, 1, 3]))) + x[at + r.choice([0, 1]) :]
        rows.append((k, x))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in lines.op_query(df).collect()}
    assert got == {d: len(g) for (d, _), g in zip(rows, expected(rows), strict=True)} and 0 < sum(got.values()) < 220


def test_crowded_segments_lose_no_pair(spark):
    r = random.Random(5)
    rows = [(k, f"{r.choice(['alpha', 'beta'])} section {r.randrange(40)}{r.choice(['', '.', 'x'])} of the manual, part {r.randrange(9)} and page {r.choice('abcde')}{r.randrange(12)}") for k in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in lines.op_query(df).collect()}
    assert got == {d: len(g) for (d, _), g in zip(rows, expected(rows), strict=True)} and 0 < sum(got.values()) < 260
