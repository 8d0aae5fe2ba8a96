import json
import random

from florilex.llm import chat

SCHEMA = {"f": {"required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "string", "maxLength": 3}, "c": {"type": "array"}, "d": {"type": "number", "maximum": 2.5}, "e": {"type": "boolean"}}}}
COLUMNS = "conv_id long, turn long, role string, kind string, call_id string, name string, arguments string, content string, after array<string>"


def run(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 as level", "'x' as json", "0 as step")
    return {(x.conv_id, x.turn, x.kind): x for x in chat.linked(df, SCHEMA).collect()}


def call(turn, ident, args='{"a":1}', after=None, conv=1, name="f"):
    return (conv, turn, "assistant", "call", ident, name, args, None, after)


def result(turn, ident, content="ok", conv=1):
    return (conv, turn, "tool", "result", ident, None, None, content, None)


def test_links_and_levels(spark):
    rows = [
        (1, 0, "system", "plain", None, None, None, "be kind", None),
        call(1, "a"), call(2, "b", after=["a", "unknown"]), call(3, "c", after=["a", "b"]), call(4, "d", after=["c", "b"]), result(5, "c"), result(6, "a"), result(7, "a"), result(8, "zz"), call(9, "a"),
        call(10, "x", after=["y"]), call(11, "y", after=["x"]), call(12, "z", after=["x"]), call(13, "s", after=["s"]),
        call(1, "a", conv=2), result(2, "a", conv=2), call(3, "late", after=["later"], conv=2), call(4, "later", conv=2), result(5, "late", conv=2),
        call(6, None, conv=2), result(7, None, conv=2), call(1, "n", conv=None),
    ]
    got = run(spark, rows)
    want = {1: ("linked", 0), 2: ("pending", 1), 3: ("linked", 2), 4: ("pending", 3), 9: ("duplicate", 0), 10: ("cyclic", None), 11: ("cyclic", None), 12: ("cyclic", None), 13: ("cyclic", None)}
    assert {t: (got[1, t, "call"].status, got[1, t, "call"].level) for t in want} == want
    assert [got[1, t, "result"].status for t in (5, 6, 7, 8)] == ["linked", "linked", "duplicate", "orphan"]
    assert (got[1, 0, "plain"].status, got[1, 0, "plain"].level) == ("plain", -1)
    assert [got[2, 3, "call"].level, got[2, 4, "call"].level] == [1, 0]
    assert got[2, 6, "call"].status == "pending" and got[2, 7, "result"].status == "orphan" and got[None, 1, "call"].status == "pending"
    order = sorted((x for k, x in got.items() if k[0] == 1 and x.level is not None), key=lambda x: (x.level, x.call_turn, x.step, x.turn))
    at = {(x.kind, x.turn): i for i, x in enumerate(order)}
    assert at["call", 1] < at["result", 6] < at["call", 2] < at["call", 3] < at["result", 5] < at["call", 4]


def test_levels_of_random_graphs_and_long_chains(spark):
    r = random.Random(1)
    rows, want = [], {}
    for conv in range(12):
        after = {k: sorted({r.randrange(30) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))}) for k in range(30)} if conv < 4 else {k: sorted({r.randrange(k) for _ in range(r.choice([0, 1, 1, 2]))}) if k else [] for k in range(30)}
        rows += [(conv, str(k), [str(x) for x in v]) for k, v in after.items()]
        level = {}
        while new := {k: 1 + max((level[x] for x in v), default=-1) for k, v in after.items() if k not in level and all(x in level for x in v)}:
            level |= new
        want |= {(conv, str(k)): x for k, x in level.items()}
    rows += [(99, str(k), [str(k - 1)]) for k in range(300)] + [(98, "a", ["b"]), (98, "b", ["a"]), (98, "c", ["b"])]
    want |= {(99, str(k)): k for k in range(300)}
    got = chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()
    assert {(x.conv_id, x.call_id): x.level for x in got} == want


def test_arguments_and_canonical_json(spark):
    args = ['{"b":"xyz", "a":2}', "{}", '{"a":"1"}', '{"a":0,"b":"long"}', '{"a":1,"c":[1,{"z":1,"y":null}],"d":2.6,"e":true}', "nonsense", None, '{"a":1.5,"c":{},"e":"true"}']
    got = run(spark, [call(i, f"k{i}", a) for i, a in enumerate(args)] + [call(90, "u", name="g")])
    errors = [got[1, i, "call"].errors for i in range(len(args))]
    assert errors == ["", "a: missing", "a: type", "a: range; b: range", "d: range", "arguments: not JSON", "arguments: not JSON", "a: type; c: type; e: type"]
    assert got[1, 90, "call"].errors == "name: unknown"
    assert got[1, 0, "call"].json == '{"arguments":{"a":2,"b":"xyz"},"call_id":"k0","name":"f","role":"assistant"}'
    assert got[1, 4, "call"].json == '{"arguments":{"a":1,"c":[1,{"y":null,"z":1}],"d":2.6,"e":true},"call_id":"k4","name":"f","role":"assistant"}'
    assert "arguments" not in json.loads(got[1, 5, "call"].json)


def test_query_on_plain_conversations(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hello there"), (1, 2, "assistant", "hi"), (1, 3, "user", "x"), (2, 0, "user", None), (2, 0, "user", None), (2, 1, "assistant", ""), (None, 1, "user", "no conversation"), (3, None, "assistant", "no turn"), (4, 0, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.op_query(df)
    assert out.count() == len(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    chat.write_lines(out, str(tmp_path / "lines"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "lines")).collect()) == sorted(x.json for x in out.collect())
    assert chat.op_query(df.limit(0)).collect() == []


def test_very_long_texts_and_names_of_the_result(spark):
    long = "x" * 3_000_000
    rows = [call(1, "a", json.dumps({"a": 1, "b": long})), result(2, "a", long), (1, 3, "user", "plain", None, None, None, long, None)]
    got = run(spark, rows)
    assert (got[1, 1, "call"].status, got[1, 1, "call"].errors) == ("linked", "b: range")
    assert json.loads(got[1, 2, "result"].json)["content"] == json.loads(got[1, 3, "plain"].json)["content"] == long
