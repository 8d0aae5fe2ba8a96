"""Chat formatting with tool-call linking, in DataFrame and SQL operations only.

Messages are calls, results of calls, or plain. Calls and results are joined by
(conversation, identifier); calls are layered topologically by what they build
upon; their arguments are checked against JSON schemas; every message becomes
one line of canonical JSON (keys sorted, no blanks, absent values left out).

A message's place in its conversation is (level, call_turn, step, turn): plain
messages first, then each call, followed by its result. The place is a sort
key, not a running number, so that a conversation of any length is spread over
tasks; `write_lines` sorts by it over ranges.

status: linked; pending (a call without result); orphan (a result without
call); duplicate (a call or result whose identifier an earlier one of the same
kind has); cyclic (a call in, or behind, a cycle; level null, as for orphans);
plain.

Edge cases: a null conversation, turn or identifier links to nothing and is kept
(pending or orphan). Null arguments, or ones that are not JSON, are invalid. Rows repeated in
full tie and get the same status. Calls that name unknown or later calls in
after: the unknown are ignored, the later are waited for. Very long texts are
handled like others. Empty tables give empty results. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}
#: The arguments of the call that a turn of a plain conversation makes.
REPLY = {
    "reply": {
        "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 1500}, "turn": {"type": "integer", "minimum": 0}, "chars": {"type": "integer", "minimum": 8}},
    }
}


def argument_errors(value: Column, schema: dict) -> Column:
    """The breaches of a schema by a variant, sorted: 'name: missing', 'name: type', 'name: range'."""
    found = []
    for name in sorted(schema.get("properties", {})):
        rule = schema["properties"][name]
        part = F.try_variant_get(value, f"$.{name}", "variant")
        kind = F.regexp_extract(F.schema_of_variant(part), r"^\w+", 0)
        ok = kind.isin(*KINDS[rule["type"]]) if "type" in rule else F.lit(True)
        text, number = F.try_variant_get(value, f"$.{name}", "string"), F.try_variant_get(value, f"$.{name}", "double")
        bounds = [f for key, f in (("minLength", lambda x: F.length(text) < x), ("maxLength", lambda x: F.length(text) > x), ("minimum", lambda x: number < x), ("maximum", lambda x: number > x)) if key in rule for f in [f(rule[key])]]
        bad = F.lit(False)
        for b in bounds:
            bad = bad | F.coalesce(b, F.lit(True))
        absent = F.lit(f"{name}: missing") if name in schema.get("required", ()) else F.lit(None).cast("string")
        found.append(F.when(part.isNull(), absent).when(~ok, F.lit(f"{name}: type")).when(bad, F.lit(f"{name}: range")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def validated(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Adds errors, an array of breaches, to rows with name and arguments (JSON text); unknown names have 'name: unknown'."""
    value = F.try_parse_json("arguments")
    out = F.when(value.isNull(), F.array(F.lit("arguments: not JSON")))
    for name in sorted(schemas):
        out = out.when(F.col("name") == name, argument_errors(value, schemas[name]))
    return calls.withColumn("errors", out.otherwise(F.array(F.lit("name: unknown"))))


def _followed(links: DataFrame) -> DataFrame:
    """(conv_id, call_id, head, far): where chains of calls with one predecessor begin, and how far back that is.

    links: conv_id, call_id, head, far, ends, with the predecessor (or the call
    itself, if it has none or several) as head. Each round doubles the stretch
    that is known, so a chain of any length takes logarithmically many rounds.
    A cycle never ends; its calls are left out.
    """
    ids = ["conv_id", "call_id"]
    open_ = None
    while True:
        links = checkpoint(links)
        left = links.where("not ends").count()
        if left in (0, open_) and (left == 0 or links.where("not ends").agg(F.min("far")).first()[0] > left):
            return links.where("ends").select(*ids, "head", "far")
        open_ = left
        ahead = links.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"), F.col("ends").alias("last"))
        links = links.join(ahead, ["conv_id", "head"]).select(*ids, F.when(F.col("ends"), F.col("head")).otherwise(F.col("next")).alias("head"), F.when(F.col("ends"), F.col("far")).otherwise(F.col("far") + F.col("more")).alias("far"), (F.col("ends") | F.col("last")).alias("ends"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): layers of the calls' dependencies; calls in or behind a cycle are left out.

    calls has conv_id, call_id (unique in a conversation) and after, an array of
    identifiers. Chains of calls with one predecessor are followed by pointer
    doubling; among the calls with several, each round gives a level to those
    all of whose predecessors have one, so there are as many rounds as such calls lie behind one another.
    """
    ids = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("parent"))
    edges = checkpoint(calls.select(*ids, F.explode("after").alias("parent")).distinct().join(known, ["conv_id", "parent"]))
    parents = edges.groupBy(*ids).agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    links = calls.where("conv_id is not null").select(*ids).join(parents, ids, "left").select(*ids, F.when(one, F.col("parent")).otherwise(F.col("call_id")).alias("head"), one.cast("long").alias("far"), (~one).alias("ends"))
    heads = _followed(links)
    several = checkpoint(parents.where("n > 1").select("conv_id", F.col("call_id").alias("head"), "n"))
    if several.isEmpty():
        return heads.select(*ids, F.col("far").cast("int").alias("level"))
    heads = checkpoint(heads)
    # what each call with several predecessors waits for: the heads of those, and how far behind them it lies
    waits = edges.join(several.select("conv_id", F.col("head").alias("call_id"), "n"), ids).join(heads.select("conv_id", F.col("call_id").alias("parent"), F.col("head").alias("behind"), (F.col("far") + 1).alias("far")), ["conv_id", "parent"], "left")
    waits = checkpoint(waits.groupBy("conv_id", F.col("call_id").alias("head"), "n", "behind").agg(F.count("*").alias("m"), F.max("far").alias("far")))
    level = heads.where("call_id = head").join(several.select("conv_id", "head", F.lit(True).alias("many")), ["conv_id", "head"], "left").select("conv_id", "head", F.when(F.col("many").isNull(), F.lit(0).cast("long")).alias("level"))
    waiting = None
    while True:
        level = checkpoint(level)
        left = level.where("level is null").count()
        if left in (0, waiting):
            break
        waiting = left
        now = waits.join(level.select("conv_id", F.col("head").alias("behind"), F.col("level").alias("base")), ["conv_id", "behind"], "left").groupBy("conv_id", "head").agg(F.when(F.sum(F.when(F.col("base").isNotNull(), F.col("m")).otherwise(0)) == F.first("n"), F.max(F.col("base") + F.col("far"))).alias("now"))
        level = level.join(now, ["conv_id", "head"], "left").select("conv_id", "head", F.coalesce("level", "now").alias("level"))
    return heads.join(level.where("level is not null"), ["conv_id", "head"]).select(*ids, (F.col("level") + F.col("far")).cast("int").alias("level"))


def linked(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, kind, call_id, status, level, call_turn, step, errors, json of each message.

    messages: conv_id, turn, role, kind (call, result or plain), call_id, name,
    arguments (JSON text), content, after (array of identifiers).
    """
    ids = ["conv_id", "call_id"]
    messages = messages.select("turn", "role", "kind", *ids, "name", "arguments", "content", "after")
    calls = messages.where("kind = 'call' and call_id is not null").groupBy(*ids).agg(F.min("turn").alias("call_turn"), F.flatten(F.collect_set(F.coalesce("after", F.array().cast("array<string>")))).alias("after"))
    results = messages.where("kind = 'result' and call_id is not null").groupBy(*ids).agg(F.min("turn").alias("result_turn"))
    links = calls.hint("shuffle_hash").join(results, ids, "full").join(levels(calls.select(*ids, "after")), ids, "left").drop("after")
    rows = validated(messages, schemas).join(links, ids, "left")
    kind, turn = F.col("kind"), F.col("turn")
    status = (
        F.when(~kind.isin("call", "result"), "plain")
        .when((kind == "call") & F.col("call_turn").isNotNull() & (turn > F.col("call_turn")), "duplicate")
        .when((kind == "result") & F.col("call_turn").isNull(), "orphan")
        .when((kind == "result") & (turn > F.col("result_turn")), "duplicate")
        .when((kind == "call") & F.col("call_turn").isNotNull() & F.col("level").isNull(), "cyclic")
        .when((kind == "call") & F.col("result_turn").isNull(), "pending")
        .otherwise("linked")
    )
    is_call = kind == "call"
    body = F.to_json(
        F.struct(
            F.when(is_call, F.try_parse_json("arguments")).alias("arguments"),
            F.when(kind.isin("call", "result"), F.col("call_id")).alias("call_id"),
            F.when(~is_call, F.col("content")).alias("content"),
            F.when(is_call, F.col("name")).alias("name"),
            F.when(is_call, F.lit("assistant")).when(kind == "result", F.lit("tool")).otherwise(F.col("role")).alias("role"),
        )
    )
    return rows.select(
        "conv_id", "turn", "kind", "call_id", status.alias("status"),
        F.when(~kind.isin("call", "result"), F.lit(-1)).otherwise(F.col("level")).alias("level"),
        F.when(kind.isin("call", "result"), F.coalesce("call_turn", "turn")).otherwise(turn).alias("call_turn"),
        F.when(kind == "result", 1).otherwise(0).alias("step"),
        F.when(is_call, F.array_join("errors", "; ")).alias("errors"),
        body.alias("json"),
    )


def write_lines(rows: DataFrame, path: str) -> None:
    """Writes the JSON lines in order of conversations and places; a long conversation may go on in the next file."""
    place = ["conv_id", "level", "call_turn", "step", "turn"]
    rows.repartitionByRange(*place).sortWithinPartitions(*place).select("json").write.text(path)


def as_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool use: what a user says is a call, what the assistant answers to the turn before is its result; a call builds upon the one two turns before."""
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("plain")
    name = lambda t: F.concat_ws(":", conv, t)
    known = conv.isNotNull() & turn.isNotNull()
    return conversations.select(
        "conv_id", "turn", "role", kind.alias("kind"),
        F.when(known & (kind == "call"), name(turn)).when(known & (kind == "result"), name(turn - 1)).alias("call_id"),
        F.when(kind == "call", F.lit("reply")).alias("name"),
        F.when(kind == "call", F.to_json(F.struct(turn.alias("turn"), text.alias("prompt"), F.length(text).alias("chars")))).alias("arguments"),
        text.alias("content"),
        F.when(known & (kind == "call"), F.array(name(turn - 2))).alias("after"),
    )


def op_query(conversations: DataFrame) -> DataFrame:
    return linked(as_calls(conversations), REPLY)


ORACLE = """
WITH RECURSIVE m AS (
  SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'plain' END AS kind FROM conversations
), k AS (
  SELECT *, CASE kind WHEN 'call' THEN conv_id || ':' || turn WHEN 'result' THEN conv_id || ':' || (turn - 1) END AS call_id,
    CASE kind WHEN 'call' THEN conv_id || ':' || (turn - 2) END AS parent FROM m
), calls AS (SELECT conv_id, call_id, min(turn) AS call_turn, min(parent) AS parent FROM k WHERE kind = 'call' GROUP BY ALL
), results AS (SELECT conv_id, call_id, min(turn) AS result_turn FROM k WHERE kind = 'result' GROUP BY ALL
), chain AS (
  SELECT call_id, 0 AS level FROM calls WHERE parent NOT IN (SELECT call_id FROM calls)
  UNION ALL SELECT c.call_id, chain.level + 1 FROM chain JOIN calls c ON c.parent = chain.call_id
), j AS (
  SELECT k.*, c.call_turn, r.result_turn, chain.level AS lv FROM k LEFT JOIN calls c USING (call_id) LEFT JOIN results r USING (call_id) LEFT JOIN chain USING (call_id)
)
SELECT conv_id, turn, kind, call_id,
  CASE WHEN kind = 'plain' THEN 'plain' WHEN kind = 'call' AND turn > call_turn THEN 'duplicate' WHEN kind = 'result' AND call_turn IS NULL THEN 'orphan'
    WHEN kind = 'result' AND turn > result_turn THEN 'duplicate' WHEN kind = 'call' AND result_turn IS NULL THEN 'pending' ELSE 'linked' END AS status,
  CASE WHEN kind = 'plain' THEN -1 ELSE lv END AS level,
  CASE WHEN kind = 'plain' THEN turn ELSE coalesce(call_turn, turn) END AS call_turn,
  CASE WHEN kind = 'result' THEN 1 ELSE 0 END AS step,
  CASE WHEN kind = 'call' THEN concat_ws('; ', CASE WHEN length(text) < 8 THEN 'chars: range' END, CASE WHEN length(text) NOT BETWEEN 1 AND 1500 THEN 'prompt: range' END) END AS errors,
  CASE kind WHEN 'call' THEN json_object('arguments', json_object('chars', length(text), 'prompt', text, 'turn', turn), 'call_id', call_id, 'name', 'reply', 'role', 'assistant')
    WHEN 'result' THEN json_object('call_id', call_id, 'content', text, 'role', 'tool') ELSE json_object('content', text, 'role', role) END::VARCHAR AS json
FROM j
"""
