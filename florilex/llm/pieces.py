"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

Texts of ordinary length are encoded whole by the sentencepiece library. A
giant document is cut into chunks which are encoded independently, and yet
give the library's tokens for the whole text:

* The public model is a BPE model. A token sequence is the BPE encoding of a
  text exactly if each two neighbours are the encoding of their own
  concatenation. So the encoding is the one path of finite weight in a lattice
  whose edges weigh 0 (neighbours agree) or minus infinity (they don't).
* The state at a cut is the token that ends at it or crosses it. A chunk's
  transfer matrix holds, for each state at its left end and each at its right
  end, the weight of the best path between them. As weights are 0 or minus
  infinity only, a row of a max-plus matrix is a set of bits, and the
  matrix product is an OR of rows.
* Matrices of neighbouring chunks are combined associatively, up a tree of
  RADIX children a node, level by level over all documents at once; then the
  two states at the ends of each node, from the root down, give those at
  the ends of its children. No task handles more than RADIX matrices of a
  document. Each chunk is then traced back by itself from the states at its ends.

Where no piece of the vocabulary has a space after another character, every
path has a token end before each space that follows another character. There,
a matrix has rank one, and what lies between a chunk's first and last such
place is encoded by the library.

Edge cases: null and empty texts have no tokens. Repeated rows are encoded each.
Very long texts are cut one at a time. An empty table gives an empty result. Texts with U+2581, which the model uses
for spaces, don't decode to themselves; `exact` is false for those. Columns to
carry along are named by the caller and may have any name but `ids` and `n_chunks`.
"""

from __future__ import annotations

import struct
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP, checkpoint, in_steps, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters from which a text is cut into chunks of about half as many.
GIANT = 50_000
#: Children of a node when matrices are combined.
RADIX = 8
SPACE = "▁"
START = (0, 0)


def model_bytes(spark: SparkSession, path: str = MODEL) -> bytes:
    """A vocabulary file (half a megabyte), from a local path or any store that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first().content)
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    """The model and its lattice. A token is its surface; one that isn't in the vocabulary is a single character."""

    def __init__(self, proto: bytes, limit: int = 300_000):
        self.sp, self.limit = sentencepiece.SentencePieceProcessor(model_proto=proto), limit
        sp = self.sp
        self.ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.parted = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}

    @cached_property
    def bytes_of(self) -> list[int]:
        return [self.sp.piece_to_id(f"<0x{k:02X}>") for k in range(256)]

    def merged(self, s: str) -> list[str]:
        """BPE of a short string: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(s)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                x = self.score.get(parts[k] + parts[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > self.limit:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def at(self, s: str, p: int) -> list[str]:
        """The tokens that begin at a place."""
        found = [t for n in range(2, min(self.longest, len(s) - p) + 1) if (t := s[p : p + n]) in self.ids]
        return [s[p], *found]

    def states(self, s: str, cut: int) -> list[tuple[int, int]]:
        """The states at a cut, as (characters before the cut, length)."""
        return [(cut - i, len(t)) for i in range(max(0, cut - self.longest), cut) for t in self.at(s, i) if i + len(t) >= cut]

    def walk(self, s: str, sources: list[tuple[int, str]], stop: int) -> tuple[dict, dict]:
        """From the sources (end, token), each a bit, over all paths to tokens that end at or beyond stop.

        Returns those as {(begin, token): bits}, and for each token on the way the bits that reach it.
        """
        alive: dict[int, dict[str, int]] = {}
        ends: dict[tuple[int, str], int] = {}
        for k, (end, t) in enumerate(sources):
            if end >= stop:
                ends[end - len(t), t] = ends.get((end - len(t), t), 0) | 1 << k
            else:
                row = alive.setdefault(end, {})
                row[t] = row.get(t, 0) | 1 << k
        for p in range(min(alive, default=stop), stop):
            here = alive.get(p)
            for u in self.at(s, p) if here else ():
                bits = 0
                for t, b in here.items():
                    if b | bits != bits and self.agree(t, u):
                        bits |= b
                if bits:
                    if p + len(u) >= stop:
                        ends[p, u] = ends.get((p, u), 0) | bits
                    else:
                        row = alive.setdefault(p + len(u), {})
                        row[u] = row.get(u, 0) | bits
        return ends, alive

    def trace(self, s: str, start: int, first: str, goal: tuple[int, str]) -> list[str]:
        """The tokens after first, which ends at start, up to goal (begin, token)."""
        begin, t = goal
        if begin + len(t) == start and t == first:
            return []
        _, alive = self.walk(s, [(start, first)], begin + len(t))
        out = [t]
        while begin > start:
            t = next(x for x in alive[begin] if self.agree(x, out[-1]) and (begin - len(x) >= start or x == first))
            out.append(t)
            begin -= len(t)
        return out[::-1]

    def breaks(self, s: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and last place in lo..hi where all paths have a token end."""
        if not self.parted:
            return None
        places = [p for p in (self._next(s, lo, hi), self._last(s, lo, hi)) if p]
        return (places[0], places[1]) if len(places) == 2 and places[0] < places[1] else None

    @staticmethod
    def _next(s: str, lo: int, hi: int) -> int:
        p = s.find(SPACE, max(lo, 1))
        while 0 < p <= hi and s[p - 1] == SPACE:
            p = s.find(SPACE, p + 1)
        return p if 0 < p <= hi else 0

    @staticmethod
    def _last(s: str, lo: int, hi: int) -> int:
        p = s.rfind(SPACE, lo, hi + 1)
        while p > max(lo, 0) and s[p - 1] == SPACE:
            p = s.rfind(SPACE, lo, p)
        return p if p > max(lo, 0) else 0

    def transfer(self, s: str, a: int, b: int, first: bool) -> dict:
        """The transfer matrix of s[a:b], where s has some characters more on both sides."""
        entries = [START] if first else self.states(s, a)
        sources = [(a, "")] if first else [(a - x + n, s[a - x : a - x + n]) for x, n in entries]
        mid = self.breaks(s, a + self.longest, b - self.longest)
        if mid is None:
            ends, _ = self.walk(s, sources, b)
            exits = [(b - p, len(t)) for p, t in ends]
            rows = [sum(1 << j for j, bits in enumerate(ends.values()) if bits >> k & 1) for k in range(len(entries))]
        else:
            heads, _ = self.walk(s, sources, mid[0])
            tails, _ = self.walk(s, [(mid[1], "")], b)
            whole = 0
            for bits in heads.values():
                whole |= bits
            exits = [(b - p, len(t)) for p, t in tails]
            rows = [((1 << len(exits)) - 1) * (whole >> k & 1) for k in range(len(entries))]
        return {"entries": entries, "exits": exits, "rows": rows}

    def backtrace(self, s: str, a: int, b: int, entry: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """The token ids of s[a:b], after the entry state up to the one that it leaves by."""
        start, t = (a, "") if entry == START else (a - entry[0] + entry[1], s[a - entry[0] : a - entry[0] + entry[1]])
        goal = (b - leave[0], s[b - leave[0] : b - leave[0] + leave[1]])
        mid = self.breaks(s, a + self.longest, b - self.longest)
        if mid is None:
            return self.numbers(self.trace(s, start, t, goal))
        ends, _ = self.walk(s, [(start, t)], mid[0])
        return self.numbers(self.trace(s, start, t, next(iter(ends)))) + self.sp.encode(s[mid[0] + 1 : mid[1]].replace(SPACE, " ")) + self.numbers(self.trace(s, mid[1], "", goal))

    def numbers(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for t in tokens:
            if t in self.ids:
                out.append(self.ids[t])
            else:
                out += [self.bytes_of[x] for x in t.encode()]
        return out


def combine(a: dict, b: dict) -> dict:
    """The max-plus product of two neighbouring transfer matrices."""
    at = {tuple(x): k for k, x in enumerate(b["entries"])}
    through = [b["rows"][at[tuple(x)]] if tuple(x) in at else 0 for x in a["exits"]]
    rows = []
    for bits in a["rows"]:
        out = 0
        for k, row in enumerate(through):
            if bits >> k & 1:
                out |= row
        rows.append(out)
    return {"entries": a["entries"], "exits": b["exits"], "rows": rows}


def solve(matrices: list[dict], entry: tuple[int, int] = START, leave: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """The state at each cut, from the first to the last; at the end of a text the state is the token that ends there."""
    here, reached = {entry}, []
    for m in matrices:
        bits = 0
        for x, row in zip(m["entries"], m["rows"], strict=True):
            if tuple(x) in here:
                bits |= row
        here = {tuple(x) for k, x in enumerate(m["exits"]) if bits >> k & 1}
        reached.append(here)
    path = [leave or next(x for x in here if x[0] == x[1])]
    for k in range(len(matrices) - 1, 0, -1):
        m = matrices[k]
        j = [tuple(x) for x in m["exits"]].index(path[-1])
        path.append(next(tuple(x) for x, row in zip(m["entries"], m["rows"], strict=True) if row >> j & 1 and tuple(x) in reached[k - 1]))
    return [entry, *reversed(path)]


def packed(m: dict) -> bytes:
    """A transfer matrix as bytes: states, then each row's bits."""
    width = (len(m["exits"]) + 7) // 8
    states = np.array([*m["entries"], *m["exits"]], "<u2").reshape(-1, 2)
    return struct.pack("<HHH", len(m["entries"]), len(m["exits"]), width) + states.tobytes() + b"".join(r.to_bytes(width, "little") for r in m["rows"])


def unpacked(blob: bytes) -> dict:
    n, m, width = struct.unpack_from("<HHH", blob)
    states = [tuple(x) for x in np.frombuffer(blob, "<u2", 2 * (n + m), 6).reshape(-1, 2).tolist()]
    at = 6 + 4 * (n + m)
    return {"entries": states[:n], "exits": states[n:], "rows": [int.from_bytes(blob[at + k * width : at + (k + 1) * width], "little") for k in range(n)]}


def scanned(matrices: DataFrame) -> DataFrame:
    """(_fx_row, _fx_chunk, states) from (_fx_row, _fx_chunk, matrix): the states at both ends of each chunk, by a tree of combinations."""
    ids = ["_fx_row", "_fx_chunk"]
    node = F.floor(F.col("_fx_chunk") / RADIX).cast("int").alias("_fx_node")
    levels = [stored(matrices, "matrices")]
    most = levels[0].agg(F.max("_fx_chunk")).first()[0] or 0

    def up(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("_fx_chunk").to_pylist(), table.column("matrix").to_pylist(), strict=True))
        m = unpacked(rows[0][1])
        for _, x in rows[1:]:
            m = combine(m, unpacked(x))
        return pa.table({"_fx_row": table.column("_fx_row").slice(0, 1), "_fx_chunk": pa.array([rows[0][0] // RADIX], pa.int32()), "matrix": pa.array([packed(m)], pa.binary())})

    while most > 0:
        levels.append(stored(levels[-1].groupBy("_fx_row", node).applyInArrow(up, "_fx_row long, _fx_chunk int, matrix binary"), "matrices"))
        most //= RADIX

    def down(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_fx_chunk").to_numpy())
        ends = table.column("ends")[0].as_py()
        path = solve([unpacked(table.column("matrix")[int(k)].as_py()) for k in order], START if ends is None else (ends[0], ends[1]), None if ends is None else (ends[2], ends[3]))
        t = table.select(ids).take(pa.array(order))
        return t.append_column("states", pa.array([[*x, *y] for x, y in zip(path, path[1:], strict=False)], pa.list_(pa.int32())))

    # a text's ends are known; a text of one chunk is its own node
    states = levels[-1].select("_fx_row", F.col("_fx_chunk").alias("_fx_node"), F.lit(None).cast("array<int>").alias("ends"))
    for level in reversed(levels[:-1] or levels):
        met = level.select(*ids, "matrix", node).join(states, ["_fx_row", "_fx_node"])
        states = met.groupBy("_fx_row", "_fx_node").applyInArrow(down, "_fx_row long, _fx_chunk int, states array<int>")
        states = checkpoint(states).select("_fx_row", F.col("_fx_chunk").alias("_fx_node"), F.col("states").alias("ends"))
    return states.select("_fx_row", F.col("_fx_node").alias("_fx_chunk"), F.col("ends").alias("states"))


def cuts(n: int, size: int) -> list[int]:
    parts = max(1, round(n / size))
    return [n * k // parts for k in range(parts + 1)]


def as_lists(ids: list[list[int]]) -> pa.ListArray:
    """Lists of numbers as an Arrow array, by way of one flat array."""
    offsets = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(offsets.astype(np.int32), np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1]))


def from_lists(array: pa.ListArray) -> list[list[int]]:
    flat, ends = array.flatten().to_numpy().tolist(), array.offsets.to_pylist()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)]


def encode(docs: DataFrame, proto: bytes, keep: list[str], giant: int = GIANT) -> DataFrame:
    """The kept columns, ids array<int> and n_chunks int of each row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(proto)
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_chunks", T.IntegerType())])

    def small(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for b in in_steps(batches, "text"):
            ids = [sp.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], as_lists(ids), pa.array([1] * b.num_rows, pa.int32())], schema.names)

    plain = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= giant).select(*keep, *[c for c in ["text"] if c not in keep]).mapInArrow(small, schema)

    longest = Pieces(proto).longest
    rows = docs.where(F.length("text") > giant).select(F.monotonically_increasing_id().alias("_fx_row"), F.struct(*keep).alias("_fx_keep"), "text")
    cut_schema = T.StructType([rows.schema["_fx_row"], rows.schema["_fx_keep"], T.StructField("_fx_chunk", T.IntegerType()), T.StructField("_fx_last", T.BooleanType()), T.StructField("_fx_lead", T.IntegerType()), T.StructField("_fx_end", T.IntegerType()), T.StructField("_fx_text", T.StringType())])

    def cut(batches):
        for b in in_steps(batches, "text"):
            for i, t in enumerate(b.column("text").to_pylist()):
                s = SPACE + t.replace(" ", SPACE)
                at = cuts(len(s), giant // 2)
                n = len(at) - 1
                lead = [min(a, longest) for a in at[:-1]]
                parts = [s[a - x : e + longest] for a, e, x in zip(at, at[1:], lead, strict=False)]
                one = b.slice(i, 1)
                idx = pa.array([0] * n)
                yield pa.RecordBatch.from_arrays([one.column("_fx_row").take(idx), one.column("_fx_keep").take(idx), pa.array(range(n), pa.int32()), pa.array([k == n - 1 for k in range(n)]), pa.array(lead, pa.int32()), pa.array([x + e - a for a, e, x in zip(at, at[1:], lead, strict=False)], pa.int32()), pa.array(parts)], cut_schema.names)

    chunks = stored(rows.mapInArrow(cut, cut_schema).repartition("_fx_row", "_fx_chunk"), "chunks")
    if chunks.isEmpty():
        return plain

    def transfer(batches):
        p = Pieces(model.value)
        for b in in_steps(batches, "_fx_text"):
            got = [packed(p.transfer(t, a, e, k == 0)) for t, a, e, k in zip(*(b.column(c).to_pylist() for c in ("_fx_text", "_fx_lead", "_fx_end", "_fx_chunk")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_fx_row"), b.column("_fx_chunk"), pa.array(got, pa.binary())], ["_fx_row", "_fx_chunk", "matrix"])

    spread = chunks.repartition("_fx_row", "_fx_chunk")
    states = scanned(spread.select("_fx_row", "_fx_chunk", "_fx_text", "_fx_lead", "_fx_end").mapInArrow(transfer, "_fx_row long, _fx_chunk int, matrix binary"))

    def back(batches):
        p = Pieces(model.value)
        for b in in_steps(batches, "_fx_text"):
            got = [p.backtrace(t, a, e, (x[0], x[1]), (x[2], x[3])) for t, a, e, x in zip(*(b.column(c).to_pylist() for c in ("_fx_text", "_fx_lead", "_fx_end", "states")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_fx_row"), b.column("_fx_keep"), b.column("_fx_chunk"), pa.array(got, pa.list_(pa.int32()))], ["_fx_row", "_fx_keep", "_fx_chunk", "ids"])

    traced = spread.join(states, ["_fx_row", "_fx_chunk"]).select("_fx_row", "_fx_keep", "_fx_chunk", "_fx_text", "_fx_lead", "_fx_end", "states")
    back_schema = T.StructType([rows.schema["_fx_row"], rows.schema["_fx_keep"], T.StructField("_fx_chunk", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    whole = traced.mapInArrow(back, back_schema).groupBy("_fx_row").agg(F.first("_fx_keep").alias("k"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_fx_chunk", "ids"))), lambda x: x["ids"])).alias("ids"), F.count("*").cast("int").alias("n_chunks"))
    return plain.unionByName(whole.select(*[F.col("k")[c].alias(c) for c in keep], "ids", "n_chunks"))


def decode(tokens: DataFrame, proto: bytes) -> DataFrame:
    """Adds the decoded text to rows with ids."""
    model = tokens.sparkSession.sparkContext.broadcast(proto)
    names = tokens.columns

    def work(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for b in in_steps(batches, "ids", STEP // 4):
            texts = sp.decode(from_lists(b.column("ids"))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return tokens.mapInArrow(work, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))


def op_query(docs: DataFrame, path: str = MODEL, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_chunks, ids_hash (of the ids), decoded_sha256, and whether decoding gives the text back; the ids, if they are to be kept."""
    proto = model_bytes(docs.sparkSession, path)
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    out = decode(encode(named, proto, ["doc_id", "text_sha256"]), proto)
    kept = ["ids"] if keep_ids else []
    return out.select("doc_id", F.size("ids").alias("n_tokens"), "n_chunks", F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("exact"), *kept)
