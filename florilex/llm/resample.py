"""Importance resampling of documents towards a target distribution of hashed word runs.

A first pass counts the buckets of all features; the logarithms of the ratios
to the target's are an array of a fixed number of gains. A second pass scores
each document from that array and adds a noise that its id decides (so that
the highest scores are a draw without replacement). Each partition of the
eligible documents is sorted into a run, and written as segments that end at
the borders of ranges of the order; the borders come from a bounded sample, the
ranges' sizes are counted. Only those ranges that the draw reaches are merged,
each by a tournament tree over the runs whose segments it has opened; segments
arrive in the order of their first rows, so a merge holds one segment a run.
It stops at the exact number of the draw; a row's rank is its range's offset and
its place in the merge.

Edge cases: null and empty texts have no features, the weight 0 and are never
eligible (unless no words are asked for). A null doc_id is hashed as an empty
one and comes after all others at a tie; rows that tie in everything get ranks of
their own. Very long texts are read in stretches. An empty target has gains
that only depend on the documents; empty documents give no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import sampled
from .common import bounded_batches, in_steps, stored, text_bytes
from .terms import Words

WORDS = Words(rb"0-9a-z\x80-\xff")
#: Words in a feature at most, buckets, per cent of the eligible that are drawn, words of an eligible document, seed.
RUN, BUCKETS, PERCENT, MIN_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Rows in a segment, rows in a range on average, ranges at most, rows that borders are taken from.
SEGMENT, RANGE, RANGES, SAMPLE = 4096, 8192, 4096, 1 << 16
LAST = (1 << 63) - 1


class _Buckets(dict):
    """feature -> bucket, remembered for a bounded number of features."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.buckets
        return out


def features(text: bytes, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words, features) of each stretch of a text: all runs of 1 to most words; a stretch begins with the last words of the one before."""
    tail: list[bytes] = []
    for words in WORDS.lists(text):
        both, new = tail + words, list(words)
        for n in range(2, most + 1):
            new += [b" ".join(both[k : k + n]) for k in range(max(0, len(tail) - n + 1), len(both) - n + 1)]
        tail = both[len(both) - most + 1 :] if most > 1 else []
        yield len(words), new


def histogram(texts: DataFrame, most: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column text, as bytes) each bucket has; a task hands on its sums."""

    def work(batches):
        known, out = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in in_steps(batches, "text"):
            found = list(map(known.__getitem__, chain.from_iterable(f for t in b.column("text").to_pylist() for _, f in features(t, most))))
            out += np.bincount(np.array(found, np.int64), minlength=buckets)
        at = np.nonzero(out)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for x in texts.select("text").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many as there are buckets
        out[x["bucket"]] = x["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The thousandfold logarithm of each bucket's share in the target over that in the source, smoothed by one."""
    s, t, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((y + 1) * (s + buckets) / ((x + 1) * (t + buckets)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, most: int = RUN, seed: int = SEED) -> DataFrame:
    """row (a number of its own), doc_id, n_words, n_features, weight, score of each document, stored."""

    def work(batches):
        known = _Buckets(len(gain))
        for b in in_steps(batches, "text"):
            ids, n_words, n_features, weights = b.column("doc_id").to_pylist(), [], [], []
            for text in b.column("text").to_pylist():
                words = n = weight = 0
                for count, found in features(text, most):
                    words, n = words + count, n + len(found)
                    weight += int(gain[np.fromiter(map(known.__getitem__, found), np.int64, len(found))].sum())
                n_words.append(words)
                n_features.append(n)
                weights.append(weight)
            scores = [w + noise(d, seed) for w, d in zip(weights, ids, strict=True)]
            columns = [b.column("row"), b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights, scores))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return stored(rows.mapInArrow(work, "row long, doc_id long, n_words long, n_features long, weight long, score long"), "scored")


class Tournament:
    """The least head of several sorted sources, by a tree of winners: its leaves are the sources, and a change of one replays the games on its way to the root only."""

    def __init__(self):
        self.size, self.free, self.heads, self.winners = 1, [0], [None], [0, 0]

    def _play(self, leaf: int) -> None:
        at = (leaf + self.size) >> 1
        while at:
            a, b = (self.winners[2 * at], self.winners[2 * at + 1]) if 2 * at < self.size else (2 * at - self.size, 2 * at + 1 - self.size)
            x, y = self.heads[a], self.heads[b]
            self.winners[at] = a if y is None or x is not None and x <= y else b
            at >>= 1

    def open(self, head) -> int:
        """A new source, by its first head; the leaf that it got."""
        if not self.free:
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.heads += [None] * self.size
            self.size *= 2
            self.winners = [0] * self.size
            for leaf in range(0, self.size, 2):
                self._play(leaf)
        leaf = self.free.pop()
        self.put(leaf, head)
        return leaf

    def put(self, leaf: int, head) -> None:
        """A source's next head; None ends it."""
        self.heads[leaf] = head
        if head is None:
            self.free.append(leaf)
        self._play(leaf)

    def least(self) -> tuple[int, object]:
        leaf = self.winners[1] if self.size > 1 else 0
        return leaf, self.heads[leaf]


def merged(segments: Iterator[list[tuple]]) -> Iterator[tuple]:
    """All rows of sorted segments, which come in the order of their first rows, in order. A segment is opened when its first row may be next."""
    tree, rest = Tournament(), {}
    coming = next(segments, None)
    while True:
        leaf, head = tree.least()
        while coming is not None and (head is None or coming[0] < head):
            rows = iter(coming)
            rest[tree.open(next(rows))] = rows
            coming = next(segments, None)
            leaf, head = tree.least()
        if head is None:
            return
        yield head
        tree.put(leaf, next(rest[leaf], None))


def _segments(borders: list[tuple]):
    """Sorted (key, doc, row) rows of one partition, as packed segments within the ranges between borders."""

    def work(batches):
        run = TaskContext.get().partitionId()
        for b in batches:
            columns = [b.column(c).to_numpy() for c in ("key", "doc", "row")]
            rows = list(zip(*(c.tolist() for c in columns), strict=True))
            at, out = 0, []
            while at < len(rows):
                number = bisect_right(borders, rows[at])  # a border belongs to the range after it
                end = min(at + SEGMENT, bisect_left(rows, borders[number], at) if number < len(borders) else len(rows))
                out.append((number, run, *rows[at], end - at, *(c[at:end].tobytes() for c in columns)))
                at = end
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(SEGMENTS, x, strict=True)) for x in out], pa.schema([(n, pa.int32() if n in ("number", "run") else pa.binary() if n.endswith("s") else pa.int64()) for n in SEGMENTS]))

    return work


SEGMENTS = ["number", "run", "key", "doc", "row", "n", "keys", "docs", "rows"]


def drawn(scores: DataFrame, draw: int, eligible: int) -> DataFrame:
    """row, rank of the first `draw` rows (row, doc_id, score; `eligible` in all) by descending score and ascending doc_id."""
    spark = scores.sparkSession
    keyed = scores.select((-F.col("score")).alias("key"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "row")
    ranges = max(1, min(RANGES, eligible // RANGE))
    sample = sorted(tuple(x) for x in sampled(keyed, F.col("row"), SAMPLE, eligible).collect()) if ranges > 1 else []
    borders = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)})
    runs = keyed.sortWithinPartitions("key", "doc", "row").mapInArrow(_segments(borders), "number int, run int, key long, doc long, row long, n long, keys binary, docs binary, rows binary")
    runs = stored(runs, "runs", "lz4_raw")
    sizes = {x["number"]: x["n"] for x in runs.groupBy("number").agg(F.sum("n").alias("n")).collect()}  # as many as there are ranges
    before, offsets = 0, {}
    for number in sorted(sizes):
        if before < draw:
            offsets[number] = before
        before += sizes[number]
    if not offsets:
        return spark.createDataFrame([], "row long, rank long")

    def work(batches):
        rows = ({c: b.column(c)[k].as_py() for c in ("number", "keys", "docs", "rows")} for b in batches for k in range(b.num_rows))
        held = next(rows, None)
        while held is not None:
            number, left = held["number"], [held]

            def segments(number=number, left=left):
                while left and left[0] is not None and left[0]["number"] == number:
                    x = left[0]
                    left[0] = next(rows, None)
                    yield list(zip(*(np.frombuffer(x[c], np.int64).tolist() for c in ("keys", "docs", "rows")), strict=True))

            rank, out = offsets[number], []
            most = draw - rank
            for key in merged(segments()):
                if len(out) == SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(np.arange(rank + 1, rank + 1 + len(out)))], ["row", "rank"])
                    rank, most, out = rank + len(out), most - len(out), []
                if len(out) >= most:
                    break
                out.append(key[2])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(np.arange(rank + 1, rank + 1 + len(out)))], ["row", "rank"])
            while left[0] is not None and left[0]["number"] == number:  # what lies beyond the draw
                left[0] = next(rows, None)
            held = left[0]

    order = ["number", "key", "doc", "row"]
    return runs.where(F.col("number") <= max(offsets)).repartition("number").sortWithinPartitions(*order).mapInArrow(work, "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = MIN_WORDS, most: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if it isn't drawn) of every document. docs: doc_id, text; target: text."""
    bounded_batches(docs.sparkSession)
    gain = gains(histogram(docs.select(text_bytes().alias("text")), most, buckets), histogram(target.select(text_bytes().alias("text")), most, buckets))
    scores = scored(docs, gain, most, seed)
    eligible = scores.where(F.col("n_words") >= least)
    n = eligible.count()
    ranks = drawn(eligible, percent * n // 100, n)
    return scores.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)


#: The checksum goes byte by byte through the table of the reflected polynomial, for distinct words.
ORACLE = rf"""WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 m AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
 u AS (SELECT r, unnest(w) AS w FROM d),
 h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM (SELECT w FROM u UNION ALL SELECT w FROM m))),
 b AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, (2 * i - 1)::INT, 2))::BIGINT)), lambda a, y: xor(a >> 8, c.t[(xor(a, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM h, c),
 s AS (SELECT bucket, count(*) AS n FROM u JOIN b USING (w) GROUP BY bucket),
 t AS (SELECT bucket, count(*) AS n FROM m JOIN b USING (w) GROUP BY bucket),
 g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
 k AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM u JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
 n AS (SELECT d.r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN k ON k.r = d.r),
 e AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM n),
 o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS eligible FROM e WHERE n_features >= {MIN_WORDS})
 SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * eligible // 100 THEN rank END AS rank FROM e LEFT JOIN o USING (r)"""
