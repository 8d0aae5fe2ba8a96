"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability, the logistic
of a bias and a sum of word weights; the document's is their noisy-or,
1 - prod(1 - p). Only document labels are needed to train it, and
the sentence probabilities then say where the offence is. Only sentences
count whose log-odds lie more than MARGIN above the bias: all
others say no more than that they are sentences, and a text isn't offensive by its length.
That holds in training as in scoring: after the first half (OPEN) of its rounds, which find out what
sentences might count for, the likelihood is that of the scores.

The classifier is fitted on at most max_train_docs labelled documents of at
most max_train_bytes bytes in all (in the order of seeded hashes; both are
parameters), on the driver; a document of over a quarter of max_train_bytes, or
one that no longer fits, is passed over. All documents are scored, in whole.

Edge cases: a null or empty text has no sentence and scores 0; a very
long one is scored sentence by sentence. A null doc_id is scored like any other,
is never a training row, and its held_out is null; of labels that contradict one
another the largest counts; null labels are ignored. Without any labelled
document of both kinds every score is 0; if only the bounds leave one kind out,
that is an error. Repeated rows score the same. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_steps

MAX_TRAIN_DOCS = 12_000
MAX_TRAIN_BYTES = 64 << 20
#: Log-odds above the bias from which on a sentence counts.
MARGIN = 4.0
#: The share of training rounds in which all sentences count.
OPEN = 0.5
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
#: Word starts of these lengths are features beside the whole word: offensive stems are inflected and compounded.
STARTS = range(3, 8)


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in STARTS if k <= len(word))]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int, max_bytes: int) -> list[tuple[str, int]]:
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_fx_toxic"))
    known = known.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "_fx_toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    sizes = found.groupBy("doc_id", "_fx_toxic").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, fit = 0, []
    for x in sizes:
        if x.n <= max_bytes // 4 and total + x.n <= max_bytes:
            total += x.n
            fit.append(x)
    if len({x._fx_toxic for x in fit}) < len({x._fx_toxic for x in sizes}):
        raise ValueError("max_bytes leaves no labelled document of one kind")
    if len(fit) < len(sizes):
        found = found.where(F.col("doc_id").isin([x.doc_id for x in fit]))
    return [(x.text, x._fx_toxic) for x in found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()]


def fit(rows: list[tuple[str, int]], min_docs: int = 4, rounds: int = 300, rate: float = 0.1, l1: float = 5e-5) -> tuple[dict[str, float], float]:
    """Feature weights and the bias: full-batch Adam on the documents' log-likelihood under noisy-or, with an L1 shrinkage.

    In the last rounds only those sentences count that would when texts are
    scored, and of a toxic document that has none of them its worst one, which so may yet become one.
    """
    if len({y for _, y in rows}) < 2:
        return {}, -math.inf
    toxic, seen = Counter(), Counter()
    for text, y in rows:
        if y:
            toxic.update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    toxic = {f: n for f, n in toxic.items() if n >= min_docs}
    for text, _ in rows:
        seen.update({f for w in set(WORD.findall(text.lower())) for f in features(w) if f in toxic})
    base = sum(bool(y) for _, y in rows) / len(rows)
    # a feature must be more frequent in toxic documents than chance allows; the rest can't raise a sentence's probability
    vocab = {f: k for k, f in enumerate(sorted(f for f, n in toxic.items() if n - seen[f] * base > 3 * math.sqrt(seen[f] * base * (1 - base))))}
    made: dict[str, tuple[int, ...]] = {}
    idx, sent_of, doc_of, plain = array("q"), array("q"), array("q"), np.zeros(len(rows))
    for d, (text, _) in enumerate(rows):
        for s in SENTENCE.findall(text.lower()):
            ids: set[int] = set()
            for w in WORD.findall(s):
                if (found := made.get(w)) is None:
                    found = made[w] = tuple(vocab[f] for f in features(w) if f in vocab)
                ids.update(found)
            if ids:
                idx.extend(ids)
                sent_of.extend([len(doc_of)] * len(ids))
                doc_of.append(d)
            else:
                plain[d] += 1  # a sentence without features
    idx, sent_of, doc_of = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (idx, sent_of, doc_of))
    y = np.array([bool(t) for _, t in rows], float)
    w, b = np.zeros(len(vocab)), -6.0
    m, v, mb, vb = np.zeros(len(vocab)), np.zeros(len(vocab)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(sent_of, weights=w[idx], minlength=len(doc_of)) + b
        if t <= OPEN * rounds:
            counts, others = np.ones(len(z), bool), plain
        else:
            counts, others = z > b + MARGIN, np.zeros(len(rows))
            counts |= _witnesses(z, doc_of, (y > 0) & (np.bincount(doc_of, weights=counts, minlength=len(rows)) == 0))
        none = np.bincount(doc_of, weights=counts * np.logaddexp(0, z), minlength=len(rows)) + others * np.logaddexp(0, b)  # -log of no offence at all
        pull = np.where(y > 0, -1 / np.expm1(np.clip(none, 1e-9, 500)), 1.0)
        dz = counts * pull[doc_of] / (1 + np.exp(-z)) / len(rows)
        gw = np.bincount(idx, weights=dz[sent_of], minlength=len(vocab)) + l1 * np.sign(w)
        gb = dz.sum() + (pull * others).sum() / (1 + math.exp(-b)) / len(rows)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return {f: float(w[k]) for f, k in vocab.items() if abs(w[k]) > 1e-3}, b


def _witnesses(z: np.ndarray, doc_of: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which sentences are the worst one, the first of equals, of some documents. doc_of is in order."""
    out = np.zeros(len(z), bool)
    if len(z):
        first = np.flatnonzero(np.r_[True, doc_of[1:] != doc_of[:-1]])
        best = np.repeat(np.maximum.reduceat(z, first), np.diff(np.r_[first, len(z)]))
        at = np.flatnonzero(z == best)
        out[at[np.r_[True, doc_of[at[1:]] != doc_of[at[:-1]]]]] = True
    return out & docs[doc_of]


class Scorer:
    """Sentence and document probabilities; words' weights are remembered, up to a bound."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def word(self, w: str) -> tuple[float, ...]:
        found = tuple((f, self.weights[f]) for f in features(w) if f in self.weights)
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[w] = found
        return found

    def document(self, text: str) -> tuple[float, float, int, int]:
        """Score; probability, start and end (in characters) of the worst sentence."""
        none, worst, known = 0.0, (-math.inf, 0, 0), self.known
        for s in SENTENCE.finditer(text):
            hits: dict[str, float] = {}
            for w in WORD.findall(s[0].lower()):
                found = known.get(w)
                if found is None:
                    found = self.word(w)
                if found:
                    hits.update(found)
            z = self.bias + sum(hits.values())
            if z > self.bias + MARGIN:
                none += math.log1p(math.exp(z)) if z < 30 else z
            if z > worst[0]:
                worst = (z, s.start(), s.end())
        return -math.expm1(-none), 1 / (1 + math.exp(-max(worst[0], -700))), worst[1], worst[2]


def scored(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """doc_id, score, worst double, worst_start int, worst_end int."""

    def work(batches):
        scorer = Scorer(weights, bias)
        for b in in_steps(batches, "text"):
            got = [scorer.document(t or "") for t in b.column(1).to_pylist()]
            score, worst, start, end = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(worst, pa.float64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "score", "worst", "worst_start", "worst_end"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, score double, worst double, worst_start int, worst_end int")


def clean(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns."""

    def work(batches):
        scorer = Scorer(weights, bias)
        for b in in_steps(batches, "text"):
            yield b.filter(pa.array([scorer.document(t or "")[0] < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_bytes: int = MAX_TRAIN_BYTES) -> tuple[dict[str, float], float]:
    return fit(training_rows(docs, labels, max_docs, max_bytes))


def op_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the op10 contract, and the worst sentence's place."""
    return scored(docs, *train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst", "worst_start", "worst_end")
