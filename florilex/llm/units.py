"""Repeated lines and runs of sentences, by hashing normalised units.

A unit is a line with any word at all, or, within a line, a sentence with as
many of those that follow as it takes to have min_words words, or a paragraph:
a run of consecutive lines that each have fewer. So a passage is found that
begins and ends amid a line, whatever the length of its sentences, and one laid
out over short lines.
Its digest is the 128-bit XXH3 of its words, case-folded (A-Z and all other
cased letters) and joined by one space. Among the units of one digest, the one
that ranks first by document and place is kept; all others are removed, and
removals carry the character offsets in the original text.

First occurrences are minima, pre-aggregated before the shuffle. The units that
most documents share are joined back by a broadcast of their digests (a bounded
number), all others by a shuffle.

Edge cases: null and empty texts have no units. A document is its doc_id and
text. A null doc_id ranks after all others; documents without one, or with the
same one, rank by a hash of their text. Within one document later repeats go as
well. Repeated rows (same doc_id and text) tie: their units have the same rank,
so all of them stay. Very long texts are handled one at a time. Empty tables
give empty results. Other columns are ignored by `removals` and kept by
`deduplicated`, whose spans take the place of a column of that name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_steps, join_counted, stored

MIN_WORDS = 10
LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"\S.*?(?:[.!?]+(?=\s)|$)")
LAST = 2**63 - 1
DOC = ["_fx_key", "_fx_key2"]


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit."""
    found, paragraph = [], []

    def close():
        if len(paragraph) > 1:
            found.append((paragraph[0][0], paragraph[-1][1], " ".join(x for *_, x in paragraph)))
        paragraph.clear()

    for line in LINE.finditer(text):
        begin = line.start()
        parts = [(begin + s.start(), begin + s.end(), s[0].lower().split()) for s in SENTENCE.finditer(line[0])]
        sizes, norms = [len(w) for *_, w in parts], [" ".join(w) for *_, w in parts]
        if paragraph and paragraph[-1][1] + 1 != begin:  # an empty line between
            close()
        if not sum(sizes):
            close()
            continue
        found.append((begin, line.end(), " ".join(norms)))
        if sum(sizes) < min_words:
            paragraph.append(found[-1])
            continue
        close()
        end, total = 0, 0
        for i in range(len(parts)):
            while end < len(parts) and total < min_words:
                total += sizes[end]
                end += 1
            if total < min_words:
                break
            if end - i < len(parts):
                found.append((parts[i][0], parts[end - 1][1], " ".join(norms[i:end])))
            total -= sizes[i]
    close()
    return [(a, b, xxhash.xxh3_128_digest(x)) for a, b, x in found]


def _identified(docs: DataFrame, *columns) -> DataFrame:
    """docs' columns with 128 bits that stand for a document, by its doc_id and text."""
    return docs.select(F.xxhash64("doc_id", "text").alias(DOC[0]), F.xxhash64(F.lit(1), "doc_id", "text").alias(DOC[1]), *columns)


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d1, d2, rank_doc, _fx_key, _fx_key2, start, end): digest halves, document and character range of each unit."""
    schema = f"d1 long, d2 long, rank_doc long, {DOC[0]} long, {DOC[1]} long, start int, end int"

    def work(batches):
        for b in in_steps(batches, "text"):
            found = [units(t, min_words) if t else [] for t in b.column("text").to_pylist()]
            times = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            halves = np.frombuffer(b"".join(u[2] for x in found for u in x), "<i8").reshape(-1, 2)
            owner = [b.column(c).take(pa.array(times)) for c in ("rank_doc", *DOC)]
            places = [pa.array([u[k] for x in found for u in x], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), *owner, *places], ["d1", "d2", "rank_doc", *DOC, "start", "end"])

    return _identified(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank_doc"), "text").mapInArrow(work, schema)


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end of each removed unit, with first_doc_id and first_start of the one that is kept; and _fx_key, _fx_key2, the document's hashes."""
    found = stored(unit_table(docs, min_words), "units")
    place = F.struct("rank_doc", *DOC, "start")
    first = stored(found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    back = lambda c: F.when(c != LAST, c)
    return (
        join_counted(found, first, ["d1", "d2"])
        .where(place > F.col("first"))
        .select(back(F.col("rank_doc")).alias("doc_id"), "start", "end", back(F.col("first.rank_doc")).alias("first_doc_id"), F.col("first.start").alias("first_start"), *DOC)
    )


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with its text less the removed units, and spans, the kept (start, end) ranges of the original text."""
    docs = docs.drop("spans")
    gone = removals(docs, min_words).groupBy(*DOC).agg(F.collect_set(F.struct("start", "end")).alias("_fx_gone"))
    names = docs.columns
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", spans)])

    def work(batches):
        for b in in_steps(batches, "text"):
            texts, kept = [], []
            for t, holes in zip(b.column("text").to_pylist(), b.column("_fx_gone").to_pylist(), strict=True):
                if t is None:
                    texts.append(None)
                    kept.append([])
                    continue
                at, mine = 0, []
                for h in sorted(holes or [], key=lambda h: (h["start"], h["end"])):
                    if h["start"] > at:
                        mine.append({"start": at, "end": h["start"]})
                    at = max(at, h["end"])
                if at < len(t):
                    mine.append({"start": at, "end": len(t)})
                texts.append("".join(t[s["start"] : s["end"]] for s in mine))
                kept.append(mine)
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [*names, "spans"])

    return _identified(docs, "*").join(gone, DOC, "left").drop(*DOC).mapInArrow(work, schema)


def op_query(docs: DataFrame) -> DataFrame:
    return removals(docs).drop(*DOC)
