"""Sentences and runs numbered as words arrive, in pieces of a document: what a batch over all words would give.

A document's state is what the next word needs: its index, the boundaries and
runs so far, the key of the last word, and the words that came too early. Words are numbered when all before them
have come; one that comes again is ignored, so pieces may be cut anywhere, be
out of order within what has arrived, overlap, or be sent twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.fixed_values import BOUNDARIES

OUT = "source_path string, word_index long, word string, reference string, sentence_index int, run int"
STATE = "next long, sentence int, run int, last string, early string"


def number_words(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One document's new words, numbered."""
    at, sentence, run, last, early = state.get if state.exists else (0, 0, 0, None, "[]")
    last = json.loads(last) if last is not None else None  # [reference] of the word before
    waiting = {k: (w, r) for k, w, r in json.loads(early)}
    for piece in pieces:
        for k, w, r in zip(piece["word_index"].tolist(), piece["word"].tolist(), piece["reference"].tolist(), strict=True):
            if k >= at:
                waiting.setdefault(int(k), (None if pd.isna(w) else w, None if pd.isna(r) else r))
    out = []
    while at in waiting:
        word, reference = waiting.pop(at)
        run += last != [reference]
        out.append((key[0], at, word, reference, sentence, run))
        last = [reference]
        sentence += (word or "").strip() in BOUNDARIES
        at += 1
    state.update((at, sentence, run, None if last is None else json.dumps(last), json.dumps([(k, w, r) for k, (w, r) in sorted(waiting.items())])))
    if out:
        yield pd.DataFrame(out, columns=["source_path", "word_index", "word", "reference", "sentence_index", "run"])


def numbered_words(words: DataFrame) -> DataFrame:
    """source_path, word_index, word, reference, sentence_index, run of a stream of words (source_path, word_index, word, reference); indexes of a document are from 0, without gaps.

    Rows without path or index take no part.
    """
    rows = words.select("source_path", F.col("word_index").cast("long").alias("word_index"), "word", "reference").where("source_path is not null and word_index is not null")
    return rows.groupBy("source_path").applyInPandasWithState(number_words, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
