"""Ordered words into sentences, runs, segments and running text.

Order is a column, never the order of rows: windows are keyed by document and
sorted by place. All windows of a document share one exchange.

Where documents may be larger than what a task should hold, the same numbers
come from a prefix scan: windows are keyed by document and chunk, a summary of
each chunk (its boundaries and changes, its first and last key) is combined
over the chunks of a document, and added to what each chunk counts for itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fx
from ..functions.fixed_values import ATTACHED_LEFT, ATTACHED_RIGHT, NO_REF, NO_REUSE, SEPARATOR
from ..functions.vectors import loaded
from ..storage import stored

CHUNK = 5000


def mark_groups(df: DataFrame, part: list[str], order: list[str], boundary: Column, name: str = "sentence_index", chunk: Column | None = None) -> DataFrame:
    """Numbers groups of rows; a boundary row ends its group.

    chunk: cuts each part into stretches that follow one another (see `chunks` and `placed`); no task then sees more than a stretch.
    """
    if chunk is None:
        before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(boundary.cast("int")).over(before), F.lit(0)).cast("int"))
    df = df.withColumn("_fx_at", _stretch(part, chunk))
    ends = df.groupBy("_fx_at").agg(F.count_if(F.coalesce(boundary, F.lit(False))).alias("n"))
    marked = mark_groups(df, ["_fx_at"], order, boundary, "_fx_own")
    return marked.join(_summed(ends, F.col("n")), "_fx_at").withColumn(name, (F.col("_fx_own") + F.col("_fx_before")).cast("int")).drop("_fx_own", "_fx_before", "_fx_at")


def mark_runs(df: DataFrame, part: list[str], order: list[str], key: Column, name: str = "run", chunk: Column | None = None) -> DataFrame:
    """Numbers maximal runs of equal keys. chunk: as in `mark_groups`."""
    if chunk is None:
        w = Window.partitionBy(*part).orderBy(*order)
        same = F.lag(key).over(w).eqNullSafe(key) & (F.row_number().over(w) > 1)
        return df.withColumn("_fx_new", (~same).cast("int")).withColumn(name, F.sum("_fx_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_fx_new")
    df = df.withColumn("_fx_at", _stretch(part, chunk))
    at = F.struct(*order)
    marked = mark_runs(df, ["_fx_at"], order, key, "_fx_own")
    ends = marked.select("_fx_at", "_fx_own", at.alias("at"), F.struct(key).alias("key")).groupBy("_fx_at").agg(F.max("_fx_own").alias("n"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
    before = F.lag("last").over(Window.partitionBy("_fx_at.parts").orderBy("_fx_at.chunk"))
    ends = ends.withColumn("_fx_on", F.coalesce(before == F.col("first"), F.lit(False)).cast("int"))  # its first run is the last one of the chunk before
    marked = marked.join(_summed(ends, F.col("n") - F.col("_fx_on"), "_fx_on"), "_fx_at")
    return marked.withColumn(name, (F.col("_fx_own") + F.col("_fx_before") - F.col("_fx_on")).cast("int")).drop("_fx_own", "_fx_before", "_fx_on", "_fx_at")


def running_count(df: DataFrame, part: list[str], order: list[str], counts: Column, name: str, chunk: Column | None = None) -> DataFrame:
    """How many rows up to and with this one count. chunk: as in `mark_groups`."""
    before = mark_groups(df, part, order, counts, name, chunk)
    return before.withColumn(name, (F.col(name) + F.coalesce(counts, F.lit(False)).cast("int")).cast("int"))


def chunks(place: str, size: int = CHUNK) -> Column:
    """Stretches by a number that rows have within their part, such as a word's index."""
    return F.floor(F.col(place) / size)


def placed(df: DataFrame, part: list[str], order: list[str], name: str = "chunk") -> DataFrame:
    """Rows of any order with a chunk: ranges over parts and order, of about as many rows each, so that a large part lies in many of them."""
    ranged = df.repartitionByRange(*part, *order)
    return stored(ranged.withColumn(name, F.spark_partition_id().cast("long")), "placed")


def _stretch(part: list[str], chunk: Column) -> Column:
    """The key of a part's chunk; as a struct it is equal to itself also where a part is null."""
    return F.struct(F.struct(*part).alias("parts"), chunk.cast("long").alias("chunk"))


def _summed(ends: DataFrame, n: Column, *more: str, fan: int = CHUNK) -> DataFrame:
    """_fx_at, _fx_before (the sum of n over the chunks of its part that come before it) and more of each chunk; in two levels, so that no window has many more than fan rows."""
    ends = ends.select("_fx_at", n.alias("n"), *more, F.struct("_fx_at.parts", F.floor(F.col("_fx_at.chunk") / fan).alias("chunk")).alias("top"))
    sums = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(by[0]).orderBy(by[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = ends.groupBy("top").agg(F.sum("n").alias("n")).select("top", sums("n", "top.parts", "top.chunk").alias("above"))
    return ends.withColumn("own", sums("n", "top", "_fx_at.chunk")).join(tops, "top").select("_fx_at", *more, (F.col("own") + F.col("above")).alias("_fx_before"))


def in_order(value: Column, order: list[str]) -> Column:
    """Aggregate: the values of a group as an array in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_fx_value")))), lambda x: x["_fx_value"])


def joined_distinct(values: Column, sentinels: list[str], otherwise: str) -> Column:
    """Distinct values in order of first occurrence, without sentinels, joined; a sentinel if none is left."""
    kept = F.array_distinct(F.filter(values, lambda v: ~F.coalesce(v, F.lit(sentinels[0])).isin(sentinels)))
    return F.when(F.size(kept) == 0, F.lit(otherwise)).otherwise(F.array_join(kept, SEPARATOR))


def line_range(lines: Column) -> Column:
    """'first' or 'first-last' of the distinct lines; 'o' if there is none."""
    kept = F.array_distinct(F.filter(lines, lambda v: F.coalesce(v, F.lit(NO_REF)) != NO_REF))
    return F.when(F.size(kept) == 0, F.lit(NO_REF)).when(F.size(kept) == 1, kept[0]).otherwise(F.concat_ws("-", kept[0], F.element_at(kept, -1)))


def _filled(words: DataFrame) -> DataFrame:
    return words.select(
        "source_path", "source_file", "word_index",
        F.when(F.coalesce("line", F.lit("")) == "", NO_REF).otherwise(fx.repair_line(F.col("line"))).alias("line"),
        F.coalesce("word", F.lit("")).alias("word"),
        F.coalesce("label", F.lit(NO_REUSE)).alias("label"),
        F.coalesce("reference", F.lit(NO_REF)).alias("initial"),
        F.coalesce("reference normalized", F.lit(NO_REF)).alias("ref"),
    )


def _row(df: DataFrame, text_name: str) -> DataFrame:
    """From arrays in order to a dataset row."""
    return df.select(
        "source_path", "source_file", "sentence_index",
        line_range(F.col("lines")).alias("line"),
        fx.attach_punctuation(F.array_join("words", " ")).alias(text_name),
        joined_distinct(F.col("labels"), [NO_REUSE, NO_REF], NO_REUSE).alias("label"),
        joined_distinct(F.col("initials"), [NO_REF], NO_REF).alias("initial_reference"),
        joined_distinct(F.col("refs"), [NO_REF], NO_REF).alias("reference"),
    )


ARRAYS = {"lines": "line", "words": "word", "labels": "label", "initials": "initial", "refs": "ref"}


def sentences(words: DataFrame, chunk: int | None = None) -> DataFrame:
    """One row for each sentence: its text, line range, and its distinct labels and references. chunk: words of a document that a task sees at once; all of them, if not given."""
    marked = mark_groups(_filled(words), ["source_path"], ["word_index"], fx.is_boundary(F.col("word")), chunk=chunk and chunks("word_index", chunk))
    rows = F.array_sort(F.collect_list(F.struct("word_index", *ARRAYS.values())))
    grouped = marked.groupBy("source_path", "source_file", "sentence_index").agg(rows.alias("rows"))
    return _row(grouped.select("source_path", "source_file", "sentence_index", *[F.col("rows")[v].alias(k) for k, v in ARRAYS.items()]), "sentence")


def reuse_sets(words: DataFrame, chunk: int | None = None) -> DataFrame:
    """One row for each maximal run of words with one reference; label and initial reference of its first word.

    sentence_index counts the boundaries up to the run's last word. chunk: as in `sentences`.
    """
    at = chunk and chunks("word_index", chunk)
    df = mark_runs(_filled(words), ["source_path"], ["word_index"], F.col("ref"), chunk=at)
    df = running_count(df, ["source_path"], ["word_index"], fx.is_boundary(F.col("word")), "seen", at)
    rows = F.array_sort(F.collect_list(F.struct("word_index", "line", "word")))
    grouped = df.where(F.col("ref") != NO_REF).groupBy("source_path", "source_file", "run").agg(
        F.max("seen").cast("int").alias("sentence_index"), rows.alias("rows"), F.min_by("label", "word_index").alias("label"), F.min_by("initial", "word_index").alias("initial_reference"), F.first("ref").alias("reference")
    )
    return grouped.select("source_path", "source_file", "sentence_index", line_range(F.col("rows.line")).alias("line"), fx.attach_punctuation(F.array_join(F.col("rows.word"), " ")).alias("reuse_tag_set"), "label", "initial_reference", "reference")


def rule_segmenter(texts: list[str], threshold: float = 0.5) -> list[list[str]]:
    """Stands in for a segmentation model (not numerically equivalent to one): segments end at a sentence boundary, or at a comma or colon after 40 words; a lower threshold ends them earlier."""
    out = []
    for text in texts:
        parts, part = [], []
        for w in text.split():
            part.append(w)
            if w in ".?!;" or (w in ",:" and len(part) >= 80 * threshold):
                parts.append(" ".join(part))
                part = []
        out.append([*parts, " ".join(part)] if part else parts)
    return out


def segments(words: DataFrame, segmenter: Callable[..., list[list[str]]] = rule_segmenter, chunk: int = CHUNK, threshold: float = 0.5, loader: tuple | None = None, batch: int = 64) -> DataFrame:
    """One row for each segment that a segmenter makes of chunks of words; no segment crosses a chunk.

    segmenter: (texts, threshold) -> for each text the list of its segments, as a function that can be sent to workers.
    loader: (load, *args) instead, where load(*args) gives the segmenter; it is called once a worker process.
    """

    @F.pandas_udf("array<struct<begin:int,n:int>>")
    def cuts(texts: pd.Series) -> pd.Series:
        segment, found, out = loaded(*loader) if loader else segmenter, texts.tolist(), []
        for k in range(0, len(found), batch):
            for parts in segment(found[k : k + batch], threshold):
                begin, mine = 0, []
                for n in (len(x.split()) for x in parts):
                    if n:
                        mine.append({"begin": begin, "n": n})
                    begin += n
                out.append(mine)
        return pd.Series(out, dtype=object)

    df = _filled(words).withColumn("chunk", F.floor(F.col("word_index") / chunk))
    rows = F.array_sort(F.collect_list(F.struct("word_index", *ARRAYS.values())))
    chunks = df.groupBy("source_path", "source_file", "chunk").agg(rows.alias("rows")).withColumn("cuts", cuts(F.array_join(F.col("rows.word"), " ")))
    cut = chunks.select("source_path", "source_file", "chunk", "rows", F.posexplode("cuts").alias("at", "cut"))
    part = cut.select("source_path", "source_file", "chunk", "at", F.slice("rows", F.col("cut.begin") + 1, F.col("cut.n")).alias("part"))
    numbered = part.withColumn("sentence_index", (F.row_number().over(Window.partitionBy("source_path").orderBy("chunk", "at")) - 1).cast("int"))
    return _row(numbered.select("source_path", "source_file", "sentence_index", *[F.col("part")[v].alias(k) for k, v in ARRAYS.items()]), "sentence")


def thin_punctuation(df: DataFrame, part: list[str], order: str, word: str, marks: list[str]) -> DataFrame:
    """Of each run of punctuation words every second is emptied."""
    is_mark = F.col(word).isin(marks)
    df = mark_runs(df, part, [order], is_mark, "_fx_run")
    at = F.row_number().over(Window.partitionBy(*part, "_fx_run").orderBy(order))
    return df.withColumn(word, F.when(is_mark & (at % 2 == 0), F.lit("")).otherwise(F.col(word))).drop("_fx_run")


def raw_text(df: DataFrame, part: list[str], order: str, word: str, left: list[str] = ATTACHED_LEFT, right: list[str] = ATTACHED_RIGHT) -> DataFrame:
    """Running text of each part: punctuation is glued to what precedes it, and what follows an opening mark is glued to that."""
    w = Window.partitionBy(*part).orderBy(order)
    before = F.lag(word).over(w)
    glued = before.isNull() | F.col(word).isin(left) | before.isin(right)
    rows = df.withColumn("_fx_piece", F.when(glued, F.col(word)).otherwise(F.concat(F.lit(" "), F.col(word))))
    return rows.groupBy(*part).agg(F.array_join(in_order(F.col("_fx_piece"), [order]), "").alias("text"))
