"""TEI to words: each word with the reference, type and line that hold where it stands."""

from __future__ import annotations

import re
from typing import NamedTuple
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fx
from ..functions.fixed_values import CLEANUP, NO_REF, NO_REUSE, PUNCTUATION, SEPARATOR, SKIPPED
from ..functions.refs import from_comment
from ..schemas import TEI_WORDS
from .sequence import thin_punctuation


def clean_markup(xml: Column) -> Column:
    for pattern, new in CLEANUP:
        xml = F.regexp_replace(xml, pattern, new)
    return xml


class Context(NamedTuple):
    reference: str | None = None
    label: str | None = None
    initial: str | None = None
    line: str | None = None


def _is_comment(node: ET.Element) -> bool:
    return callable(node.tag)


def _name(node: ET.Element | None) -> str | None:
    return None if node is None or _is_comment(node) else node.tag.rpartition("}")[2]


def commented_text(node: ET.Element) -> tuple[str | None, str | None]:
    """(text, comment): with a comment inside, the text is what follows it."""
    comment = next((c for c in node if _is_comment(c)), None)
    if comment is not None and comment.text:
        return (comment.tail.strip() if comment.tail else None), from_comment(comment.text.strip())
    tail = comment.tail.strip() if comment is not None and comment.tail else None
    return (node.text.strip() if node.text else tail), None


def _gather(nodes: list[ET.Element]) -> tuple[str | None, str | None, str | None] | None:
    """Reference, type and initial reference from the segments of a note; None if they say nothing."""
    found = [(*commented_text(n), n.get("ana") or "Occurrence") for n in nodes]
    refs, initial = [r or "" for r, _, _ in found], [i for _, i, _ in found if i]
    if not any(refs) and not initial:
        return None
    return SEPARATOR.join(refs) if any(refs) else None, SEPARATOR.join(t for *_, t in found), SEPARATOR.join(initial) or None


def citation(node: ET.Element, following: ET.Element | None = None) -> tuple[str | None, str | None, str | None] | None:
    """What a quotation refers to: from a note within it, or from one that follows (its segments, or else its first footnote paragraph)."""
    if _name(node) != "seg" or node.get("type") != "biblicalQuotation":
        return None
    within = [s for note in node if _name(note) == "note" for s in note if _name(s) == "seg" and s.get("type") in ("biblicalRef", "refScripturaire")]
    found = _gather(within)
    if found or _name(following) != "note":
        return found
    # references within that say nothing still count as empty ones
    found = _gather(within + [s for s in following if _name(s) == "seg" and s.get("type") == "biblicalRef"])
    if found:
        return found
    for p in following:
        if _name(p) == "p" and p.get("rend") == "footnote text":
            ref, initial = commented_text(p)
            if ref or initial:
                return ref or None, "Occurrence", initial or None
    return None


def tokenize(text: str) -> list[str]:
    return re.sub(r"([.,;:!?])", r" \1 ", text).split()


def spans(node: ET.Element, at: Context):
    """(text, context) of the texts under a node, in order. A line break counts for what follows it in its parent and below, not above."""
    if _name(node) in SKIPPED:
        return
    if _name(node) == "lb" and node.get("n"):
        at = at._replace(line=node.get("n"))
    own = citation(node)
    if own:
        at = Context(*own, at.line)
    if node.text:
        yield node.text, at
    elements = [c for c in node if not _is_comment(c)]  # the text after a comment goes with it
    for child, following in zip(elements, [*elements[1:], None], strict=False):
        if _name(child) == "lb" and child.get("n"):
            at = at._replace(line=child.get("n"))
        cited = citation(child, following)
        yield from spans(child, Context(*cited, at.line) if cited else at)
        if child.tail:
            yield child.tail, at


def words(xml: str) -> list[tuple] | None:
    """(word, reference, label, initial reference, line) of a cleaned TEI file; None if it is not well-formed."""
    try:
        root = ET.fromstring(xml, parser=ET.XMLParser(target=ET.TreeBuilder(insert_comments=True)))
    except ET.ParseError:
        return None
    return [(w, c.reference, c.label, c.initial, c.line) for text, c in spans(root, Context()) for w in tokenize(text)]


def tei_words(files: DataFrame, step: int = 20_000) -> DataFrame:
    """(path, xml) -> words in order, as they stand in the files. Files that are not well-formed have none: see `bad_files`."""

    names = [f.name for f in TEI_WORDS.fields]

    def work(batches):
        columns, held = [[] for _ in names], 0

        def made():
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for path, xml in zip(b.column("path").to_pylist(), b.column("xml"), strict=True):
                rows = words(xml.as_py() or "")
                if not rows:
                    continue
                columns[0] += [path] * len(rows)
                columns[1] += range(len(rows))
                for c, values in zip(columns[2:], zip(*rows, strict=True), strict=True):
                    c += values
                held += len(rows)
                if held >= step:
                    yield made()
                    columns, held = [[] for _ in names], 0
        if held:
            yield made()

    return files.select("path", clean_markup(F.col("xml")).alias("xml")).mapInArrow(work, TEI_WORDS)


def bad_files(files: DataFrame) -> DataFrame:
    """The paths of files that are not well-formed after cleaning."""

    @F.pandas_udf("boolean")
    def broken(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: words(x or "") is None)

    return files.where(broken(clean_markup(F.col("xml")))).select("path")


def word_table(found: DataFrame, stop_words: list[str] | None = None, keep_punctuation: bool = True) -> DataFrame:
    """Words cleaned and numbered anew: path, word_index, line, word, label, reference (initial), reference normalized."""
    word = fx.normalize_word(fx.join_hyphenated(fx.drop_punctuation_pairs(F.col("word"))))
    if stop_words:
        word = fx.remove_stop_words(word, stop_words)
    out = found.withColumn("word", word)
    out = thin_punctuation(out, ["path"], "pos", "word", PUNCTUATION) if keep_punctuation else out.withColumn("word", fx.drop_punctuation(F.col("word")))
    out = out.withColumn("word", fx.drop_initials(F.col("word"))).where(F.trim("word") != "")
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) == "", NO_REF).otherwise(c)
    return out.select(
        "path",
        (F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1).alias("word_index"),
        F.coalesce("line", F.lit("")).alias("line"),
        "word",
        F.coalesce("label", F.lit(NO_REUSE)).alias("label"),
        filled(F.replace("initial_reference", F.lit("\t"), F.lit(""))).alias("reference"),
        filled(F.col("reference")).alias("reference normalized"),
    )
