"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import ATTACHED_LEFT, ATTACHED_RIGHT, BOUNDARIES, NOT_IN_WORDS, PUNCTUATION_PAIR


def tokenize(text: Column) -> Column:
    """Words of a text: punctuation stands by itself, white space (NBSP too) parts. Null gives null."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([.,;:!?])", " $1 "), r"(?U)\s+", " ")
    return F.filter(F.split(F.trim(spaced), " "), lambda w: w != "")


def drop_punctuation_pairs(word: Column) -> Column:
    """Deletes adjacent pairs of punctuation marks. Each run of marks shrinks to one or none, so once is enough."""
    return F.regexp_replace(word, PUNCTUATION_PAIR, "")


def join_hyphenated(word: Column) -> Column:
    return F.replace(F.regexp_replace(word, r"(?U)-\s", ""), F.lit("-"), F.lit(""))


def normalize_word(word: Column) -> Column:
    """Lower case; letters outside ASCII and Latin-1, digits and other signs go."""
    return F.regexp_replace(F.lower(word), NOT_IN_WORDS, "")


def remove_stop_words(text: Column, stop_words: list[str]) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    return F.array_join(F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda w: (w != "") & ~F.array_contains(stop, w)), " ")


def drop_punctuation(word: Column) -> Column:
    return F.regexp_replace(word, "[,.!?:;]", "")


def drop_initials(word: Column) -> Column:
    """A letter followed by a dot, and nothing else, is emptied."""
    return F.regexp_replace(word, r"^[a-zA-Z]\.$", "")


def clean_whitespace(text: Column) -> Column:
    """Collapses white space, and deletes punctuation that no ASCII letter precedes."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "(?<![A-Za-z])[.,;:!?]", ""))


def split_sentences(text: Column) -> Column:
    """Sentences of a text: '.', '!' or '?' before white space ends one; a newline before white space does not."""
    marked = F.regexp_replace(F.regexp_replace(text, r"(?U)\n\s+", "\n"), r"(?U)([.!?])\s+", "$1\u0000")
    return F.filter(F.transform(F.split(marked, "\u0000"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def fold_jv(text: Column) -> Column:
    return F.translate(text, "jv", "iu")


def lower_strip(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")


def attach_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+([.,;:?!])", "$1")


def is_boundary(word: Column) -> Column:
    return F.coalesce(F.trim(word).isin(BOUNDARIES), F.lit(False))


def repair_line(line: Column) -> Column:
    """A line number that went through a float; only a final '.0' is taken off."""
    return F.regexp_replace(line, r"\.0$", "")


def build_ref(abbreviation: Column, chapter: Column, verse: Column) -> Column:
    return F.concat(F.trim(abbreviation), F.lit(" "), F.trim(chapter), F.lit(":"), F.trim(verse))


def overlaps(a: Column, b: Column) -> Column:
    """Whether one text contains the other, regardless of case and outer white space."""
    x, y = lower_strip(a), lower_strip(b)
    return F.contains(x, y) | F.contains(y, x)


def _class(marks: list[str]) -> str:
    return "[" + "".join("\\" + m if m in r"\^-[]&" else m for m in marks) + "]"


def sentences_of(words: Column) -> Column:
    """The sentences of an array of words that hold no blanks, each joined by blanks: what grouping its words by `sequence.mark_groups` gives, without leaving the row."""
    ends = _class(BOUNDARIES)
    return F.filter(F.split(F.array_join(words, " "), f"(?<=^{ends}| {ends}) "), lambda x: x != "")


def thinned(words: Column, marks: list[str]) -> Column:
    """`sequence.thin_punctuation` within a row: of each run of marks in an array of words every second is emptied."""
    one = _class(marks)
    joined = F.regexp_replace(F.concat(F.lit(" "), F.array_join(words, " ")), f"( {one}) {one}(?= |$)", "$1 ")
    return F.when(F.size(words) > 0, F.split(F.substring(joined, 2, 2**31 - 1), " ", -1)).otherwise(words)


def running_text(words: Column, left: list[str] = ATTACHED_LEFT, right: list[str] = ATTACHED_RIGHT) -> Column:
    """`sequence.raw_text` within a row: an array of words, that hold no blanks, as running text."""
    return F.regexp_replace(F.array_join(words, " "), f" (?={_class(left)}(?: |$))|(?<=^{_class(right)}| {_class(right)}) ", "")
