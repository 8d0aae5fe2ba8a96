"""Normalisation of biblical references, and of the markup around them."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import ACCENTS, CORRECTIONS, LABELS, REFERENCE, REFERENCE_TAGS, REWRITES, SIGNS


def _fold(text: Column, table) -> Column:
    return reduce(lambda x, row: F.replace(x, F.lit(row[0]), F.lit(row[1])), table, text)


def unify_signs(ref: Column) -> Column:
    """Separators: 'et' is a semicolon, '_' a blank, a comma a colon, '--' a dash; blanks around dots and colons go."""
    ref = _fold(ref, SIGNS)
    return F.regexp_replace(F.regexp_replace(ref, r"(?U)\s*([.:])", "$1"), r"(?U)([.:])\s*", "$1")


def space_books(ref: Column) -> Column:
    """A dot with no digit on either side is a blank, so is a colon after a letter; letters and digits are parted."""
    ref = F.regexp_replace(F.regexp_replace(ref, r"(?<!\d)\.(?!\d)", " "), "(?<=[A-Za-z]):", " ")
    ref = F.regexp_replace(F.regexp_replace(ref, r"(?U)\s+", " "), r"\s$", "")
    return F.regexp_replace(ref, r"([A-Za-z])(\d)", "$1 $2")


def map_books(ref: Column, rewrites=REWRITES, corrections=CORRECTIONS) -> Column:
    """Accents, then the ordered rewrites of book names (substrings), then corrections of whole references."""
    ref = _fold(ref, ACCENTS)
    ref = F.regexp_replace(_fold(ref, rewrites), r"([A-Za-z])(\d)", "$1 $2")
    return _fold(ref, corrections)


def expand_sequens(ref: Column) -> Column:
    """'s', 'sq', 'ss' or 'etc' at the end means two more verses; null if the verse before it is no number."""
    bare = F.regexp_replace(ref, r"(?:s|sq|ss|etc)$", "")
    last = F.trim(F.element_at(F.split(F.element_at(F.split(bare, ":"), -1), "-"), -1)).try_cast("int")
    return F.when(F.coalesce(ref, F.lit("")).rlike("(?:s|sq|ss|etc)$"), F.concat(F.element_at(F.split(bare, "-"), 1), F.lit("-"), (last + 2).cast("string"))).otherwise(ref)


def extract_refs(ref: Column) -> Column:
    """All well-formed references in a text, joined by ' ; '."""
    return F.array_join(F.regexp_extract_all(ref, F.lit(REFERENCE), F.lit(0)), " ; ")


def normalize_ref(initial: Column, rewrites=REWRITES, corrections=CORRECTIONS) -> Column:
    """A reference as written -> references in canonical form, '' if there is none."""
    ref = map_books(space_books(unify_signs(initial)), rewrites, corrections)
    return extract_refs(F.coalesce(expand_sequens(ref), initial))


def with_normalized(df: DataFrame, initial: str, name: str = "normalized", **tables) -> DataFrame:
    """Adds the canonical form of a column of references. Each form that occurs is rewritten once, since few forms make up most references, and joined back."""
    forms = df.select(F.col(initial).alias("_fx_form")).where("_fx_form is not null").distinct()
    done = forms.select("_fx_form", normalize_ref(F.col("_fx_form"), **tables).alias(name))
    return df.join(done, F.col(initial) == F.col("_fx_form"), "left").drop("_fx_form")


def provenance(initial: Column, normalized: Column) -> Column:
    """The normalised reference, preceded by a comment with the initial one."""
    return F.concat(F.lit("<!--"), F.regexp_replace(F.regexp_replace(initial, r"[\t\n]", ""), "-(?=-|$)", r"-\\\\"), F.lit("-->"), normalized)


def as_comment(initial: str) -> str:
    """A reference as the content of an XML comment: two dashes can't stand together there, nor one at the end, so a backslash follows the first."""
    return re.sub("-(?=-|$)", r"-\\", re.sub(r"[\t\n]", "", initial))


def from_comment(comment: str) -> str:
    return comment.replace("-\\", "-")


def unify_labels(xml: Column) -> Column:
    """Label names of a TEI file unified; reference segments without a type are quotations; bold text goes."""
    xml = F.regexp_replace(_fold(xml, LABELS), r'<seg\s*type="biblicalRef"\s*>', '<seg type="biblicalRef" ana="Quotation">')
    return F.regexp_replace(xml, r'<hi rend="bold">[\s\S]*?</hi>', "")


class Normalizer:
    """`normalize_ref` for single strings, where a rewrite needs a callback."""

    def __init__(self, rewrites=REWRITES, corrections=CORRECTIONS):
        self.tables = [SIGNS, [*ACCENTS, *rewrites], corrections]
        self.signs = [(regex.compile(p), r) for p, r in ((r"\s*([.:])", r"\1"), (r"([.:])\s*", r"\1"), (r"(?<!\d)\.(?!\d)", " "), ("(?<=[A-Za-z]):", " "), (r"\s+", " "), (r"\s$", ""), (r"([A-Za-z])(\d)", r"\1 \2"))]
        self.parted, self.tail = regex.compile(r"([A-Za-z])(\d)"), regex.compile("(?:s|sq|ss|etc)$")
        self.found = regex.compile(REFERENCE)
        self.segments = [(regex.compile(pattern + r"([\s\S]*?)<"), tag) for pattern, tag in REFERENCE_TAGS]

    def __call__(self, initial: str) -> str:
        ref = initial
        for table, patterns in zip(self.tables, (self.signs, [(self.parted, r"\1 \2")], []), strict=True):
            for a, b in table:
                ref = ref.replace(a, b)
            for p, r in patterns:
                ref = p.sub(r, ref)
        if self.tail.search(ref):
            bare = self.tail.sub("", ref)
            number = bare.split(":")[-1].split("-")[-1].strip()
            ref = f"{bare.split('-')[0]}-{int(number) + 2}" if number.isdecimal() else initial
        return " ; ".join(self.found.findall(ref))

    def rewrite(self, xml: str) -> tuple[str, int]:
        """The text of every reference segment replaced by its normal form, after a comment with the initial one; and how many there were."""
        count = 0
        for pattern, tag in self.segments:
            def put(m, tag=tag):
                return f"{tag}<!--{as_comment(m[1])}-->{self(m[1])}<"

            xml, n = pattern.subn(put, xml)
            count += n
        return xml, count


def rewrite_references(xml: Column, rewrites=REWRITES, corrections=CORRECTIONS) -> Column:
    """struct(xml, n_matches) of a TEI file with all its reference segments normalised."""

    @F.pandas_udf("xml string, n_matches int")
    def work(texts: pd.Series) -> pd.DataFrame:
        normalize = Normalizer(rewrites, corrections)
        return pd.DataFrame([normalize.rewrite(t or "") for t in texts], columns=["xml", "n_matches"])

    return work(unify_labels(xml))
