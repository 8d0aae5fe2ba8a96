"""Word documents to TEI: tokens, citations carried back from footnotes, and markup. One document is handled in one place; documents are spread."""

from __future__ import annotations

import io
import re
import zipfile
from bisect import bisect_right
from itertools import groupby
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import LOOK_BACK, MARKS
from ..schemas import DOCX_TOKENS

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TEI = "http://www.tei-c.org/ns/1.0"

def style_of(run: ET.Element) -> list[str] | None:
    """The sorted signature of a run's colour, highlight, shading and style; None without any."""
    first: dict[str, ET.Element] = {}
    for properties in run.iterfind(W + "rPr"):
        for node in properties:
            first.setdefault(node.tag, node)
    if not first:
        return None
    found = []
    for tag, attribute, prefix, plain in MARKS:
        node = first.get(W + tag)
        value = node.get(W + attribute) if node is not None else None
        if value and value not in plain:
            found.append(f"{prefix}:{value}")
    return sorted(found) or None


def footnotes(package: zipfile.ZipFile) -> dict[str, str]:
    if "word/footnotes.xml" not in package.namelist():
        return {}
    notes = ET.fromstring(package.read("word/footnotes.xml")).iter(W + "footnote")
    return {n.get(W + "id"): "".join(t.text or "" for t in n.iter(W + "t")).strip() for n in notes if n.get(W + "type") not in ("separator", "continuationSeparator")}


def _text_tokens(text: str, style):
    for part in re.split(r"(\(\d+\))", text):
        if re.fullmatch(r"\(\d+\)", part):
            yield {"type": "lb", "n": part[1:-1]}
        else:
            yield from ({"type": "text", "content": w, "style": style} for w in re.split(r"(\s+)", part) if w)


def tokens(package: zipfile.ZipFile) -> list[dict]:
    """The document as tokens: paragraph starts and ends, page and line breaks, words and blanks, footnote references. Only runs that are direct children of a paragraph count."""
    out: list[dict] = []
    for number, p in enumerate(ET.fromstring(package.read("word/document.xml")).iter(W + "p"), 1):
        out.append({"type": "p_start", "p_id": number})
        for run in p.findall(W + "r"):
            style = style_of(run)
            for item in run:
                kind = item.tag.removeprefix(W)
                if kind == "lastRenderedPageBreak" or kind == "br" and item.get(W + "type") == "page":
                    out.append({"type": "pb"})
                elif kind == "t":
                    out += _text_tokens(item.text or "", style)
                elif kind == "footnoteReference":
                    out.append({"type": "fn_ref", "fn_id": item.get(W + "id"), "style": style})
        out.append({"type": "p_end"})
    return out


def _stretch(found: list[dict], end: int) -> list[dict]:
    """The texts before a footnote reference, nearest first, up to a paragraph start, another reference or a cited text."""
    out = []
    for k in range(end - 1, -1, -1):
        t = found[k]
        if t["type"] in ("p_start", "fn_ref") or t["type"] == "text" and t.get("citation"):
            break
        if t["type"] == "text":
            out.append(t)
    return out


def cite(found: list[dict], notes: dict[str, str]) -> list[dict]:
    """Gives the texts that a footnote refers to its content as citation.

    Those are the texts styled like the nearest styled one; what stands between
    them, within LOOK_BACK texts, is cited as an insertion. Without any style it
    is the nearest text alone.
    """
    for end, ref in enumerate(found):
        if ref["type"] != "fn_ref":
            continue
        note, texts = notes.get(ref["fn_id"], ""), _stretch(found, end)
        style = next((t["style"] for t in texts if t["style"]), None)
        if style is None:
            for t in texts[:1]:
                t |= {"citation": note, "is_insertion": False}
            continue
        same = [k for k, t in enumerate(texts) if t["style"] == style]
        for k, t in enumerate(texts):
            later = bisect_right(same, k)
            if t["style"] == style:
                t |= {"citation": note, "is_insertion": False}
            elif later < len(same) and same[later] - k <= LOOK_BACK:
                t |= {"citation": note, "is_insertion": True}
            else:
                break
    return found


def _append(node: ET.Element, text: str) -> None:
    if len(node):
        node[-1].tail = (node[-1].tail or "") + text
    else:
        node.text = (node.text or "") + text


def _scopes(paragraph: list[dict]):
    """((citation, insertion), tokens) of a paragraph; breaks belong to the scope that is open."""
    scope, out = (None, False), []
    for t in paragraph:
        if t["type"] == "text":
            scope = (t.get("citation"), bool(t.get("is_insertion")) and t.get("citation") is not None)
        out.append((scope, t))
    return ((k, [t for _, t in g]) for k, g in groupby(out, key=lambda x: x[0]))


def tei(found: list[dict]) -> ET.Element:
    """The TEI tree of cited tokens."""
    root = ET.Element("TEI", xmlns=TEI)
    described = ET.SubElement(ET.SubElement(root, "teiHeader"), "fileDesc")
    ET.SubElement(ET.SubElement(described, "titleStmt"), "title").text = "Converted Document"
    for part in ("publicationStmt", "sourceDesc"):
        ET.SubElement(ET.SubElement(described, part), "p")
    div = ET.SubElement(ET.SubElement(ET.SubElement(root, "text"), "body"), "div", type="textpart", subtype="section", n="1")
    starts = [k for k, t in enumerate(found) if t["type"] == "p_start"]
    for a, b in zip(starts, [*starts[1:], len(found)], strict=False):
        p, quote, open_citation = ET.SubElement(div, "p"), None, None

        def close(quote=None, citation=None):
            note = ET.SubElement(quote, "note", type="biblicalNote")
            ET.SubElement(note, "seg", ana="Occurrence", type="biblicalRef").text = citation

        for (citation, insertion), items in _scopes([t for t in found[a:b] if t["type"] in ("text", "lb", "pb")]):
            if citation != open_citation:
                if open_citation is not None:
                    close(quote, open_citation)
                quote = ET.SubElement(p, "seg", type="biblicalQuotation") if citation is not None else None
                open_citation = citation
            node = p if quote is None else ET.SubElement(quote, "seg", type="insertion/modified") if insertion else quote
            for t in items:
                if t["type"] == "text":
                    _append(node, t["content"])
                elif t["type"] == "lb":
                    ET.SubElement(node, "lb", n=t["n"])
                else:
                    ET.SubElement(node, "pb")
        if open_citation:
            close(quote, open_citation)
    return drop_empty_insertions(root)


def drop_empty_insertions(root: ET.Element) -> ET.Element:
    """Takes out insertions of nothing but white space; what follows them stays."""
    for parent in list(root.iter()):
        for child in list(parent):
            if child.tag.rpartition("}")[2] == "seg" and child.get("type") == "insertion/modified" and not len(child) and not (child.text or "").strip():
                at, tail = list(parent).index(child), child.tail or ""
                parent.remove(child)
                if at:
                    parent[at - 1].tail = (parent[at - 1].tail or "") + tail
                else:
                    parent.text = (parent.text or "") + tail
    return root


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _lines(node: ET.Element, indent: str):
    """The lines of an element as minidom's toprettyxml has them: a text alone stays within its tags, all else has lines of its own."""
    attributes = "".join(f' {k}="{_escaped(v).replace(chr(34), "&quot;").replace(chr(13), "&#13;").replace(chr(10), "&#10;").replace(chr(9), "&#9;")}"' for k, v in node.items())
    tag, text = f"{indent}<{node.tag}{attributes}", node.text or ""
    if len(node):
        yield f"{tag}>\n"
        if text:
            yield f"{indent}  {_escaped(text)}\n"
        for child in node:
            yield from _lines(child, indent + "  ")
            if child.tail:
                yield f"{indent}  {_escaped(child.tail)}\n"
        yield f"{indent}</{node.tag}>\n"
    else:
        yield f"{tag}>{_escaped(text)}</{node.tag}>\n" if text else f"{tag}/>\n"


def pretty(root: ET.Element) -> str:
    """The markup of a tree of elements whose names have no namespaces of their own, indented; line ends within texts are newlines."""
    return '<?xml version="1.0" ?>\n' + re.sub("\r\n?", "\n", "".join(_lines(root, "")))


def read(content: bytes) -> list[dict] | None:
    """The cited tokens of a Word document; None if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            return cite(tokens(package), footnotes(package))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None


def docx_tokens(files: DataFrame, step: int = 20_000) -> DataFrame:
    """(path, content) of Word documents -> their tokens with citations. Broken documents have none: see `bad_files`."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_()]
    names = [f.name for f in DOCX_TOKENS.fields]

    def work(batches):
        columns, held = [[] for _ in names], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = read(content.as_py())
                if not rows:
                    continue
                columns[0] += [path] * len(rows)
                columns[1] += range(len(rows))
                for c, name in zip(columns[2:], names[2:], strict=True):
                    c += [t.get(name) for t in rows]
                held += len(rows)
                if held >= step:
                    yield made()
                    columns, held = [[] for _ in names], 0
        if held:
            yield made()

    return files.select("path", "content").mapInArrow(work, DOCX_TOKENS)


def docx_to_tei(files: DataFrame) -> DataFrame:
    """(path, content) of Word documents -> (path, xml). Broken documents are left out: see `bad_files`."""

    def work(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                found = read(content.as_py())
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([pretty(tei(found))])], ["path", "xml"])

    return files.select("path", "content").mapInArrow(work, "path string, xml string")


def bad_files(files: DataFrame) -> DataFrame:
    """The paths of files that are no Word documents."""

    @F.pandas_udf("boolean")
    def broken(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: read(x) is None)

    return files.where(broken(F.col("content"))).select("path")
