import io
import zipfile
from xml.etree import ElementTree as ET

import pytest

from florilex.operators import docx, tei

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def run(text, color=None, note=None):
    style = f'<w:rPr><w:color w:val="{color}"/><w:highlight w:val="none"/></w:rPr>' if color else ""
    return f"<w:r>{style}<w:t>{text}</w:t></w:r>" + (f'<w:r><w:footnoteReference w:id="{note}"/></w:r>' if note else "")


def package(*paragraphs, notes=None):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}>" + "".join(f"<w:p>{p}</w:p>" for p in paragraphs) + "</w:document>")
        if notes:
            z.writestr("word/footnotes.xml", f'<w:footnotes {W}><w:footnote w:id="-1" w:type="separator"><w:t>x</w:t></w:footnote>' + "".join(f'<w:footnote w:id="{k}"><w:t> {v}</w:t></w:footnote>' for k, v in notes.items()) + "</w:footnotes>")
    return blob.getvalue()


def cited(blob):
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        return docx.cite(docx.tokens(z), docx.footnotes(z))


def marked(tokens):
    return "".join(f"<{t['content']}{'!' if t['is_insertion'] else ''}>" if t.get("citation") is not None else t["content"] for t in tokens if t["type"] == "text")


def test_styled_quote_with_a_gap():
    blob = package(run("Ait ") + run("in ", "FF0000") + run("sic ") + run("fine", "FF0000", 1) + run(" post"), notes={1: "Mt 1,1"})
    assert marked(cited(blob)) == "Ait <in>< ><sic!>< !><fine> post".replace("Ait <in>", "Ait <in>")


def test_without_style_only_the_text_before_is_cited():
    assert marked(cited(package(run("unum duo") + run("", note=1), notes={1: "n"}))) == "unum <duo>"
    assert marked(cited(package(run("unum duo ") + run("", note=1), notes={1: "n"}))) == "unum duo< >"


def test_neighbouring_notes_and_paragraphs_end_a_quote():
    blob = package(run("a", "FF0000"), run("b", "FF0000", 1) + run("", note=2) + run("c", "FF0000", 2), notes={1: "one", 2: "two"})
    found = cited(blob)
    assert [(t["content"], t.get("citation")) for t in found if t["type"] == "text"] == [("a", None), ("b", "one"), ("c", "two")]


def test_breaks_line_numbers_and_skipped_runs():
    blob = package(run("a (12) b") + '<w:hyperlink><w:r><w:t>no</w:t></w:r></w:hyperlink><w:r><w:br w:type="page"/><w:lastRenderedPageBreak/></w:r>')
    found = cited(blob)
    assert [t["type"] for t in found] == ["p_start", "text", "text", "lb", "text", "text", "pb", "pb", "p_end"] and found[3]["n"] == "12"


def test_look_back_is_bounded():
    far = package(run("x", "FF0000") + run(" ".join(["w"] * 300)) + run("y", "FF0000", 1), notes={1: "n"})
    assert marked(cited(far)).startswith("x") and marked(cited(far)).endswith("<y>")
    near = package(run("x", "FF0000") + run(" ".join(["w"] * 200)) + run("y", "FF0000", 1), notes={1: "n"})
    assert marked(cited(near)).startswith("<x><w!>")


def test_tei_markup():
    blob = package(run("Ait ") + run("in", "FF0000") + run(" (3)sic ") + run("fine", "FF0000", 1) + run(" post"), notes={1: "Mt 1,1"})
    xml = ET.tostring(docx.tei(cited(blob)), encoding="unicode")
    assert '<p>Ait <seg type="biblicalQuotation">in<seg type="insertion/modified"> <lb n="3" />sic </seg>fine<note type="biblicalNote"><seg ana="Occurrence" type="biblicalRef">Mt 1,1</seg></note></seg> post</p>' in xml
    assert docx.pretty(docx.tei(cited(blob))).startswith('<?xml version="1.0" ?>\n<TEI')


def test_empty_insertions_go_and_their_tails_stay():
    root = ET.fromstring('<p>a<seg type="insertion/modified"> </seg>b<seg type="insertion/modified"/>c<lb/><seg type="insertion/modified"> </seg>d</p>')
    assert ET.tostring(docx.drop_empty_insertions(root), encoding="unicode") == "<p>abc<lb />d</p>"


def words(body):
    return [(w, r, k) for w, r, k, _, _ in tei.words(f"<TEI xmlns='x'><teiHeader>no</teiHeader><text>{body}</text></TEI>")]


REF = '<seg type="biblicalRef" ana="allusion"><!--ps 1,1-->Ps 1:1</seg>'


@pytest.mark.parametrize(
    "body, want",
    [
        (f'a <seg type="biblicalQuotation">b, <note>{REF}x</note>c</seg> d', [("a", None, None), ("b", "Ps 1:1", "allusion"), (",", "Ps 1:1", "allusion"), ("c", "Ps 1:1", "allusion"), ("d", None, None)]),
        (f'<seg type="biblicalQuotation">b</seg><!--c--><note>{REF}</note> d', [("b", "Ps 1:1", "allusion"), ("d", None, None)]),
        ('<seg type="biblicalQuotation">b</seg><note><p rend="footnote text"><!--i-->Mt 1:1</p></note>', [("b", "Mt 1:1", "Occurrence")]),
        (f'<seg type="biblicalQuotation">a <seg type="biblicalQuotation">b<note><seg type="biblicalRef">Mt 2:2</seg></note></seg> c<note>{REF}</note></seg>', [("a", "Ps 1:1", "allusion"), ("b", "Mt 2:2", "Occurrence"), ("c", "Ps 1:1", "allusion")]),
        ("a <!--c-->gone <b>kept</b> on", [("a", None, None), ("kept", None, None), ("on", None, None)]),
        ("a <rdg>x</rdg>b <standOff>y</standOff>", [("a", None, None), ("b", None, None)]),
        (f'<seg type="biblicalQuotation">b<note><seg type="biblicalRef" ana="Quotation"/>{REF}</note></seg>', [("b", " ; Ps 1:1", "Quotation ; allusion")]),
    ],
)
def test_words_and_context(body, want):
    assert words(body) == want


def test_lines_flow_down_and_not_back_up():
    rows = tei.words('<p>a <lb n="1"/>b <hi>c <lb n="2"/>d</hi> e</p>')
    assert [(r[0], r[4]) for r in rows] == [("a", None), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "1")]


def test_ill_formed_and_cleanup(spark):
    files = spark.createDataFrame([("/a", "<p>x <!-- a -- b --> y</p>"), ("/b", '<p>k <c>abc</c><c>z</c> &amp; t; <seg type="insertion">in</seg> <seg type="biblicalQuotation">,</seg>u</p>')], "path string, xml string")
    assert [x.path for x in tei.bad_files(files).collect()] == ["/a"]
    assert [x.word for x in tei.tei_words(files).orderBy("path", "pos").collect()] == ["k", "abc", "t", ";", "in", "u"]


def test_markup_is_that_of_minidom():
    from xml.dom import minidom

    root = ET.fromstring('<TEI xmlns_="u" n="a&amp;&quot;&lt;&#10;&#9;"><p/>x &amp;&lt;&gt;"<q>one&#13;two&#13;&#10;</q> <q><lb n="3"/></q>tail<s><t>é</t></s></TEI>')
    for tree in (root, docx.tei(cited(package(run("Ait ") + run("in", "FF0000") + run(" (3)sic &amp; ") + run("fine", "FF0000", 1) + run(" post"), notes={1: "Mt 1,1"})))):
        assert docx.pretty(tree) == minidom.parseString(ET.tostring(tree, "utf-8")).toprettyxml(indent="  ")


@pytest.mark.parametrize("name", ["docx_to_tei", "corpus_from_docx"])
def test_a_small_file_of_many_documents_is_dealt_out(spark, name, monkeypatch):
    """What becomes documents is dealt to all cores, though a million parts are one file of 5 MB."""
    from florilex.plans import catalogue, file_queries  # noqa: F401 - registers its queries

    seen, made = [], docx.docx_to_tei
    monkeypatch.setattr(docx, "docx_to_tei", lambda files: seen.append(files.rdd.getNumPartitions()) or made(files))
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen[0] >= spark.sparkContext.defaultParallelism > 1
