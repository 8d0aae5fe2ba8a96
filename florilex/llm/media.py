"""Media columns: interleaved sequences of text and media references.

HTML is parsed into an ordered array of parts: the text of each block, and
references to media with their caption. References carry the SHA-256 of what they refer to.
Payloads lie in a store of their own, content-addressed: each is kept as an
8-bit greyscale image (binary PGM, 64 samples a row), losslessly. Features are
computed on the bytes read back from the store, where they lie; only digests
and what was computed are joined to the references, so no payload is shuffled.
The references to the most frequent payloads are joined by a broadcast (of a
bounded number), so that no task gets all of them; text parts take no part in that join.

Edge cases: a null text is an empty payload (one row of 64 zero bytes). A
reference whose digest the store lacks keeps its place, with null media fields. Equal
payloads share a digest and resolve to one row, so joins don't multiply.
Repeated rows are kept. Null or empty HTML gives no parts. Unclosed tags
(omitted ends of head, title or template too), captions outside figures and
unknown attributes are tolerated. Columns of the pages that have the name of a
column of the result give way to it. Very long texts and pages are handled one
at a time. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import in_steps, join_counted, stored, text_bytes

WIDTH = 64
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}
#: Elements whose content is not text of the page. Those of the parser's own kind (script, style) end where it says.
HIDDEN = {"script", "style", "title"}
BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "article", "section", "header", "footer", "nav", "main", "aside", "blockquote", "pre", "body"}
PARTS = "array<struct<kind:string,text:string,digest:string,caption:string>>"


class _Parts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.hidden: str | None = None
        self.templates: list[int] = []
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def flush(self):
        run = " ".join("".join(self.text).split())
        self.text = []
        if run:
            self.parts.append({"kind": "text", "text": run, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        self.hidden = tag if tag in HIDDEN else None  # a title ends where another element begins
        if tag == "template":
            self.flush()
            self.templates.append(len(self.parts))
        elif tag == "figure":
            self.flush()
            self.figure = len(self.parts)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            self.flush()
            found = dict(attrs)
            m = re.fullmatch(r"sha256:([0-9a-f]{64})", found.get("src") or "")
            self.parts.append({"kind": MEDIA[tag], "text": found.get("src"), "digest": m and m[1], "caption": found.get("alt")})
        elif tag in BLOCKS and self.caption is None:
            self.flush()
        elif tag == "br" or tag in BLOCKS:
            (self.text if self.caption is None else self.caption).append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN and tag != "template":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
        elif tag == "template" and self.templates:  # what a template holds is no part of the page; without an end it is none
            self.text = []
            del self.parts[self.templates.pop() :]
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for part in self.parts[self.figure or 0 :] if self.figure is not None else ():
                if part["kind"] != "text":
                    part["caption"] = said
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(source: str | None) -> list[dict]:
    p = _Parts()
    p.feed(source or "")
    p.close()
    p.flush()
    return p.parts


def sequences(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with parts, the ordered text and media references of their HTML."""
    pages = pages.drop("parts")
    names = pages.columns
    kind = pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "text", "digest", "caption")]))

    def work(batches):
        for b in in_steps(batches, column):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([parse_html(x) for x in b.column(column).to_pylist()], kind)], [*names, "parts"])

    parts = T.StructField("parts", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "text", "digest", "caption")])))
    return pages.mapInArrow(work, T.StructType([*pages.schema.fields, parts]))


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def encode_pgm(data: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def decode_pgm(blob: bytes) -> bytes:
    m = re.match(rb"P5\n(\d+) (\d+)\n255\n", blob)
    data = blob[m.end() :]
    if len(data) != int(m[1]) * int(m[2]):
        raise ValueError("a stored image is cut short")
    return data


def feature(data: bytes) -> str:
    """A 64-bit average hash over 8 bands of rows and 8 of columns, and mean and deviation of the samples."""
    x = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    edges = np.linspace(0, len(x), 9).astype(int)
    columns = np.add.reduceat(np.concatenate([np.zeros((1, WIDTH), np.int64), np.cumsum(x, axis=0, dtype=np.int64)])[edges], range(0, WIDTH, 8), axis=1)
    cells = np.diff(columns, axis=0) / np.maximum(np.diff(edges), 1)[:, None]
    bits = int("".join("1" if c else "0" for c in (cells > cells.mean()).ravel()), 2)
    return f"{bits:016x}:{x.mean():.3f}:{x.std():.3f}"


def store_payloads(docs: DataFrame) -> DataFrame:
    """Writes each text's payload as an image; (doc_id, n_bytes, digest of the payload, blob), read back from the store."""

    def work(batches):
        for b in in_steps(batches, "data"):
            data = [payload(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()), pa.array([encode_pgm(x) for x in data], pa.binary()), b.column(2)], ["doc_id", "digest", "blob", "n_bytes"])

    rows = docs.select("doc_id", text_bytes().alias("data"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return stored(rows.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest string, blob binary, n_bytes long"), "media")


def resolved_media(store: DataFrame) -> DataFrame:
    """One row for each stored digest: sizes, checksums and features of the bytes read back."""

    def work(batches):
        for b in in_steps(batches, "blob"):
            rows = []
            for digest, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = decode_pgm(blob)
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(data)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = store.select("digest", "blob").mapInArrow(work, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in found.columns[1:]])


MEDIA_FIELDS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def resolved(references: DataFrame, media: DataFrame) -> DataFrame:
    """References with a digest, and the fields of what they refer to; null for those that the store lacks."""
    refs = stored(references.where("digest is not null"), "references")
    found = stored(refs.groupBy("digest").agg(F.count("*").alias("_fx_n")).join(media, "digest", "left"), "resolved")
    return join_counted(refs, found, ["digest"], "_fx_n").drop("_fx_n")


def parts(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages less their HTML, one row for each part in order: position, n_parts, kind, text, digest, caption."""
    own = {"position", "n_parts", "kind", "text", "digest", "caption", "parts", *MEDIA_FIELDS}
    rest = [c for c in pages.columns if c != column and c not in own]
    whole = sequences(pages.select(*rest, column), column)
    return whole.select(*rest, F.size("parts").alias("n_parts"), F.posexplode("parts").alias("position", "part")).select(*rest, "position", "n_parts", "part.*")


def interleaved(pages: DataFrame, media: DataFrame, column: str = "html") -> DataFrame:
    """The parts of pages, and the media's fields with those that refer to media."""
    found = parts(pages, column)
    return found.where("digest is null").unionByName(resolved(found.where("digest is not null"), media), allowMissingColumns=True)


def _escaped(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def digest_of(data):
    """The SHA-256 of the payload that a column of bytes makes."""
    return F.sha2(F.rpad(data, F.greatest(F.ceil(F.octet_length(data) / WIDTH), F.lit(1)).cast("int") * WIDTH, F.lit(b"\x00")), 256)


def document_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html: each document as a page, its lines as paragraphs with its payload as a figure amid them."""
    data = text_bytes()
    size, digest = F.octet_length(data), digest_of(data)
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('" alt=""><figcaption>'), size.cast("string"), F.lit(" bytes</figcaption></figure>"))
    lines = F.split(_escaped(F.coalesce("text", F.lit(""))), "\n", -1)
    rows = docs.select("doc_id", size.cast("long").alias("n_bytes"), figure.alias("figure"), lines.alias("lines"))
    half = F.floor(F.size("lines") / 2).cast("int")
    body = lambda part: F.concat(F.lit("<p>"), F.array_join(part, "</p><p>"), F.lit("</p>"))
    return rows.select("doc_id", "n_bytes", F.concat(F.lit("<html><body>"), body(F.slice("lines", F.lit(1), half)), "figure", body(F.slice("lines", half + 1, F.size("lines"))), F.lit("</body></html>")).alias("html"))


def op_query(docs: DataFrame) -> DataFrame:
    """The columns of the op7 contract, and the place and caption that the media have in their sequence."""
    store = store_payloads(docs)
    references = parts(document_pages(docs)).where("kind = 'image'").select("doc_id", "n_bytes", "position", "n_parts", "digest", "caption")
    return resolved(references, resolved_media(store)).select("doc_id", "n_bytes", *MEDIA_FIELDS, "position", "n_parts", "caption")


#: A link of a page, and where it leads.
LINK = '<a href="([^"]*)">'


def linked_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages whose links are media, and the media: each link becomes an image, with where it leads as its payload and as its caption. (page_id, html) and (doc_id, text), a row for each target."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    image = lambda x: F.concat(F.lit('<img src="sha256:'), digest_of(x.cast("binary")), F.lit('" alt="'), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit('">'))
    html = F.aggregate(links, F.col("html"), lambda h, x: F.replace(h, F.concat(F.lit('<a href="'), x, F.lit('">')), image(x)))
    return pages.select("page_id", html.alias("html")), pages.select(F.explode(links).alias("doc_id")).distinct().withColumn("text", F.col("doc_id"))


def links_query(pages: DataFrame) -> DataFrame:
    """page_id, position, n_parts, kind, text, digest, caption, payload_sha256, payload_bytes of all parts of the web pages whose links are media; the store lacks those that lead nowhere longer than four bytes."""
    linked, media = linked_pages(pages)
    store = store_payloads(media.where(F.octet_length("text") > 4))
    return interleaved(linked, resolved_media(store)).select("page_id", "position", "n_parts", "kind", "text", "digest", "caption", "payload_sha256", "payload_bytes")


def references_query(pages: DataFrame) -> DataFrame:
    """page_id, place (among the references of all pages of that number), digest, caption, payload_sha256, payload_bytes of the references of `links_query`."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("position"))
    return links_query(pages).where("kind = 'image'").select("page_id", place.alias("place"), "digest", "caption", "payload_sha256", "payload_bytes")


REFERENCES_ORACLE = """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS caption, unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) + 1))::INT AS place FROM pages),
 b AS (SELECT DISTINCT caption, strlen(caption) AS n, greatest(1, (strlen(caption) + 63) // 64) * 64 AS padded FROM l),
 d AS (SELECT caption, n, padded, sha256(unhex(rpad(hex(encode(caption)), (2 * padded)::INT, '0'))) AS digest FROM b)
 SELECT page_id, place, digest, caption, CASE WHEN n > 4 THEN digest END AS payload_sha256, CASE WHEN n > 4 THEN padded END AS payload_bytes FROM l JOIN d USING (caption)"""


def payloads_query(docs: DataFrame) -> DataFrame:
    """The columns of the op7 contract that SQL can tell: all but the feature."""
    return op_query(docs).select("doc_id", "n_bytes", *(c for c in MEDIA_FIELDS if c != "feature"))


PAYLOADS_ORACLE = """WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, greatest(1, (strlen(coalesce(text, '')) + 63) // 64) AS rows, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS (SELECT *, rpad(h, (128 * rows)::INT, '0') AS payload FROM d),
 x AS (SELECT *, right(payload, 128) AS tail, encode('P5' || chr(10) || '64 ' || rows || chr(10) || '255' || chr(10)) AS head FROM p)
 SELECT doc_id, n AS n_bytes, 64 * rows AS payload_bytes, sha256(unhex(payload)) AS payload_sha256, octet_length(head) + 64 * rows AS media_bytes, sha256(head || unhex(payload)) AS media_sha256,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 65), lambda i: ('0x' || substr(tail, (2 * i - 1)::INT, 2))::BIGINT)), lambda a, y: xor(a >> 8, c.t[(xor(a, y) & 255) + 1])), 4294967295) AS tail_crc32 FROM x, c"""


def pages_query(pages: DataFrame) -> DataFrame:
    """page_id, position, n_parts, kind, text of all parts of the raw web pages, with the media's fields where the store has them."""
    store = store_payloads(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    return interleaved(pages.select("page_id", "html"), resolved_media(store)).select("page_id", "position", "n_parts", "kind", "text", "digest", "caption", "payload_sha256")
