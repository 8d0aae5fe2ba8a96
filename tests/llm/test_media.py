import hashlib
import html
import re
import zlib

import duckdb

from florilex.llm import media


def test_query_round_trip(spark):
    rows = [(1, "abc é"), (2, "abc é"), (3, None), (4, ""), (5, "x" * 64), (6, "y" * 65), (None, "abc é"), (6, "y" * 65), (7, "z" * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as digest", "'r' as html", "1 as position")
    got = media.op_query(df).collect()
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((d, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    assert sorted(((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in got), key=repr) == sorted(want, key=repr)
    for x in got:
        blob = b"P5\n64 %d\n255\n" % (x.payload_bytes // 64) + next(raw + bytes(x.payload_bytes - len(raw)) for raw in [(t or "").encode() for d, t in rows if d == x.doc_id])
        assert (x.media_bytes, x.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
        assert x.feature == plain_feature(blob[-x.payload_bytes :])
    assert all(x.caption == f"{x.n_bytes} bytes" for x in got)
    assert media.op_query(df.limit(0)).collect() == []


def plain_feature(data):
    lines = [data[k : k + 64] for k in range(0, len(data), 64)]
    edges = [int(len(lines) * k / 8) for k in range(9)]
    cells = []
    for a, b in zip(edges, edges[1:], strict=False):
        for c in range(8):
            cells.append(sum(sum(x[8 * c : 8 * c + 8]) for x in lines[a:b]) / max(b - a, 1))
    mean = sum(cells) / 64
    average = sum(data) / len(data)
    deviation = (sum(x * x for x in data) / len(data) - average**2) ** 0.5
    return f"{sum((c > mean) << (63 - k) for k, c in enumerate(cells)):016x}:{average:.3f}:{deviation:.3f}"


def test_payload_stands_amid_the_lines(spark):
    rows = [(1, "one & two\n\nthree <b>\nfour\nfive"), (2, "only"), (3, None), (4, "a\n"), (None, "x\ny\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.position, x.n_parts) for x in media.op_query(df).collect()}
    assert got == {1: (1, 5), 2: (0, 2), 3: (0, 1), 4: (1, 2), None: (1, 4)}
    parts = media.parts(media.document_pages(df)).where("doc_id = 1").orderBy("position").collect()
    assert [x.text for x in parts if x.kind == "text"] == ["one & two", "three <b>", "four", "five"] and parts[1].digest == hashlib.sha256(rows[0][1].encode() + bytes(64 - len(rows[0][1]))).hexdigest()


def test_names_of_the_result_and_omitted_tags(spark):
    store = media.store_payloads(spark.createDataFrame([(1, "pic")], "doc_id long, text string"))
    digest = store.first().digest
    page = f'<html><head><title>t</title><body><p>Hello world<img src="sha256:{digest}"><p>more<template><p>none</template><p>end<template><p>left open'
    pages = spark.createDataFrame([(9, page, "d", "k", "c", 5, "p", "x")], "page_id long, html string, digest string, kind string, caption string, position int, parts string, feature string")
    got = sorted(media.interleaved(pages, media.resolved_media(store)).collect(), key=lambda x: x.position)
    assert [(x.kind, x.text, x.digest) for x in got] == [("text", "Hello world", None), ("image", f"sha256:{digest}", digest), ("text", "more", None), ("text", "end", None), ("text", "left open", None)]
    assert [x.payload_bytes for x in got] == [None, 64, None, None, None] and len(set(got[0].asDict())) == len(got[0])
    assert [x["text"] for x in media.parse_html("<title>a<p>b")] == ["b"]


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = media.pages_query(pages).collect()
    for page in pages.collect():
        own = sorted((x for x in got if x.page_id == page.page_id), key=lambda x: x.position)
        assert [x.position for x in own] == list(range(len(own))) and all(x.n_parts == len(own) for x in own)
        bare = re.sub(r"(?s)<(style|script|title)>.*?</\1>|<!--.*?-->", "", page.html)
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|div|li|ul|h1|nav|article|footer|body)\b[^>]*>", bare.replace("<br>", " "))]
        assert [x.text for x in own] == [x for x in want if x]


def test_sequence_order_captions_and_missing(spark):
    store = media.store_payloads(spark.createDataFrame([(1, "pic")], "doc_id long, text string"))
    digest = store.first().digest
    page = f'<html><head><title>t</title></head><p>Before &amp; <b>here<p>more<script>x()</script><figure><img src="sha256:{digest}" alt="a"><figcaption>The <i>cap</i></figcaption></figure>mid<img src="http://e/x.png" alt="b">after<img src="sha256:{"0" * 64}">'
    pages = spark.createDataFrame([(9, page), (10, None), (11, "")], "page_id long, html string")
    got = sorted(media.interleaved(pages, media.resolved_media(store)).collect(), key=lambda x: x.position)
    assert [(x.kind, x.text if x.kind == "text" else x.caption) for x in got] == [("text", "Before & here"), ("text", "more"), ("image", "The cap"), ("text", "mid"), ("image", "b"), ("text", "after"), ("image", None)]
    assert [x.payload_bytes for x in got] == [None, None, 64, None, None, None, None]


def test_links_as_media(spark):
    """The references of web pages whose links are media, by SQL; text parts stay as they are, less the links' tags."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    duck = duckdb.connect()
    duck.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    out = media.references_query(pages)
    got, want = sorted(tuple(x) for x in out.collect()), duck.sql(f"SELECT {', '.join(out.columns)} FROM ({media.REFERENCES_ORACLE})").fetchall()
    key = lambda x: (x[0], x[1])
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 100
    assert any(x[4] for x in got) and any(x[4] is None for x in got) and all(x[4] in (None, x[2]) for x in got)
    text = lambda rows: {(x.page_id, x.text) for x in rows if x.kind == "text"}
    whole = {p: " ".join(t for q, t in sorted(text(media.links_query(pages).collect())) if q == p) for p in {x[0] for x in got}}
    assert all(whole.values())


def test_links_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, '<a href="">x</a><a href="/longer">y</a><a href="/longer">z</a>'), (3, '<a href="/é&amp;é">'), (None, '<a href="/abc">')], "page_id long, html string").selectExpr("*", "1 AS text", "2 AS digest", "3 AS place")
    got = sorted((tuple(x) for x in media.references_query(pages).collect()), key=repr)
    assert sorted(((p, c, b) for p, _, _, c, _, b in got), key=repr) == sorted([(3, "", None), (3, "/longer", 64), (3, "/longer", 64), (3, "/é&amp;é", 64), (None, "/abc", None)], key=repr)
    assert all(h == (d if b else None) for _, _, d, _, h, b in got)
