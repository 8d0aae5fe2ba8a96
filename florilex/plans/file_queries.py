"""Queries that write files to the shared folder and read them back: sources, sinks, and the ways between them."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import models, tables
from ..functions import text as fx
from ..functions.fixed_values import NO_REF, NO_REUSE
from ..operators import docx, sequence, similarity, tei
from ..sources import files, sinks
from ..storage import shared_dir, stored
from . import catalogue, corpus
from .catalogue import ORACLE_SQL, RUNS, STYLED, TOKENS, _corpus_words, _labelled, _package, _styled, documents, parts, query, table, tei_files


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file:")


#: Words of 25 small documents: the name of a nation, of its region, marks and words that look like nothing.
NATION_WORDS = """w AS (SELECT n_nationkey AS k, unnest([n_name, ',', 'null', r_name, 'a "q"', 'nan', '.']) AS word, unnest(range(7)) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _nation_words(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    words = F.array("n_name", F.lit(","), F.lit("null"), "r_name", F.lit('a "q"'), F.lit("nan"), F.lit("."))
    at = rows.select("n_nationkey", F.posexplode(words).alias("word_index", "word"))
    cited = F.col("word_index") == 3
    ref = F.when(cited, F.concat(F.lit("Mt "), F.col("n_nationkey"), F.lit(":1"))).otherwise(NO_REF)
    name = F.concat(F.lit("/in/sub"), F.col("n_nationkey") % 2, F.lit("/nation"), "n_nationkey", F.lit(".xml"))
    return at.select(
        name.alias("source_path"), F.concat(F.lit("nation"), "n_nationkey", F.lit(".xml")).alias("source_file"), "word_index", F.concat((F.col("word_index") % 2 + 1).cast("string"), F.lit(".0")).alias("line"), "word",
        F.when(cited, "Quotation").otherwise(NO_REUSE).alias("label"), ref.alias("reference"), ref.alias("reference normalized"),
    )


@query(
    f"""WITH {NATION_WORDS} SELECT 'sub' || (k % 2) AS folder, 'nation' || k || '_reuses.tsv' AS source_file, i::INT AS word_index, (i % 2 + 1) || '.0' AS line, word, CASE WHEN i = 3 THEN 'Quotation' ELSE 'NaR' END AS label,
 CASE WHEN i = 3 THEN 'Mt ' || k || ':1' ELSE 'o' END AS reference, CASE WHEN i = 3 THEN 'Mt ' || k || ':1' ELSE 'o' END AS normalized FROM w"""
)
def word_files(spark, sf_dir):
    """Word files, one for each document, written and read back with the places of words."""
    path = _folder(spark, "words")
    sinks.write_word_files(_nation_words(spark, sf_dir), path, "/in")
    back = files.in_file_order(files.word_files(spark, path))
    return back.select(F.element_at(F.split("source_path", "/"), -2).alias("folder"), "source_file", "word_index", "line", "word", "label", "reference", F.col("reference normalized").alias("normalized"))


@query(
    f"""WITH {NATION_WORDS} SELECT 'nation' || k || '_reuses.tsv' AS source_file, 0 AS sentence_index, '1-2' AS line, regexp_replace(string_agg(word, ' ' ORDER BY i), '\\s+([.,;:?!])', '\\1', 'g') AS sentence, 'Quotation' AS label,
 'Mt ' || k || ':1' AS initial_reference, 'Mt ' || k || ':1' AS reference, CASE WHEN k % 2 = 0 THEN 'verse ' || k ELSE '' END AS biblical_text FROM w GROUP BY k"""
)
def datasets_from_word_files(spark, sf_dir):
    """From word files and a table of verses, both read from disk, to sentences with their texts."""
    path, verses = _folder(spark, "words"), _folder(spark, "verses")
    sinks.write_word_files(_nation_words(spark, sf_dir), path, "/in")
    k = F.col("n_nationkey").cast("string")
    texts = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("Mt "), k, F.lit(":1")).alias("reference"), F.lit("Matthew").alias("book"), k.alias("chapter"), F.lit("1").alias("verse"), F.lit("").alias("part"), F.concat(F.lit("verse "), k).alias("text"))
    sinks.write_tsv(texts, verses)
    return corpus.datasets(files.word_files(spark, path), files.verses(spark, verses))["sentences"].select("source_file", "sentence_index", "line", "sentence", "label", "initial_reference", "reference", "biblical_text")


@query(
    """SELECT 'doc' || n_nationkey || '_reuses.tsv' AS name, CASE n_nationkey % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS place, CASE n_nationkey % 5 WHEN 1 THEN 'short' WHEN 2 THEN 'long' ELSE 'header' END AS kind, n_nationkey % 5 = 1 AS is_read
 FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)"""
)
def bad_word_files(spark, sf_dir):
    """Word files with a short row, a long one, or another header; those of the first kind are read."""
    path, k = _folder(spark, "words"), F.col("n_nationkey")
    row = lambda *x: F.concat_ws("\t", *[F.lit(v) if isinstance(v, str) else v for v in x])
    lines = F.array(
        F.when(k % 5 == 3, F.lit("a\tb")).otherwise(files.HEADER), row("1", F.col("n_name"), "NaR", "o", "o"), F.when(k % 5 == 1, row("1", "x")).otherwise(F.lit(" ")),
        row("1", '"a\tb"', "NaR", "o", "o"), F.when(k % 5 == 2, row("1", "y", "NaR", "o", "o", "more")).otherwise(row("1", "z", "NaR", "o", "o")),
    )
    made = table(spark, sf_dir, "nation").select(F.concat(F.lit("sub/doc"), k, F.lit("_reuses.tsv")).alias("name"), F.array_join(lines, "\r\n").alias("content"))
    sinks.write_files(made, path, "name", "content")
    bad = files.bad_word_files(spark, path)
    found = files.word_files(spark, path).select(F.col("source_path").alias("path")).distinct().withColumn("is_read", F.lit(True))
    out = bad.join(found, "path", "left").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("at").cast("int").alias("place"), "kind", F.coalesce("is_read", F.lit(False)).alias("is_read"))
    return out


@query("SELECT 'nation' || n_nationkey || '.txt' AS name, n_name AS text FROM nation WHERE n_nationkey % 2 = 0")
def flat_scan(spark, sf_dir):
    """The files of a folder, without those of its sub-folders."""
    path, k = _folder(spark, "flat"), F.col("n_nationkey")
    sinks.write_files(table(spark, sf_dir, "nation").select(F.concat(F.when(k % 2 == 0, "").otherwise("sub/"), F.lit("nation"), k, F.lit(".txt")).alias("name"), "n_name"), path, "name", "n_name")
    return files.binary_files(spark, path, "*.txt", recursive=False).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("text"))


@query("SELECT 'part' || p_partkey AS name, len(p_name) AS size, '<p>' || p_name || '</p>' AS xml FROM part")
def xml_files(spark, sf_dir):
    """One TEI file for each part, in folders, written and read back with the sizes that the sink tells."""
    path = _folder(spark, "tei")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("/in/brand"), F.substring("p_brand", -2, 2), F.lit("/part"), "p_partkey", F.lit(".docx")).alias("path"), F.concat(F.lit("<p>"), "p_name", F.lit("</p>")).alias("xml"))
    written = sinks.write_xml(rows, path, "/in").select(F.concat(F.lit("/"), "name").alias("at"), (F.col("size") - 7).cast("int").alias("size"))
    back = files.xml_files(spark, path)
    return back.join(written, F.substring_index("path", "/", -2) == F.substring("at", 2, 1000)).select(F.regexp_extract("path", r"([^/]*)\.xml$", 1).alias("name"), "size", "xml")


@query(f"""WITH {NATION_WORDS} SELECT 'nation' || k || '.txt' AS name, string_agg(CASE WHEN i = 0 OR word IN (',', '.') THEN word ELSE ' ' || word END, '' ORDER BY i) AS text FROM w GROUP BY k""")
def raw_text_files(spark, sf_dir):
    """Running texts, one file for each document."""
    path = _folder(spark, "raw")
    sinks.write_raw_texts(_nation_words(spark, sf_dir), path)
    return files.binary_files(spark, path, "*.txt").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("text"))


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_nationkey AS number FROM nation WHERE n_nationkey % 5 <> 4")
def positional_and_inferred_tables(spark, sf_dir):
    """A headed table by the places of its columns, without rows that are too short, and again with types read off it."""
    path, short = _folder(spark, "table"), F.col("n_nationkey") % 5 == 4
    line = F.when(short, F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name")).otherwise(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.lit("x"), F.lit("y")))
    table(spark, sf_dir, "nation").select(F.lit("k\tname\tc\td").alias("value")).limit(1).union(table(spark, sf_dir, "nation").orderBy("n_nationkey").select(line)).coalesce(1).write.text(path)
    by_place = files.positional(spark, path, {0: "key", 1: "name"}, 4)
    typed = files.tsv(spark, path, infer=True).select(F.col("k").cast("int").alias("number"), F.col("name").alias("own"))
    return by_place.join(typed, F.col("name") == F.col("own")).select("key", "name", "number")


@query("SELECT r_name || ' ' AS old, r_regionkey::VARCHAR || ',b' AS new, r_name AS word, 0 AS missing FROM region")
def dictionaries_and_word_lists(spark, sf_dir):
    """Two-column tables without a header, in which blanks count, and lists of words."""
    regions = table(spark, sf_dir, "region")
    pairs, words = _folder(spark, "pairs"), _folder(spark, "list")
    regions.select(F.concat("r_name", F.lit(" ,"), "r_regionkey", F.lit(",b"))).write.text(pairs)
    regions.select(F.concat("r_name", F.lit(" "))).write.text(words)
    listed = set(files.word_list(spark, words))
    rows = [(a, b, a.strip(), int(a.strip() not in listed)) for a, b in files.pairs(spark, pairs)]
    return spark.createDataFrame(rows, "old string, new string, word string, missing int")


@query("SELECT 'user' || user_id AS source, event_type AS marker FROM events GROUP BY ALL")
def marker_list_file(spark, sf_dir):
    """The distinct markers of each source in one sorted text file."""
    path = _folder(spark, "markers")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("marker"), F.concat(F.lit("user"), "user_id").alias("source"))
    sinks.write_markers(events, "marker", "source", path, "markers.txt")
    parts = F.split("value", "\t")
    return spark.read.text(f"{path}/markers.txt").select(parts[1].alias("source"), parts[0].alias("marker"))


@query("SELECT c_custkey, c_name, c_mktsegment, (row_number() OVER (ORDER BY c_custkey) - 1)::INT AS place FROM customer")
def json_array_file(spark, sf_dir):
    """All rows as one JSON array, in order."""
    path = _folder(spark, "array")
    sinks.write_json_array(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "c_custkey")
    whole = files.binary_files(spark, path, "part-*").select("path", F.decode("content", "UTF-8").alias("text"))
    text = whole.agg(F.array_join(sequence.in_order(F.col("text"), ["path"]), "").alias("text"))  # the array, of one table of customers
    return text.select(F.posexplode(F.from_json("text", "array<struct<c_custkey:bigint,c_name:string,c_mktsegment:string>>")).alias("place", "x")).select("x.*", "place")


@query("SELECT 'nation' || n_nationkey || '.docx' AS source_file, 4 AS n_words, 0 AS first_index, 3 AS last_index, 'Mt ' || (n_nationkey + 1) || ':1' AS reference FROM nation")
def docx_files(spark, sf_dir):
    """Word documents from a folder with sub-folders, one of them broken, to words."""
    path = _folder(spark, "docx")

    def package(batches):
        for b in batches:
            made = [_package([("ante ", None), ("bis, ", "FF0000"), ("ter", "FF0000")], f"Mt {k + 1},1") for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"sub/nation{k}.docx" for k in b.column(0).to_pylist()], pa.string()), pa.array(made, pa.binary())], ["name", "content"])

    made = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int")).mapInArrow(package, "name string, content binary")
    sinks.write_files(made.unionByName(spark.sql("SELECT 'broken.docx' AS name, CAST('no zip' AS BINARY) AS content")), path, "name", "content")
    words = corpus.words_from_docx(spark, path)
    return words.groupBy("source_file").agg(F.count("*").alias("n_words"), F.min("word_index").alias("first_index"), F.max("word_index").alias("last_index"), F.max(F.when(F.col("reference") != NO_REF, F.col("reference normalized"))).alias("reference"))


@query("SELECT 'doc' || n_nationkey || CASE WHEN n_nationkey % 3 = 0 THEN '.XML' ELSE '.xml' END AS name, 'xml' AS kind FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'broken.docx', 'docx'")
def broken_files(spark, sf_dir):
    """The files of a folder that give no words; references with dashes are no reason."""
    path = _folder(spark, "mixed")
    k = F.col("n_nationkey")
    text = F.when(k % 4 == 1, "<p>a<b></p>").when(k % 4 == 2, '<p><seg type="biblicalRef" ana="Quotation">Ps 1,1--3-</seg> x</p>').otherwise("<p>fine</p>").cast("binary")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("doc"), k, F.when(k % 3 == 0, ".XML").otherwise(".xml")).alias("name"), text.alias("content"))
    sinks.write_files(rows.unionByName(spark.sql("SELECT 'broken.docx' AS name, CAST('no zip' AS BINARY) AS content")), path, "name", "content")
    return corpus.bad_files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "kind")


@query(
    f"""WITH {STYLED} SELECT 'part' || k AS name, '<?xml version="1.0" ?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Converted Document</title></titleStmt><publicationStmt><p/></publicationStmt><sourceDesc><p/></sourceDesc></fileDesc></teiHeader>'
 || '<text><body><div type="textpart" subtype="section" n="1"><p>' || a || ':<seg type="biblicalQuotation">' || b || CASE WHEN k % 2 = 0 THEN ' ' ELSE '<seg type="insertion/modified">' || c || ' </seg>' END || a
 || '<note type="biblicalNote"><seg ana="Occurrence" type="biblicalRef">Io ' || ch || ',' || v || 's</seg></note></seg></p></div></body></text></TEI>' AS xml FROM x"""
)
def docx_to_tei(spark, sf_dir):
    """The markup of Word documents, every second with an insertion of nothing but blanks, which goes; indentation is taken off."""

    def package(batches):
        for b in batches:
            rows = b.to_pylist()
            runs = [[(f"{x['p_name']}: ", None), (f"{x['p_type'].lower()} ", "FF0000"), (" " if x["p_partkey"] % 2 == 0 else f"{x['p_brand']} ", None), (x["p_name"], "FF0000")] for x in rows]
            notes = [f"Io {x['p_partkey'] % 28 + 1},{x['p_size']}s" for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f"part{x['p_partkey']}" for x in rows], pa.string()), pa.array([_package(r, n) for r, n in zip(runs, notes, strict=True)], pa.binary())], ["path", "content"])

    made = parts(spark, sf_dir, "p_partkey", "p_name", "p_brand", "p_type", "p_size").mapInArrow(package, "path string, content binary")
    return docx.docx_to_tei(made).select(F.col("path").alias("name"), F.regexp_replace("xml", r"\s*\n\s*", "").alias("xml"))


@query(
    """WITH w AS (SELECT n_nationkey AS k, unnest([regexp_replace(lower(n_name), '[^a-z]', '', 'g'), ',', '', '', 'x']) AS word, unnest(range(5)) AS i FROM nation), f AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY i) - 1)::INT AS word_index FROM w WHERE word <> '')
 SELECT 'p' || k AS path, word_index, CASE WHEN i = 4 THEN k::VARCHAR ELSE '' END AS line, word, CASE WHEN i = 4 THEN 'Occurrence' ELSE 'NaR' END AS label, CASE WHEN i = 4 THEN 'Mt 1' ELSE 'o' END AS reference, 'o' AS normalized FROM f"""
)
def word_sentinels(spark, sf_dir):
    """Cleaned words numbered anew; what has no reference or type has a sentinel, and emptied words go."""
    k = F.col("n_nationkey")
    words = F.array(F.col("n_name"), F.lit(","), F.lit(","), F.lit("a."), F.lit("X"))
    found = table(spark, sf_dir, "nation").select(k, F.posexplode(words).alias("pos", "word")).select(
        F.concat(F.lit("p"), k).alias("path"), "pos", "word", F.lit("").alias("reference"), F.when(F.col("pos") == 4, "Occurrence").alias("label"), F.when(F.col("pos") == 4, "M\tt 1").alias("initial_reference"), F.when(F.col("pos") == 4, k.cast("string")).alias("line")
    )
    return tei.word_table(found).withColumnRenamed("reference normalized", "normalized")


def _marks_after_letters(text: str, passes: int = 8) -> str:
    for _ in range(passes):
        text = f"regexp_replace({text}, '(^|[^A-Za-z])[.,;:!?]', '\\1', 'g')"
    return text


@query(f"SELECT doc_id, md5(trim({_marks_after_letters(chr(39).join(['regexp_replace(text, ', chr(92) + 's+', ', ', ' ', ', ', 'g', ')']))})) AS cleaned FROM documents")
def whitespace_cleaning(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(fx.clean_whitespace(F.col("text"))).alias("cleaned"))


@query(
    f"""WITH s AS ({ORACLE_SQL["annotated_sentences"]}), r AS ({ORACLE_SQL["reuse_sets"]}), v AS (SELECT DISTINCT 'Ps ' || (p_partkey % 75 * 2 + 2) || ':' || (p_size % 7 + 1) AS reference FROM part),
 x AS (SELECT 'sentences' AS name, unnest(string_split(reference, ' ; ')) AS reference FROM s UNION ALL SELECT 'sets', reference FROM r)
 SELECT name, count(*) AS n_rows, count(*) FILTER (x.reference <> 'o') AS with_reference, count(v.reference) AS with_text, count(*) FILTER (x.reference <> 'o' AND v.reference IS NULL) AS unresolved FROM x LEFT JOIN v USING (reference) GROUP BY name"""
)
def observed_datasets(spark, sf_dir):
    """What a run reports: the counts of sentences and sets, taken while they are written."""
    texts = table(spark, sf_dir, "part").select(F.concat(F.lit("Ps "), F.col("p_partkey") % 75 * 2 + 2, F.lit(":"), F.col("p_size") % 7 + 1).alias("reference"), F.lit("text").alias("text")).distinct()
    data, seen = corpus.observed(corpus.datasets(_corpus_words(spark, sf_dir), texts))
    seen.pop("segments")
    for name in seen:
        data[name].write.parquet(_folder(spark, name))
    return corpus.report(spark, seen)


@query(f"{RUNS}, m AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sentence_index FROM k) SELECT user_id, event_id, sentence_index, run::INT AS run FROM m")
def streamed_runs(spark, sf_dir):
    """Events of each user as words that arrive in three pieces, each with words that belong to others."""
    from ..streaming.runs import numbered_words

    came, out, state = _folder(spark, "pieces"), _folder(spark, "numbered"), _folder(spark, "state")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    events = stored(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", place.alias("word_index")), "events")
    words = events.select(F.col("user_id").cast("string").alias("source_path"), "word_index", F.when(F.col("event_type") == "error", ".").otherwise("x").alias("word"), F.col("event_type").alias("reference"))
    for k in range(3):
        words.where(F.col("word_index") % 3 == (k * 2) % 3).coalesce(1 + k).write.mode("append").parquet(came)
    stream = numbered_words(spark.readStream.schema(words.schema).option("maxFilesPerTrigger", 1).parquet(came))
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(out).select(F.col("source_path").cast("long").alias("user"), F.col("word_index").alias("at"), "sentence_index", "run")
    return events.join(found, (F.col("user_id") == F.col("user")) & (F.col("word_index") == F.col("at"))).select("user_id", "event_id", "sentence_index", "run")


@query(ORACLE_SQL["tei_patterns"])
def tei_words_by_sql(spark, sf_dir):
    """The words of TEI files by a table function, in SQL."""
    tables.register(spark)
    tei_files(spark, sf_dir).select("path", tei.clean_markup(F.col("xml")).alias("xml")).createOrReplaceTempView("florilex_files")
    return spark.sql("SELECT f.path, w.* FROM florilex_files f, LATERAL tei_words(f.xml) w")


@query(RUNS + " SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n FROM k GROUP BY user_id, run")
def runs_by_sql(spark, sf_dir):
    """Runs of events by a table function that holds no more than the open run."""
    tables.register(spark)
    table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type").createOrReplaceTempView("florilex_events")
    return spark.sql("SELECT part AS user_id, run, value AS event_type, n FROM runs(TABLE(SELECT * FROM florilex_events) PARTITION BY user_id ORDER BY (ts, event_id), 'event_type')")


@query(
    f"""WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, round(avg(least(length(word), 20)), 9) AS mean_length, round(avg(least(length(word), 20) * least(length(word), 20)), 9) AS mean_square FROM toks GROUP BY doc_id"""
)
def model_vectors(spark, sf_dir):
    """Whole documents by a model of token vectors, loaded once a worker; a token's vector is its length and its square, so that means can be told by SQL."""

    def load(device: str, size: int):
        known = np.array([[k, k * k] for k in range(size + 1)], float)
        return models.TokenModel(lambda ids, mask: known[ids])

    docs = documents(spark, sf_dir).select("doc_id", F.transform(fx.tokenize(F.col("text")), lambda w: F.least(F.length(w), F.lit(20))).alias("ids"))
    found = models.embed_whole(docs, "ids", load, 20, keys=["doc_id"])
    return found.join(docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens")), "doc_id").select("doc_id", "n_tokens", F.round(F.col("vector")[0], 9).alias("mean_length"), F.round(F.col("vector")[1], 9).alias("mean_square"))


@query(ORACLE_SQL["random_fill"].replace("text AS candidate", "regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g') AS candidate"))
def filled_tsv(spark, sf_dir):
    """A filled dataset as TSV, one folder for each label, in order within files, read back."""
    path = _folder(spark, "filled")
    cands = similarity.numbered(table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[ \t\n\r]+", " ").alias("candidate")), "item_id").select("number", "candidate")
    sinks.write_tsv(similarity.fill_random(_labelled(spark, sf_dir), cands, "doc_id", seed="s").select("doc_id", "label", "biblical_text"), path, by=["label"], order=["doc_id"])
    back = files.tsv(spark, path, "doc_id long, biblical_text string, label string")
    return back.select("doc_id", "label", F.coalesce("biblical_text", F.lit("")).alias("biblical_text"))


@query(ORACLE_SQL["parallel_reuses"])
def parallel_tsv(spark, sf_dir):
    """The table of reuses of psalms as TSV, in the order of references, read back."""
    path = _folder(spark, "parallel")
    sinks.write_tsv(catalogue.parallel_reuses(spark, sf_dir), path, order=["NT_ref", "Ps_ref"])
    back = files.tsv(spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])
