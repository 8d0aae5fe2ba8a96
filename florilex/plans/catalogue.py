"""Queries over the driver's tables, one or more for each operator, and the SQL that says the same."""

from __future__ import annotations

import functools
import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import refs
from ..functions import text as fx
from ..functions.fixed_values import ACCENTS, CORRECTIONS, PUNCTUATION, REFERENCE, REWRITES, SIGNS
from ..functions.vectors import letter_encoder
from ..operators import docx, expand, sequence, similarity, tei, vector_index, verses
from ..storage import spread, stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
STOP_WORDS = ["the", "of", "and", "de", "la", "le", "die", "der", "und", "el", "en"]


def query(sql: str | None = None):
    """Registers a query, by the name of its function, and its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir: str) -> DataFrame:
    """The documents; a file that one task would read is dealt out before it is parsed."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def parts(spark, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the parts; a file that few tasks would read (a million parts are 5 MB) is dealt out before documents are made of it."""
    return spread(table(spark, sf_dir, "part").select(*columns))


def tokens(spark, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(fx.tokenize(F.col("text"))).alias("pos", "word"))


TOKENS = r"""lists AS (
  SELECT doc_id, [x FOR x IN string_split(trim(regexp_replace(regexp_replace(text, '([.,;:!?])', ' \1 ', 'g'), '\s+', ' ', 'g')), ' ') IF x <> ''] AS l FROM documents
), toks AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS word FROM lists
)"""


@query(f"WITH {TOKENS} SELECT regexp_replace(lower(word), '[^A-Za-zÀ-ÿ\\s.,;:!?''\\n]', '', 'g') AS word, count(*) AS n FROM toks GROUP BY 1 HAVING trim(word) <> ''")
def tokenize_words(spark, sf_dir):
    words = tokens(spark, sf_dir).select(fx.normalize_word(F.col("word")).alias("word"))
    return words.where(F.trim("word") != "").groupBy("word").agg(F.count("*").alias("n"))


def _sentences(df: DataFrame, part: str, order: list[str], boundary) -> DataFrame:
    marked = sequence.mark_groups(df, [part], order, boundary)
    return marked.groupBy(part, "sentence_index").agg(F.count("*").alias("n_words"), sequence.in_order(F.col("word"), order).alias("words"))


@query(
    rf"""WITH {TOKENS}, marked AS (
  SELECT *, coalesce(sum((word IN ('.', '?', '!', ';'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sentence_index FROM toks
) SELECT doc_id, sentence_index, count(*) AS n_words, regexp_replace(string_agg(word, ' ' ORDER BY pos), '\s+([.,;:?!])', '\1', 'g') AS sentence FROM marked GROUP BY doc_id, sentence_index"""
)
def sentence_segmentation(spark, sf_dir):
    """Sentences of texts that lie in one row each, where nothing needs to be shuffled."""
    out = documents(spark, sf_dir).select("doc_id", F.posexplode(fx.sentences_of(fx.tokenize(F.col("text")))).alias("sentence_index", "words"))
    return out.select("doc_id", "sentence_index", F.size(F.split("words", " ")).cast("long").alias("n_words"), fx.attach_punctuation(F.col("words")).alias("sentence"))


@query(
    f"""WITH {TOKENS}, m AS (SELECT *, word IN ('.', ',', ';', ':', '!', '?') AS p FROM toks),
 r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, p ORDER BY pos) AS run FROM m),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, p, run ORDER BY pos) AS place FROM r)
 SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT p OR place % 2 = 1) AS n_kept, md5(string_agg(CASE WHEN NOT p OR place % 2 = 1 THEN word ELSE '' END, ' ' ORDER BY pos)) AS digest FROM k GROUP BY doc_id"""
)
def punct_thinning(spark, sf_dir):
    thin = documents(spark, sf_dir).select("doc_id", fx.thinned(fx.tokenize(F.col("text")), PUNCTUATION).alias("words")).where(F.size("words") > 0)
    return thin.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size(F.filter("words", lambda w: w != "")).cast("long").alias("n_kept"), F.md5(F.array_join("words", " ")).alias("digest"))


@query(
    f"""WITH {TOKENS}, w AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM toks)
 SELECT doc_id, string_agg(CASE WHEN b IS NULL OR b IN ('«', '‹', '(', '[', '{{') OR word IN ('»', '›') OR (length(word) = 1 AND contains('!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', word)) THEN word ELSE ' ' || word END, '' ORDER BY pos) AS text FROM w GROUP BY doc_id"""
)
def raw_text_rebuild(spark, sf_dir):
    words = fx.tokenize(F.col("text"))
    return documents(spark, sf_dir).where(F.size(words) > 0).select("doc_id", fx.running_text(words).alias("text"))


@query(ORACLE_SQL["sentence_segmentation"])
def word_table_sentences(spark, sf_dir):
    """The same sentences, of words that come as rows."""
    out = _sentences(tokens(spark, sf_dir), "doc_id", ["pos"], fx.is_boundary(F.col("word")))
    return out.select("doc_id", "sentence_index", "n_words", fx.attach_punctuation(F.array_join("words", " ")).alias("sentence"))


@query(ORACLE_SQL["punct_thinning"])
def word_table_thinning(spark, sf_dir):
    thin = sequence.thin_punctuation(tokens(spark, sf_dir), ["doc_id"], "pos", "word", PUNCTUATION)
    return thin.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if(F.col("word") != "").alias("n_kept"), F.md5(F.array_join(sequence.in_order(F.col("word"), ["pos"]), " ")).alias("digest"))


@query(ORACLE_SQL["raw_text_rebuild"])
def word_table_raw_text(spark, sf_dir):
    return sequence.raw_text(tokens(spark, sf_dir), ["doc_id"], "pos", "word")


@query(f"WITH {TOKENS} SELECT doc_id, count(*) FILTER (lower(word) NOT IN ({', '.join(map(repr, STOP_WORDS))})) AS n_kept FROM toks GROUP BY doc_id")
def stopword_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("kept", fx.remove_stop_words(F.array_join(F.transform(fx.tokenize(F.col("text")), F.lower), " "), STOP_WORDS))
    return docs.where(F.size(fx.tokenize(F.col("text"))) > 0).select("doc_id", F.when(F.col("kept") == "", 0).otherwise(F.size(F.split("kept", " "))).cast("long").alias("n_kept"))


@query("SELECT doc_id, md5(translate(text, 'jv', 'iu')) AS folded, md5(trim(lower(text), E' \\t\\n\\r')) AS lowered FROM documents")
def fold_jv(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fx.fold_jv(F.col("text"))).alias("folded"), F.md5(fx.lower_strip(F.col("text"))).alias("lowered"))


@query(
    r"""SELECT doc_id, len([x FOR x IN string_split(regexp_replace(regexp_replace(text, '\n\s+', chr(10), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) IF trim(x, E' \t\n\r') <> ''])::INT AS n_sentences,
  md5(regexp_replace(regexp_replace(text, '-\s', '', 'g'), '-', '', 'g')) AS joined, md5(regexp_replace(text, '[,.!?:;]', '', 'g')) AS bare FROM documents"""
)
def sentence_split_and_cleaning(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(fx.split_sentences(text)).alias("n_sentences"), F.md5(fx.join_hyphenated(text)).alias("joined"), F.md5(fx.drop_punctuation(text)).alias("bare"))


def _nested(expression: str, times: int) -> str:
    out = "text"
    for _ in range(times):
        out = expression.format(out)
    return out


@query(
    "SELECT doc_id, md5(" + _nested("regexp_replace({}, '[.;,·:!?]{{2}}', '', 'g')", 3) + ") AS pairs, md5(regexp_replace(regexp_replace(lower(text), '[^A-Za-zÀ-ÿ\\s.,;:!?''\\n]', '', 'g'), '^[a-z]\\.$', '')) AS normal,"
    " contains(lower(text), lower(source)) OR contains(lower(source), lower(text)) AS overlap, regexp_replace(n_chars || '.0', '\\.0$', '') AS line, source || ' ' || n_chars || ':' || doc_id AS ref FROM documents"
)
def word_cleaning(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(fx.drop_punctuation_pairs(text)).alias("pairs"), F.md5(fx.drop_initials(fx.normalize_word(text))).alias("normal"), fx.overlaps(text, F.col("source")).alias("overlap"),
        fx.repair_line(F.concat("n_chars", F.lit(".0"))).alias("line"), fx.build_ref(F.col("source"), F.col("n_chars"), F.col("doc_id")).alias("ref"),
    )


@query(f"WITH {TOKENS} SELECT count(*) AS n_words, count(*) FILTER (pos % 10 < 3) AS n_cited, count(DISTINCT doc_id) AS n_files FROM toks")
def word_counts(spark, sf_dir):
    from .corpus import word_counts as counts

    return counts(_corpus_words(spark, sf_dir))


@query("WITH v AS (SELECT label, unnest(range(0, len(embedding)))::INT AS place, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, place, round(avg(x), 6) AS mean FROM v GROUP BY label, place")
def vector_pooling(spark, sf_dir):
    from ..functions.vectors import mean_vectors

    return mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumn("mean", F.round("mean", 6))


RUNS = """WITH r AS (
  SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r)"""


@query(RUNS + " SELECT user_id, run::INT AS run, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS total FROM k GROUP BY user_id, run")
def event_runs(spark, sf_dir):
    runs = sequence.mark_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH m AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sentence_index FROM events)
 SELECT user_id, sentence_index, count(*) AS n_words, string_agg(event_type, ' ' ORDER BY ts, event_id) AS sentence FROM m GROUP BY user_id, sentence_index"""
)
def event_sentences(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("word", F.col("event_type"))
    return _sentences(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "sentence_index", "n_words", F.array_join("words", " ").alias("sentence"))


@query(
    """WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS place FROM events GROUP BY ALL),
 e AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id)
 SELECT user_id, string_agg(event_type, ' ; ' ORDER BY place) FILTER (event_type <> 'error') AS labels, any_value(first_type) AS first_type, any_value(last_type) AS last_type FROM f JOIN e USING (user_id) GROUP BY user_id
 HAVING labels IS NOT NULL"""
)
def ordered_distinct_labels(spark, sf_dir):
    values = table(spark, sf_dir, "events").groupBy("user_id").agg(sequence.in_order(F.col("event_type"), ["ts", "event_id"]).alias("v"))
    return values.select("user_id", sequence.joined_distinct(F.col("v"), ["error"], "o").alias("labels"), F.col("v")[0].alias("first_type"), F.element_at("v", -1).alias("last_type")).where("labels <> 'o'")


@query("SELECT conv_id, string_agg(role, ' ; ' ORDER BY turn) AS roles, min(turn) || '-' || max(turn) AS span, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def conversation_turn_spans(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(sequence.in_order(F.col("role"), ["turn"]).alias("roles"), sequence.in_order(F.col("turn").cast("string"), ["turn"]).alias("turns"), F.sum(F.length("text")).alias("n_chars"))
    return turns.where(F.size("turns") > 1).select("conv_id", F.array_join("roles", " ; ").alias("roles"), sequence.line_range(F.col("turns")).alias("span"), "n_chars")


def _verses(spark, sf_dir) -> DataFrame:
    """Parts as verse texts, by order and line number."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    named = lines.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("v"), F.col("p_name").alias("text"))
    return verses.last_by_key(named.withColumn("at", F.col("text")), ["o", "v"], "text", "at")


VERSES = "v AS (SELECT l_orderkey AS o, l_linenumber AS n, max(p_name) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query(f"WITH {VERSES} SELECT l.l_orderkey, l.l_linenumber, l.l_orderkey || ':' || (l.l_linenumber + 1) AS reference, coalesce(v.text, '') AS biblical_text FROM lineitem l LEFT JOIN v ON v.o = l.l_orderkey AND v.n = l.l_linenumber + 1")
def ref_lookup_exact(spark, sf_dir):
    texts = _verses(spark, sf_dir).select(F.concat_ws(":", "o", "v").alias("reference"), "text")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(":", "l_orderkey", F.col("l_linenumber") + 1).alias("reference"))
    return verses.attach_texts(rows, texts)


@query(
    f"""WITH {VERSES}, q AS (SELECT o_orderkey, 1 + o_orderkey % 4 AS a, 2 + o_custkey % 4 AS b FROM orders)
 SELECT q.o_orderkey, q.o_orderkey || ':' || a || '-' || b AS reference, coalesce(string_agg(v.text, ' ' ORDER BY v.n), '') AS biblical_text FROM q LEFT JOIN v ON v.o = q.o_orderkey AND v.n BETWEEN a AND b GROUP BY ALL"""
)
def ref_lookup_range(spark, sf_dir):
    texts = _verses(spark, sf_dir).select(F.concat_ws(":", "o", "v").alias("reference"), "text")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_orderkey"), F.lit(":"), 1 + F.col("o_orderkey") % 4, F.lit("-"), 2 + F.col("o_custkey") % 4).alias("reference"))
    return verses.attach_texts(rows, texts)


#: How references are written, of order k, line n: with semicolons and blanks, without any, malformed, and ranges as wide as can be.
MARKED = """CASE l_partkey % 8 WHEN 0 THEN k || ':' || n || ';' WHEN 1 THEN '; ' || k || ':' || n WHEN 2 THEN ' ' || k || ';:' || n || ' ' WHEN 3 THEN 'o' WHEN 4 THEN k || ':' || n || '-x' WHEN 5 THEN k || ':' || n || '-2147483647' WHEN 6 THEN k || ':1 - ' || n || ';' ELSE ';' END"""


@query(
    f"""WITH {VERSES}, q AS (SELECT row_number() OVER () AS r, l_orderkey AS k, l_linenumber AS n, l_partkey, {MARKED.replace("k ||", "l_orderkey ||").replace("|| n", "|| l_linenumber")} AS reference FROM lineitem),
 f AS (SELECT r, q.k, q.n, l_partkey, reference, coalesce(string_agg(v.text, ' ' ORDER BY v.n), '') AS biblical_text FROM q LEFT JOIN v ON v.o = q.k AND CASE l_partkey % 8 WHEN 0 THEN v.n = q.n WHEN 2 THEN v.n = q.n WHEN 5 THEN v.n >= q.n WHEN 6 THEN v.n <= q.n ELSE FALSE END GROUP BY ALL)
 SELECT k, n, l_partkey, reference, biblical_text FROM f"""
)
def ref_lookup_marks(spark, sf_dir):
    """References as they are found in files: semicolons don't count, sentinels and malformed ones have no text, ranges have any width."""
    texts = _verses(spark, sf_dir).select(F.concat_ws(":", "o", "v").alias("reference"), "text")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_partkey").withColumn("reference", F.expr(MARKED))
    return verses.attach_texts(rows, texts)


@query(
    f"""WITH {VERSES}, q AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '0-2147483647' WHEN 1 THEN '2 - 9000000000' ELSE '3.1.7' END AS verse FROM orders),
 t AS (SELECT k, string_agg(v.text, ' ' ORDER BY CASE WHEN k % 3 = 2 THEN (v.n * 2) % 3 ELSE v.n END) AS text FROM q JOIN v ON v.o = q.k AND CASE k % 3 WHEN 0 THEN TRUE WHEN 1 THEN v.n >= 2 ELSE v.n IN (3, 1, 7) END GROUP BY k)
 SELECT k, verse, coalesce(text, '') AS text FROM q LEFT JOIN t USING (k)""".replace("(v.n * 2) % 3", "list_position([3, 1, 7], v.n)")
)
def wide_ranges(spark, sf_dir):
    """Verses of a chapter by ranges that are far wider than it, and by lists."""
    k = F.col("o_orderkey")
    verse = F.when(k % 3 == 0, "0-2147483647").when(k % 3 == 1, "2 - 9000000000").otherwise("3.1.7")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.lit("Mt").alias("book"), k.cast("string").alias("chapter"), verse.alias("verse"))
    texts = _verses(spark, sf_dir).select(F.lit("Mt").alias("book"), F.col("o").cast("int").alias("chapter"), F.col("v").alias("verse"), "text")
    return verses.compound_texts(rows.withColumnRenamed("verse", "verse_"), texts, "k", "book", "chapter", "verse_", "text").select("k", F.col("verse_").alias("verse"), "text")


AGGLOMERATED = "a AS (SELECT l_orderkey AS k, string_agg('P ' || l_orderkey || ':' || l_linenumber || '.' || (l_linenumber + 1), ' ; ' ORDER BY l_linenumber, l_partkey) AS reference, string_agg(DISTINCT l_returnflag, ' ; ' ORDER BY l_returnflag) AS label FROM lineitem GROUP BY l_orderkey)"


def _agglomerated(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("r", F.concat(F.lit("P "), "l_orderkey", F.lit(":"), "l_linenumber", F.lit("."), F.col("l_linenumber") + 1))
    return lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(sequence.in_order(F.col("r"), ["l_linenumber", "l_partkey"]), " ; ").alias("reference"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), " ; ").alias("label"))


def _split_sql(n: str) -> str:
    return f"""WITH {AGGLOMERATED}, s AS (SELECT k, string_split(reference, ' ; ') AS r, string_split(label, ' ; ') AS l FROM a),
 p AS (SELECT k, r, l, unnest(range(0, {n})) AS part_no FROM s)
 SELECT k, part_no::INT AS part_no, r[least(part_no, len(r) - 1) + 1] AS reference, l[least(part_no, len(l) - 1) + 1] AS label FROM p"""


@query(_split_sql("len(r)"))
def deagglomerate(spark, sf_dir):
    return expand.split_references(_agglomerated(spark, sf_dir)).select("k", "part_no", "reference", "label")


@query(_split_sql("greatest(len(r), len(l))"))
def deagglomerate_segments(spark, sf_dir):
    return expand.split_references(_agglomerated(spark, sf_dir), longest=True).select("k", "part_no", "reference", "label")


@query(
    """WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN ['Ps ' || o_orderkey || ':1', 'Mt ' || o_orderkey || ':2'] WHEN 1 THEN ['; Ps ' || o_orderkey || ':1'] ELSE ['Ps ' || o_orderkey || ':1', 'Mt ' || o_orderkey || ':2'] END AS refs,
  CASE o_orderkey % 3 WHEN 0 THEN ['Quotation', 'Quotation'] WHEN 1 THEN [' Quotation'] ELSE ['allusion', 'Quotation'] END AS labels FROM orders)
 SELECT k, unnest(range(len(refs)))::INT AS part_no, unnest(refs) AS reference, unnest(labels) AS label FROM r"""
)
def split_cleanup(spark, sf_dir):
    """Separators and blanks that are left over go from rows that were split, and stay in all others."""
    k = F.col("o_orderkey")
    kind, ps, mt = k % 3, F.concat(F.lit("Ps "), k, F.lit(":1")), F.concat(F.lit("Mt "), k, F.lit(":2"))
    ref = F.when(kind == 0, F.concat(ps, F.lit(" ;  "), mt)).when(kind == 1, F.concat(F.lit("; "), ps)).otherwise(F.concat(ps, F.lit(" ; ; "), mt))
    label = F.when(kind == 0, "Quotation").when(kind == 1, " Quotation").otherwise("allusion ;  Quotation ")
    return expand.split_references(table(spark, sf_dir, "orders").select(k.alias("k"), ref.alias("reference"), label.alias("label"))).select("k", "part_no", "reference", "label")


@query("SELECT l_orderkey, l_linenumber, l_partkey, unnest(range(0, 2))::INT AS verse_no, unnest(['P ' || l_orderkey || ':' || l_linenumber, 'P ' || l_orderkey || ':' || (l_linenumber + 1) || '-9']) AS reference FROM lineitem")
def verse_list_split(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("P "), "l_orderkey", F.lit(":"), "l_linenumber", F.lit(". "), F.col("l_linenumber") + 1, F.lit("-9")).alias("reference"))
    return expand.split_verse_lists(rows).select("l_orderkey", "l_linenumber", "l_partkey", "verse_no", "reference")


@query(
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN r_name WHEN 1 THEN substr(r_name, 1, 3) WHEN 2 THEN (n_regionkey + 1) || ' ' || substr(r_name, 1, 2) ELSE n_name END AS name,
  CASE WHEN n_nationkey % 4 = 3 THEN n_name ELSE r_name END AS full_name, CASE WHEN n_nationkey % 4 = 3 THEN n_name ELSE substr(r_name, 1, 3) END AS abbreviation, n_nationkey % 4 <> 3 AS known FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def name_resolution(spark, sf_dir):
    regions = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    names = verses.Names([(x.r_name, x.r_name[:3]) for x in regions], [(f"{x.r_regionkey + 1}{x.r_name[:2]}", x.r_name) for x in regions])
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("n_nationkey") % 4
    name = F.when(kind == 0, F.col("r_name")).when(kind == 1, F.substring("r_name", 1, 3)).when(kind == 2, F.concat(F.col("n_regionkey") + 1, F.lit(" "), F.substring("r_name", 1, 2))).otherwise(F.col("n_name"))
    return rows.select("n_nationkey", name.alias("name")).withColumn("r", names.resolve(F.col("name"))).select("n_nationkey", "name", F.col("r.full").alias("full_name"), F.col("r.abbreviation").alias("abbreviation"), F.col("r.known").alias("known"))


@query(
    r"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'Ps' || (l_orderkey % 900 + 1) || ' , ' || l_linenumber || '--' || (l_linenumber + 3) WHEN 1 THEN 'Ps ' || (l_orderkey % 150 + 1) || ',' || l_linenumber || ' et Mt_' || l_linenumber || ' . ' || (l_linenumber + 1)
    WHEN 2 THEN 'Ps ' || (l_orderkey % 150 + 1) || ',' || l_linenumber || '; Rm ' || (l_linenumber + 1) || ', ' || l_linenumber || '.' || (l_linenumber + 2) ELSE 'Ps ' || (l_orderkey % 150 + 1) END AS initial FROM lineitem),
 s AS (SELECT *, regexp_replace(regexp_replace(replace(replace(replace(replace(initial, 'et', ';'), '_', ' '), ',', ':'), '--', '-'), '\s*([.:])', '\1', 'g'), '([.:])\s*', '\1', 'g') AS a FROM q),
 b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '([A-Za-z]):', '\1 ', 'g'), '\s+', ' ', 'g'), '\s$', ''), '([A-Za-z])(\d)', '\1 \2', 'g') AS r FROM s)
 SELECT l_orderkey, l_linenumber, l_partkey, initial, array_to_string(regexp_extract_all(r, '[1-3]?\s?[A-Za-z]+\s+\d{1,3}:\d{1,3}(?:\.\d{1,3})*(?:-\d{1,3})?'), ' ; ') AS normalized FROM b"""
)
def ref_normalize(spark, sf_dir):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    initial = (
        F.when(n % 4 == 0, F.concat(F.lit("Ps"), o % 900 + 1, F.lit(" , "), n, F.lit("--"), n + 3))
        .when(n % 4 == 1, F.concat(F.lit("Ps "), o % 150 + 1, F.lit(","), n, F.lit(" et Mt_"), n, F.lit(" . "), n + 1))
        .when(n % 4 == 2, F.concat(F.lit("Ps "), o % 150 + 1, F.lit(","), n, F.lit("; Rm "), n + 1, F.lit(", "), n, F.lit("."), n + 2))
        .otherwise(F.concat(F.lit("Ps "), o % 150 + 1))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", initial.alias("initial")).transform(refs.with_normalized, "initial")


@query(
    f"""WITH {VERSES}, q AS (SELECT o_orderkey AS k, o_custkey % 7 + 1 AS a, o_custkey % 5 + 1 AS b, o_orderpriority AS label FROM orders WHERE o_orderkey % 10 <> 3),
 x AS (SELECT q.*, CASE WHEN k % 3 = 0 THEN a || ' - ' || b WHEN k % 3 = 1 THEN a || '.' || b ELSE a::VARCHAR END AS verse FROM q),
 n AS (SELECT k, unnest(CASE WHEN k % 3 = 0 THEN range(a, b + 1) WHEN k % 3 = 1 THEN [a, b] ELSE [a] END) AS v, unnest(range(len(CASE WHEN k % 3 = 0 THEN range(a, b + 1) WHEN k % 3 = 1 THEN [a, b] ELSE [a] END))) AS place FROM x)
 SELECT x.k, 'Mt ' || x.k || ':' || x.verse AS ref, coalesce(t.text, '') AS text, label FROM x LEFT JOIN (SELECT n.k, string_agg(v.text, ' ' ORDER BY n.place) AS text FROM n JOIN v ON v.o = n.k AND v.n = n.v GROUP BY n.k) t USING (k)"""
)
def ps_nt_parallel(spark, sf_dir):
    k, a, b = F.col("o_orderkey"), F.col("o_custkey") % 7 + 1, F.col("o_custkey") % 5 + 1
    verse = F.when(k % 10 == 3, F.lit("x")).when(k % 3 == 0, F.concat(a, F.lit(" - "), b)).when(k % 3 == 1, F.concat(a, F.lit("."), b)).otherwise(a.cast("string"))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.lit("Mt").alias("book"), k.cast("string").alias("chapter"), verse.alias("verse"), F.col("o_orderpriority").alias("label"))
    rows = rows.where(F.col("verse").rlike(r"\d"))
    texts = _verses(spark, sf_dir).select(F.lit("Mt").alias("book"), F.col("o").cast("int").alias("chapter"), F.col("v").alias("verse"), "text")
    out = verses.compound_texts(rows.withColumnRenamed("verse", "verse_"), texts, "k", "book", "chapter", "verse_", "text")
    return out.select("k", fx.build_ref(F.col("book"), F.col("chapter"), F.col("verse_")).alias("ref"), "text", "label")


@query(
    r"""SELECT page_id, regexp_count(html, '<a href="[^"]*">') AS n_links, array_to_string(regexp_extract_all(html, '<a href="([^"]*)">', 1), ' ; ') AS links,
  md5(regexp_replace(html, '<b>[\s\S]*?<br>', '', 'g')) AS cleaned FROM pages""".replace("regexp_count(html, '<a href=\"[^\"]*\">')", "len(regexp_extract_all(html, '<a href=\"[^\"]*\">'))::INT")
)
def html_refs_extract(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("n_links"), F.array_join(found, " ; ").alias("links"), F.md5(F.regexp_replace("html", r"<b>[\s\S]*?<br>", "")).alias("cleaned"))


def _replaced(expression: str, table) -> str:
    for old, new in table:
        expression = f"replace({expression}, '{old}', '{new}')"
    return expression


#: References with every book name that is rewritten, in forms that each rule meets.
WRITTEN = """q AS (SELECT l_orderkey, l_linenumber, l_partkey, k, c, v, CASE l_linenumber WHEN 1 THEN k || c || ',' || v WHEN 2 THEN k || c || ',' || v || 's' WHEN 3 THEN k || c || ',' || v || '-' || (v + 1) || 'ss' WHEN 4 THEN k || c || ',' || v || 'sq ; ' || k || c || '.' || v
   WHEN 5 THEN 'cf. ' || k || c || ' , ' || v || '--' || (v + 3) WHEN 6 THEN 'Éz ' || c || ',' || v || ' et ' || k || c || ',' || v || 'etc' ELSE 'Ps 15,11; ' || k || c || ',as' END AS initial
  FROM (SELECT *, KEYS[l_orderkey % LENGTH + 1] AS k, l_orderkey % 150 + 1 AS c, l_partkey % 60 + 1 AS v FROM lineitem))""".replace("KEYS", "[" + ", ".join(f"'{a}'" for a, _ in REWRITES) + "]").replace("LENGTH", str(len(REWRITES)))
NORMALIZED_BY = rf"""s1 AS (SELECT *, regexp_replace(regexp_replace({_replaced("initial", SIGNS)}, '\s*([.:])', '\1', 'g'), '([.:])\s*', '\1', 'g') AS s FROM q),
 s2 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(^|[^0-9])\.([^0-9]|$)', '\1 \2', 'g'), '([A-Za-z]):', '\1 ', 'g'), '\s+', ' ', 'g'), '\s$', ''), '([A-Za-z])(\d)', '\1 \2', 'g') AS b FROM s1),
 s3 AS (SELECT *, CORRECTED AS r FROM s2),
 s4 AS (SELECT *, regexp_replace(r, '(s|sq|ss|etc)$', '') AS bare, regexp_matches(r, '(s|sq|ss|etc)$') AS more FROM s3),
 s5 AS (SELECT *, CASE WHEN more THEN split_part(bare, '-', 1) || '-' || (TRY_CAST(trim(string_split(string_split(bare, ':')[-1], '-')[-1]) AS INT) + 2) ELSE r END AS e FROM s4),
 s6 AS (SELECT *, array_to_string(regexp_extract_all(coalesce(e, initial), '{REFERENCE}'), ' ; ') AS normalized FROM s5)"""


def _normalized(corrections) -> str:
    book = f"regexp_replace({_replaced('b', [*ACCENTS, *REWRITES])}, '([A-Za-z])([0-9])', '{chr(92)}1 {chr(92)}2', 'g')"
    return NORMALIZED_BY.replace("CORRECTED", _replaced(book, corrections))


NORMALIZED = _normalized(CORRECTIONS)



def _written(spark, sf_dir) -> DataFrame:
    n, keys = F.col("l_linenumber"), F.array(*[F.lit(a) for a, _ in REWRITES])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.element_at(keys, (F.col("l_orderkey") % len(REWRITES) + 1).cast("int")).alias("k"), (F.col("l_orderkey") % 150 + 1).alias("c"), (F.col("l_partkey") % 60 + 1).alias("v"))
    at = F.concat("k", "c", F.lit(","), "v")
    initial = (
        F.when(n == 1, at).when(n == 2, F.concat(at, F.lit("s"))).when(n == 3, F.concat(at, F.lit("-"), F.col("v") + 1, F.lit("ss"))).when(n == 4, F.concat(at, F.lit("sq ; "), "k", "c", F.lit("."), "v"))
        .when(n == 5, F.concat(F.lit("cf. "), "k", "c", F.lit(" , "), "v", F.lit("--"), F.col("v") + 3)).when(n == 6, F.concat(F.lit("Éz "), "c", F.lit(","), "v", F.lit(" et "), at, F.lit("etc")))
        .otherwise(F.concat(F.lit("Ps 15,11; "), "k", "c", F.lit(",as")))
    )
    return rows.withColumn("initial", initial)


@query(f"WITH {WRITTEN}, {NORMALIZED} SELECT l_orderkey, l_linenumber, l_partkey, initial, normalized FROM s6")
def ref_rewrites(spark, sf_dir):
    return _written(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "initial", refs.normalize_ref(F.col("initial")).alias("normalized"))


#: Corrections of whole references, of which the second meets what the first has made.
OWN = [("Ps 1:", "Ps 150:"), ("Ps 150:2", "Mt 1:2"), ("Gn 10:", "Ex 10:"), ("Lk", "Luc")]


@query(f"WITH {WRITTEN}, {_normalized(OWN)} SELECT l_orderkey, l_linenumber, l_partkey, initial, normalized FROM s6")
def ref_corrections(spark, sf_dir):
    """References of all books with a table of corrections."""
    return refs.with_normalized(_written(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "initial"), "initial", corrections=OWN)


#: Opening tags as written, and as they are after labels are unified.
TAGS = [
    ('<seg type="biblicalRef">', '<seg type="biblicalRef" ana="Quotation">'),
    ('<seg  type="refScripturaire" ana="citationExacte">', '<seg type="biblicalRef" ana="Quotation">'),
    ('<seg ana="citationInexacte" type="biblicalRef" >', '<seg ana="inexactQuotation" type="biblicalRef">'),
    ('<seg ana="Occurrence"  type="biblicalRef">', '<seg ana="Occurrence" type="biblicalRef">'),
    ('<p rend="footnote  text">', '<p rend="footnote text">'),
]


@query(
    f"""WITH {WRITTEN}, {NORMALIZED}, t AS (SELECT *, [{', '.join(f"'{b}'" for _, b in TAGS)}][l_partkey % {len(TAGS)} + 1] AS tag, CASE WHEN l_partkey % {len(TAGS)} = {len(TAGS) - 1} THEN '</p>' ELSE '</seg>' END AS shut FROM s6)
 SELECT l_orderkey, l_linenumber, l_partkey, 1 AS n_matches, '<div>Quotation ' || tag || '<!--' || replace(initial, '--', '-{chr(92)}-') || '-->' || normalized || shut || '</div>' AS xml FROM t"""
)
def tei_references(spark, sf_dir):
    """Reference segments of TEI files, by all names of labels, with what was written kept in a comment."""
    rows = _written(spark, sf_dir)
    kind = (F.col("l_partkey") % len(TAGS) + 1).cast("int")
    xml = F.concat(F.lit('<div>lemma <hi rend="bold">x</hi>'), F.element_at(F.array(*[F.lit(a) for a, _ in TAGS]), kind), "initial", F.when(kind == len(TAGS), "</p>").otherwise("</seg>"), F.lit("</div>"))
    return rows.withColumn("done", refs.rewrite_references(xml)).select("l_orderkey", "l_linenumber", "l_partkey", "done.n_matches", "done.xml")


PATTERNS = """CASE p_partkey % 3 WHEN 0 THEN 'Ps ' || p_partkey || ':1' WHEN 1 THEN 'Ps ' || p_partkey || ':2' ELSE 'Mt ' || p_partkey || ':3' END"""


def tei_files(spark, sf_dir) -> DataFrame:
    """(path, xml): parts as TEI files."""
    k, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    seg = lambda verse: F.concat(F.lit('<note><seg type="biblicalRef" ana="allusion"><!--as written-->Ps '), k, F.lit(f":{verse}</seg></note>"))
    quote = F.concat(F.lit('<seg type="biblicalQuotation">'), "p_name")
    body = (
        F.when(kind == 0, F.concat(quote, seg(1), F.lit("</seg>")))
        .when(kind == 1, F.concat(quote, F.lit("</seg><!--between-->"), seg(2)))
        .otherwise(F.concat(quote, F.lit('</seg><note><p rend="footnote text"><!--as written-->Mt '), k, F.lit(":3</p></note>")))
    )
    xml = F.concat(F.lit('<TEI><text><p>ante <lb n="'), k, F.lit('"/>'), body, F.lit(" post</p></text></TEI>"))
    return parts(spark, sf_dir, "p_partkey", "p_name").select(F.concat(F.lit("p"), k).alias("path"), xml.alias("xml"))


@query(
    f"""WITH x AS (SELECT p_partkey, {PATTERNS} AS ref, string_split(p_name, ' ') AS l FROM part), w AS (SELECT p_partkey, ref, unnest(range(len(l) + 2)) AS i, unnest(list_concat(list_concat(['ante'], l), ['post'])) AS word, len(l) AS n FROM x)
 SELECT 'p' || p_partkey AS path, i::INT AS pos, word, CASE WHEN i BETWEEN 1 AND n THEN ref END AS reference, CASE WHEN i BETWEEN 1 AND n THEN CASE WHEN p_partkey % 3 = 2 THEN 'Occurrence' ELSE 'allusion' END END AS label,
 CASE WHEN i BETWEEN 1 AND n THEN 'as written' END AS initial_reference, CASE WHEN i > 0 THEN p_partkey::VARCHAR END AS line FROM w"""
)
def tei_patterns(spark, sf_dir):
    """Quotations whose reference stands in a note within them, in one that follows, or in a footnote paragraph."""
    return tei.tei_words(tei_files(spark, sf_dir))


@query(
    f"""WITH {VERSES}, q AS (SELECT o_orderkey AS k, o_custkey % 7 + 1 AS a, o_custkey % 5 + 1 AS b, o_orderpriority AS label FROM orders WHERE o_orderkey % 10 NOT IN (3, 7)),
 x AS (SELECT q.*, CASE WHEN k % 2 = 0 THEN a || ' - ' || b ELSE a || '.' || b END AS verse, CASE k % 3 WHEN 0 THEN 'mt ' WHEN 1 THEN 'co ' ELSE 'mt ' END AS book FROM q),
 n AS (SELECT k, book, unnest(CASE WHEN k % 2 = 0 THEN range(a, b + 1) ELSE [a, b] END) AS v, unnest(range(len(CASE WHEN k % 2 = 0 THEN range(a, b + 1) ELSE [a, b] END))) AS place FROM x),
 t AS (SELECT n.k, string_agg(n.book || v.text, ' ' ORDER BY n.place) AS text FROM n JOIN v ON v.o = n.k AND v.n = n.v GROUP BY n.k)
 SELECT CASE x.k % 3 WHEN 1 THEN '2 Co ' ELSE 'Mt ' END || x.k || ':' || x.verse AS "NT_ref", coalesce(t.text, '') AS "NT_text", x.label AS reuse_label, 'Ps ' || x.k || ':' || x.a AS "Ps_ref", coalesce('ps ' || p.text, '') AS "Ps_text"
 FROM x LEFT JOIN t USING (k) LEFT JOIN v p ON p.o = x.k AND p.n = x.a"""
)
def parallel_reuses(spark, sf_dir):
    """The table of reuses of psalms: names of books resolved, verses looked up, incomplete rows left out."""
    k, a, b = F.col("o_orderkey"), F.col("o_custkey") % 7 + 1, F.col("o_custkey") % 5 + 1
    rows = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "Mt").when(k % 3 == 1, "2Co").otherwise(" Matthew ").alias("nt_book"), k.cast("string").alias("nt_chapter"),
        F.when(k % 10 == 3, F.lit("x")).when(k % 2 == 0, F.concat(a, F.lit(" - "), b)).otherwise(F.concat(a, F.lit("."), b)).alias("nt_verse"),
        F.col("o_orderpriority").alias("label"), F.when(k % 10 == 7, F.lit(" ")).otherwise(k.cast("string")).alias("ps_chapter"), a.cast("string").alias("ps_verse"),
    )
    texts = _verses(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(x).alias("book"), F.lit(y).alias("mark")) for x, y in (("Matthew", "mt "), ("2 Corinthians", "co "), ("Psalms", "ps "))])).alias("b"), "o", "v", "text")
    return verses.parallel_table(rows, texts.select("b.book", F.col("o").cast("int").alias("chapter"), F.col("v").alias("verse"), F.concat("b.mark", "text").alias("text")))


@query("SELECT DISTINCT event_type AS marker, 'user' || (user_id % 7) AS file FROM events")
def distinct_markers(spark, sf_dir):
    from ..sources.sinks import distinct_markers as distinct

    return distinct(table(spark, sf_dir, "events").select(F.col("event_type").alias("marker"), F.concat(F.lit("user"), F.col("user_id") % 7).alias("file")), "marker", "file")


def _escaped(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@query(
    r"""WITH d AS (SELECT doc_id, [x FOR x IN string_split(trim(regexp_replace(regexp_replace(translate(text, '&<>', ''), '([.,;:!?])', ' \1 ', 'g'), '\s+', ' ', 'g')), ' ') IF x <> ''] AS l FROM documents)
 SELECT 'doc' || doc_id AS path, len(l) + 2 AS n_words, len(l) AS n_cited, 'Mt ' || doc_id || ':1' AS reference, md5(array_to_string(l, ' ')) AS digest FROM d WHERE len(l) > 0"""
)
def tei_words(spark, sf_dir):
    """All documents as TEI files; what is written as an entity goes in cleaning."""
    xml = F.concat(
        F.lit("<TEI xmlns='x'><teiHeader>head</teiHeader><text><p>before <seg type=\"biblicalQuotation\">"), _escaped(F.col("text")), F.lit('<note><seg type="biblicalRef" ana="Quotation"><!--mt-->Mt '), F.col("doc_id"), F.lit(":1</seg></note></seg> after</p></text></TEI>")
    )
    found = tei.tei_words(documents(spark, sf_dir).select(F.concat(F.lit("doc"), "doc_id").alias("path"), xml.alias("xml")))
    cited = F.col("reference").isNotNull()
    out = found.groupBy("path").agg(F.count("*").alias("n_words"), F.count_if(cited).alias("n_cited"), F.max("reference").alias("reference"), sequence.in_order(F.when(cited, F.col("word")), ["pos"]).alias("w"))
    return out.where("n_cited > 0").select("path", "n_words", "n_cited", "reference", F.md5(F.array_join("w", " ")).alias("digest"))


WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _package(runs: list[tuple[str, str | None]], note: str) -> bytes:
    """A Word document of one paragraph: runs of (text, colour), and a footnote reference after the last."""
    blob = io.BytesIO()
    style = lambda c: f'<w:rPr><w:color w:val="{c}"/></w:rPr>' if c else ""
    with zipfile.ZipFile(blob, "w") as z:
        body = "".join(f"<w:r>{style(c)}<w:t>{escape(t)}</w:t></w:r>" for t, c in runs)
        z.writestr("word/document.xml", f'<w:document {WORD}><w:p>{body}<w:r><w:footnoteReference w:id="1"/></w:r></w:p></w:document>')
        z.writestr("word/footnotes.xml", f'<w:footnotes {WORD}><w:footnote w:id="1"><w:t>{escape(note)}</w:t></w:footnote></w:footnotes>')
    return blob.getvalue()


@query(
    r"""SELECT 'doc' || doc_id AS path, len([x FOR x IN string_split_regex(regexp_replace(text, '\(\d+\)', ' ', 'g'), '\s+') IF x <> '']) AS n_words, len(regexp_extract_all(text, '\(\d+\)'))::INT AS n_breaks, 1 AS n_notes,
  (regexp_replace(text, '\(\d+\)', '', 'g') <> '')::INT AS n_cited FROM documents"""
)
def docx_tokens(spark, sf_dir):
    def package(batches):
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([f"doc{doc_id}"]), pa.array([_package([(text.as_py() or "", None)], "Mt 1,1")], pa.binary())], ["path", "content"])

    found = docx.docx_tokens(documents(spark, sf_dir).mapInArrow(package, "path string, content binary"))
    is_word = (F.col("type") == "text") & (F.trim(F.regexp_replace("content", r"\s+", "")) != "")
    count = lambda c: F.count_if(c).cast("int")
    return found.groupBy("path").agg(F.count_if(is_word).alias("n_words"), count(F.col("type") == "lb").alias("n_breaks"), count(F.col("type") == "fn_ref").alias("n_notes"), count(F.col("citation") == "Mt 1,1").alias("n_cited"))


STYLED = "x AS (SELECT p_partkey AS k, p_name AS a, lower(p_type) AS b, p_brand AS c, p_partkey % 28 + 1 AS ch, p_size AS v FROM part)"


def _styled(spark, sf_dir) -> DataFrame:
    """Parts as Word documents: a quotation in colour with an insertion, and its reference in a footnote."""

    def package(batches):
        for b in batches:
            rows = b.to_pylist()
            runs = [[(f"{x['p_name']}: ", None), (f"{x['p_type'].lower()} ", "FF0000"), (f"{x['p_brand']} ", None), (x["p_name"], "FF0000")] for x in rows]
            notes = [f"Io {x['p_partkey'] % 28 + 1},{x['p_size']}s" for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f"/in/part{x['p_partkey']}.docx" for x in rows], pa.string()), pa.array([_package(r, n) for r, n in zip(runs, notes, strict=True)], pa.binary())], ["path", "content"])

    return parts(spark, sf_dir, "p_partkey", "p_name", "p_brand", "p_type", "p_size").mapInArrow(package, "path string, content binary")


@query(
    rf"""WITH {STYLED} SELECT '/in/part' || k || '.docx' AS path, 'c:FF0000' AS style, len(string_split(b, ' ')) + len(string_split(a, ' ')) AS n_quoted, len(string_split(c, ' ')) AS n_inserted, len(string_split(a, ' ')) AS n_plain,
 'Io ' || ch || ',' || v || 's' AS note FROM x"""
)
def docx_styled_quotations(spark, sf_dir):
    found = docx.docx_tokens(_styled(spark, sf_dir)).where("type = 'text' and trim(content) <> ''")
    cited = F.col("citation").isNotNull()
    return found.groupBy("path").agg(
        F.array_join(F.array_sort(F.collect_set(F.array_join("style", " "))), ",").alias("style"), F.count_if(cited & ~F.col("is_insertion")).alias("n_quoted"), F.count_if(cited & F.col("is_insertion")).alias("n_inserted"), F.count_if(~cited).alias("n_plain"), F.max("citation").alias("note")
    )


#: Marks of runs of Word documents: the markup, and the style that it is.
RUN_MARKS = [
    ('<w:color w:val="00FF00"/>', "c:00FF00"), ('<w:highlight w:val="yellow"/>', "h:yellow"), ('<w:shd w:fill="D9D9D9"/>', "s:D9D9D9"), ('<w:rStyle w:val="Quote"/>', "st:Quote"),
    ('<w:highlight w:val="red"/><w:color w:val="auto"/><w:rStyle w:val="Emphasis"/>', "h:red st:Emphasis"), ('<w:color w:val="auto"/><w:highlight w:val="none"/><w:shd w:fill="clear"/>', None),
]


@query(
    f"""SELECT '/in/part' || p_partkey || '.docx' AS path, [{', '.join('NULL' if b is None else f"'{b}'" for _, b in RUN_MARKS)}][p_partkey % {len(RUN_MARKS)} + 1] AS style,
 CASE WHEN p_partkey % {len(RUN_MARKS)} = {len(RUN_MARKS) - 1} THEN len(string_split(p_name, ' ')) + 1 ELSE len(string_split(p_name, ' ')) END AS n_words FROM part"""
)
def docx_styles(spark, sf_dir):
    """Quotations marked by colour, highlight, shading, a style, or several of them, and marks that are none."""

    def package(batches):
        for b in batches:
            made = []
            for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blob, mark = io.BytesIO(), RUN_MARKS[k % len(RUN_MARKS)][0]
                with zipfile.ZipFile(blob, "w") as z:
                    z.writestr("word/document.xml", f"<w:document {WORD}><w:p><w:r><w:t>before </w:t></w:r><w:r><w:rPr>{mark}</w:rPr><w:t>{escape(name)}</w:t></w:r></w:p></w:document>")
                made.append(blob.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"/in/part{k}.docx" for k in b.column(0).to_pylist()], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    found = docx.docx_tokens(parts(spark, sf_dir, "p_partkey", "p_name").mapInArrow(package, "path string, content binary")).where("type = 'text' and trim(content) <> ''")
    style, plain = F.array_join("style", " "), F.col("p_plain") == F.col("n_all")
    out = found.groupBy("path").agg(F.max(style).alias("style"), F.count("*").alias("n_all"), F.count_if(F.col("style").isNull()).alias("p_plain"))
    return out.select("path", "style", F.when(plain, F.col("n_all")).otherwise(F.col("n_all") - F.col("p_plain")).alias("n_words"))


#: Markup around a name that cleaning takes away, and what is left of it.
CLEANED = [
    ('<seg type="modified">NAME</seg>', "NAME"), ('<seg type="insertion">NAME</seg>', "NAME"), ('<seg type="insertion/modified">NAME</seg>', "NAME"), ("NAME<c>rz</c>", "NAME"), ("NAME&nbsp;", "NAME"), ("NAME&amp;lt;", "NAMElt ;"),
    ('NAME<seg type="biblicalQuotation">,</seg>', "NAME"), ('NA<pb break="no" edRef="#a" n="1"></pb>ME', "NAME"), ('NA<lb break="no" n="7"></lb>ME', "NAME"),
]


@query(
    f"""WITH c AS (SELECT n_nationkey AS k, replace(n_name, ' ', '') AS name, unnest(range({len(CLEANED)})) AS kind, unnest([{', '.join(f"'{b}'" for _, b in CLEANED)}]) AS left_over FROM nation)
 SELECT 'n' || k || '-' || kind AS path, 'ante ' || replace(left_over, 'NAME', name) || ' post' AS words FROM c"""
)
def tei_cleanup(spark, sf_dir):
    """Everything that is taken out of TEI files before they are read: segments, stray characters, entities, and breaks within words."""
    kinds = F.array(*[F.lit(a) for a, _ in CLEANED])
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.replace("n_name", F.lit(" "), F.lit("")).alias("name"), F.posexplode(kinds).alias("kind", "markup"))
    half = (F.length("name") / 2).cast("int")
    parted = F.replace(F.replace("markup", F.lit("NAME"), F.col("name")), F.lit("NA<"), F.concat(F.substring(F.col("name"), F.lit(1), half), F.lit("<")))
    parted = F.replace(parted, F.lit(">ME"), F.concat(F.lit(">"), F.substring(F.col("name"), half + 1, F.length("name"))))
    xml = F.concat(F.lit("<TEI><text><p>ante "), parted, F.lit(" post</p></text></TEI>"))
    found = tei.tei_words(rows.select(F.concat(F.lit("n"), "n_nationkey", F.lit("-"), "kind").alias("path"), xml.alias("xml")))
    return found.groupBy("path").agg(F.array_join(sequence.in_order(F.col("word"), ["pos"]), " ").alias("words"))


QUOTED = r"""w AS (SELECT *, regexp_replace(lower(b || ' ' || c || ' ' || a), '[^A-Za-zÀ-ÿ\s.,;:!?''\n]', '', 'g') AS quoted, 'Jn ' || ch || ':' || v || '-' || (v + 2) AS ref, 'Io ' || ch || ',' || v || 's' AS initial FROM x)"""


@query(
    rf"""WITH {STYLED}, {QUOTED} SELECT 'part' || k || '.docx' AS source_file, 0 AS sentence_index, 'o' AS line, quoted AS reuse_tag_set, 'Occurrence' AS label, initial AS initial_reference, ref AS reference,
 CASE WHEN v % 2 = 0 THEN 'john ' || ch ELSE '' END AS biblical_text FROM w"""
)
def corpus_from_docx(spark, sf_dir):
    """The whole way: Word documents, TEI, words, normalised references, quotations with their verse texts."""
    from . import corpus

    words = corpus.words_from_tei(docx.docx_to_tei(_styled(spark, sf_dir)))
    parts = table(spark, sf_dir, "part").where("p_size % 2 = 0")
    texts = parts.select(F.concat(F.lit("Jn "), F.col("p_partkey") % 28 + 1, F.lit(":"), "p_size", F.lit("-"), F.col("p_size") + 2).alias("reference"), F.concat(F.lit("john "), F.col("p_partkey") % 28 + 1).alias("text"))
    return corpus.datasets(words, texts)["sets"].select("source_file", "sentence_index", "line", "reuse_tag_set", "label", "initial_reference", "reference", "biblical_text")


SCORES = "s AS (SELECT a.vec_id AS anchor, b.vec_id AS cand, list_cosine_similarity(list_reverse(a.embedding::DOUBLE[]), b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b), k AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 12) DESC, cand) AS rank FROM s)"


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All embeddings as candidates; all of them, turned round so that none meets itself, as anchors."""
    e = table(spark, sf_dir, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    return e.select(F.col("vec_id").alias("anchor"), F.reverse("vector").alias("vector")), e.select(F.col("vec_id").alias("cand"), "vector")


@query(
    "WITH s AS (SELECT a.vec_id AS anchor, b.vec_id AS cand, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, 12) DESC, cand) AS rank FROM s) SELECT anchor, cand, rank::INT AS rank, round(score, 4) AS score FROM k WHERE rank <= 10"
)
def cosine_topk(spark, sf_dir):
    """A search: the embeddings whose number is divisible by 100 against all."""
    e = table(spark, sf_dir, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    queries, rows = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("anchor"), "vector"), e.select(F.col("vec_id").alias("cand"), "vector")
    return similarity.top_k(queries, rows, 10).select("anchor", "cand", "rank", F.round("score", 4).alias("score"))


def _searched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("anchor"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("cand"), F.col("embedding").alias("vector"))


@query(ORACLE_SQL["cosine_topk"])
def indexed_topk_exact(spark, sf_dir):
    """The same search by an index: cells that may hold something nearer than what was found are searched too."""
    anchors, cands = _searched(spark, sf_dir)
    found = vector_index.search(vector_index.build(cands), anchors, 10, exact=True)
    return found.select("anchor", "cand", "rank", F.round("score", 4).alias("score"))


@query("SELECT count(*) FILTER (vec_id % 100 = 0) AS n_anchors, 10 * count(*) FILTER (vec_id % 100 = 0) AS n_true, 10 * count(*) FILTER (vec_id % 100 = 0) AS n_returned, TRUE AS recall_of_90 FROM embeddings")
def indexed_topk_recall(spark, sf_dir):
    """What the index finds of the true neighbours, in the cells that it searches first only."""
    anchors, cands = _searched(spark, sf_dir)
    found = stored(vector_index.search(vector_index.build(cands), anchors, 10), "found")
    measured = vector_index.recall_of(found, similarity.top_k(anchors, cands, 10))
    return measured.crossJoin(F.broadcast(found.agg(F.count("*").alias("n_returned")))).select("n_anchors", "n_true", "n_returned", (F.col("recall") >= 0.9).alias("recall_of_90"))


LABELLED = "SELECT d.doc_id, CASE WHEN coalesce(l.quality, 0) = 0 THEN 'NaR' ELSE 'Quotation' END AS label, CASE WHEN l.toxic = 1 THEN d.source ELSE '' END AS biblical_text FROM documents d LEFT JOIN labels l USING (doc_id)"


def _labelled(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.coalesce("quality", F.lit(0)) == 0, "NaR").otherwise("Quotation").alias("label"), F.when(F.col("toxic") == 1, F.col("source")).otherwise("").alias("biblical_text"))


@query(
    f"WITH {SCORES}, x AS ({LABELLED}) SELECT x.doc_id, x.label, CASE WHEN x.label = 'NaR' AND x.biblical_text = '' THEN 'text ' || k.cand ELSE x.biblical_text END AS biblical_text,"
    " CASE WHEN x.label = 'NaR' AND x.biblical_text = '' THEN round(k.score, 4) END AS score FROM x LEFT JOIN k ON k.anchor = x.doc_id AND k.rank = 1"
)
def cosine_fill(spark, sf_dir):
    """All documents; those without a vector keep what they have."""
    anchors, cands = _vectors(spark, sf_dir)
    rows = _labelled(spark, sf_dir).join(anchors, F.col("doc_id") == F.col("anchor"), "left")
    out = similarity.fill_nearest(rows, cands.withColumn("candidate", F.concat(F.lit("text "), "cand")))
    return out.select("doc_id", "label", "biblical_text", F.round("score", 4).alias("score"))


@query(ORACLE_SQL["cosine_fill"])
def indexed_fill(spark, sf_dir):
    """Filling by the index, searched exactly."""
    anchors, cands = _vectors(spark, sf_dir)
    rows = _labelled(spark, sf_dir).join(anchors, F.col("doc_id") == F.col("anchor"), "left")
    out = similarity.fill_nearest(rows, cands.withColumn("candidate", F.concat(F.lit("text "), "cand")), search=functools.partial(vector_index.nearest, exact=True))
    return out.select("doc_id", "label", "biblical_text", F.round("score", 4).alias("score"))


@query(f"WITH {SCORES}, x AS ({LABELLED}) SELECT count(k.score) AS n, round(avg(k.score), 4) AS mean_similarity FROM x JOIN k ON k.anchor = x.doc_id AND k.rank = 1 WHERE x.label = 'NaR' AND x.biblical_text = ''")
def mean_similarity(spark, sf_dir):
    """The report of filling."""
    anchors, cands = _vectors(spark, sf_dir)
    rows = _labelled(spark, sf_dir).join(anchors, F.col("doc_id") == F.col("anchor"), "left")
    return similarity.mean_similarity(similarity.fill_nearest(rows, cands.withColumn("candidate", F.lit("text"))))


@query(
    f"""WITH x AS ({LABELLED}), c AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS number, text AS candidate FROM benchmark)
 SELECT x.doc_id, x.label, CASE WHEN x.label = 'NaR' AND x.biblical_text = '' THEN c.candidate ELSE x.biblical_text END AS biblical_text FROM x JOIN c ON c.number = ('0x' || substr(md5('s' || x.doc_id), 1, 8))::BIGINT % (SELECT count(*) FROM benchmark)"""
)
def random_fill(spark, sf_dir):
    cands = similarity.numbered(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("candidate")), "item_id").select("number", "candidate")
    return similarity.fill_random(_labelled(spark, sf_dir), cands, "doc_id", seed="s").select("doc_id", "label", "biblical_text")


@query(
    f"""WITH {SCORES}, t AS (SELECT vec_id, 'lab ' || label AS text FROM embeddings),
 n AS (SELECT k.*, (contains(p.text, c.text) OR contains(c.text, p.text)) AS bad FROM k JOIN t p ON p.vec_id = k.anchor JOIN t c ON c.vec_id = k.cand),
 h AS (SELECT anchor, min(rank) FILTER (NOT bad AND rank <= 10) AS hit, min(cand) FILTER (NOT bad) AS other FROM n GROUP BY anchor)
 SELECT h.anchor, n.cand AS negative, round(n.score, 4) AS neg_cos_sim, CASE WHEN hit IS NOT NULL THEN hit - 1 ELSE 10 + (SELECT count(*) FROM t WHERE vec_id < h.other) END AS rejected
 FROM h LEFT JOIN n ON n.anchor = h.anchor AND (n.rank = h.hit OR (h.hit IS NULL AND n.cand = h.other))"""
)
def hard_negatives(spark, sf_dir):
    anchors, cands = _vectors(spark, sf_dir)
    texts = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("lab "), "label").alias("t"))
    a = anchors.join(texts.select(F.col("vec_id").alias("anchor"), F.col("t").alias("positive")), "anchor")
    c = cands.join(texts.select(F.col("vec_id").alias("cand"), F.col("t").alias("candidate")), "cand")
    return similarity.hard_negatives(a, c).withColumn("neg_cos_sim", F.round("neg_cos_sim", 4))


@query("SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE b.text <> '' AND contains(lower(d.text), lower(b.text))")
def reuse_detection(spark, sf_dir):
    return similarity.containing(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query(
    f"WITH x AS ({LABELLED}) SELECT label, count(*) AS n_rows, count(*) FILTER (biblical_text <> '') AS with_text, round(avg((biblical_text <> '')::INT), 6) AS rate FROM x GROUP BY label"
)
def match_rate_summary(spark, sf_dir):
    found = F.col("biblical_text") != ""
    return _labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if(found).alias("with_text"), F.round(F.avg(found.cast("int")), 6).alias("rate"))


def _corpus_words(spark, sf_dir) -> DataFrame:
    """Documents as annotated words: three of ten places in a row refer to a verse."""
    at = F.col("pos") % 10
    ref = F.when(at < 3, F.concat(F.lit("Ps "), F.col("doc_id") % 150 + 1, F.lit(":"), (F.floor(F.col("pos") / 10) % 7 + 1).cast("string"))).otherwise("o")
    return tokens(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("source_path"), F.col("doc_id").cast("string").alias("source_file"), F.col("pos").alias("word_index"), F.concat(F.floor(F.col("pos") / 8) + 1, F.lit(".0")).alias("line"), "word",
        F.when(at < 3, "Quotation").otherwise("NaR").alias("label"), ref.alias("reference"), ref.alias("reference normalized"),
    )


@query(
    f"""WITH {TOKENS}, w AS (SELECT *, CASE WHEN pos % 10 < 3 THEN 'Ps ' || (doc_id % 150 + 1) || ':' || ((pos // 10) % 7 + 1) ELSE 'o' END AS ref, pos // 8 + 1 AS line FROM toks),
 c AS (SELECT *, sum((word IN ('.', '?', '!', ';'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS seen, CASE WHEN lag(ref) OVER (PARTITION BY doc_id ORDER BY pos) = ref THEN 0 ELSE 1 END AS fresh FROM w),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c)
 SELECT doc_id::VARCHAR AS source_file, max(seen)::INT AS sentence_index, CASE WHEN min(line) = max(line) THEN min(line)::VARCHAR ELSE min(line) || '-' || max(line) END AS line, """
    r"""regexp_replace(string_agg(word, ' ' ORDER BY pos), '\s+([.,;:?!])', '\1', 'g') AS reuse_tag_set, ref AS reference FROM r WHERE ref <> 'o' GROUP BY doc_id, run, ref"""
)
def reuse_sets(spark, sf_dir):
    return sequence.reuse_sets(_corpus_words(spark, sf_dir)).select("source_file", "sentence_index", "line", "reuse_tag_set", "reference")


@query(
    f"""WITH {TOKENS}, w AS (SELECT *, CASE WHEN pos % 10 < 3 THEN 'Ps ' || (doc_id % 150 + 1) || ':' || ((pos // 10) % 7 + 1) END AS ref, pos // 8 + 1 AS line,
   coalesce(sum((word IN ('.', '?', '!', ';'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS sentence_index FROM toks),
 f AS (SELECT doc_id, sentence_index, ref, min(pos) AS place FROM w WHERE ref IS NOT NULL GROUP BY ALL), g AS (SELECT doc_id, sentence_index, string_agg(ref, ' ; ' ORDER BY place) AS reference FROM f GROUP BY ALL),
 s AS (SELECT doc_id, sentence_index, CASE WHEN min(line) = max(line) THEN min(line)::VARCHAR ELSE min(line) || '-' || max(line) END AS line, count(*) AS n FROM w GROUP BY ALL)
 SELECT s.doc_id::VARCHAR AS source_file, s.sentence_index, s.line, coalesce(g.reference, 'o') AS reference, CASE WHEN g.reference IS NULL THEN 'NaR' ELSE 'Quotation' END AS label FROM s LEFT JOIN g USING (doc_id, sentence_index)"""
)
def annotated_sentences(spark, sf_dir):
    return sequence.sentences(_corpus_words(spark, sf_dir)).select("source_file", "sentence_index", "line", "reference", "label")


@query(ORACLE_SQL["reuse_sets"])
def scanned_reuse_sets(spark, sf_dir):
    """The same by a prefix scan over chunks of 500 words."""
    return sequence.reuse_sets(_corpus_words(spark, sf_dir), 500).select("source_file", "sentence_index", "line", "reuse_tag_set", "reference")


@query(ORACLE_SQL["annotated_sentences"])
def scanned_sentences(spark, sf_dir):
    return sequence.sentences(_corpus_words(spark, sf_dir), 500).select("source_file", "sentence_index", "line", "reference", "label")


@query(ORACLE_SQL["event_runs"])
def scanned_event_runs(spark, sf_dir):
    """Runs over an order that is no index: chunks are ranges of users and times."""
    events = sequence.placed(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    runs = sequence.mark_runs(events, ["user_id"], ["ts", "event_id"], F.col("event_type"), chunk=F.col("chunk"))
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("total"))


@query(
    f"""WITH RECURSIVE {TOKENS}, w AS (SELECT *, pos // 5000 AS chunk, pos % 5000 AS i, CASE WHEN pos % 10 < 3 THEN 'Ps ' || (doc_id % 150 + 1) || ':' || ((pos // 10) % 7 + 1) END AS ref, pos // 8 + 1 AS line FROM toks),
 c AS (SELECT doc_id, chunk, count(*) AS n, coalesce(list(i ORDER BY i) FILTER (word IN ('.', '?', '!', ';')), []) AS ends, coalesce(list(i ORDER BY i) FILTER (word IN (',', ':')), []) AS stops FROM w GROUP BY ALL),
 s AS (SELECT doc_id, chunk, -1::BIGINT AS a, -1::BIGINT AS b, n, ends, stops FROM c
  UNION ALL SELECT doc_id, chunk, b + 1, least(n - 1, coalesce(list_min([x FOR x IN ends IF x > b]), n - 1), coalesce(list_min([x FOR x IN stops IF x >= b + 40]), n - 1))::BIGINT, n, ends, stops FROM s WHERE b < n - 1),
 g AS (SELECT doc_id, chunk, a, b, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk, a) - 1)::INT AS sentence_index FROM s WHERE a >= 0),
 p AS (SELECT g.doc_id, g.sentence_index, w.pos, w.word, w.ref, w.line FROM g JOIN w ON w.doc_id = g.doc_id AND w.chunk = g.chunk AND w.i BETWEEN g.a AND g.b),
 f AS (SELECT doc_id, sentence_index, ref, min(pos) AS place FROM p WHERE ref IS NOT NULL GROUP BY ALL), r AS (SELECT doc_id, sentence_index, string_agg(ref, ' ; ' ORDER BY place) AS reference FROM f GROUP BY ALL),
 t AS (SELECT doc_id, sentence_index, CASE WHEN min(line) = max(line) THEN min(line)::VARCHAR ELSE min(line) || '-' || max(line) END AS line, """
    r"""regexp_replace(string_agg(word, ' ' ORDER BY pos), '\s+([.,;:?!])', '\1', 'g') AS sentence FROM p GROUP BY ALL)
 SELECT t.doc_id::VARCHAR AS source_path, t.doc_id::VARCHAR AS source_file, t.sentence_index, t.line, t.sentence, CASE WHEN r.reference IS NULL THEN 'NaR' ELSE 'Quotation' END AS label, coalesce(r.reference, 'o') AS initial_reference, coalesce(r.reference, 'o') AS reference
 FROM t LEFT JOIN r USING (doc_id, sentence_index)"""
)
def annotated_segments(spark, sf_dir):
    return sequence.segments(_corpus_words(spark, sf_dir))


def _letters(text: str) -> str:
    return f"[len({text}) - len(replace({text}, c, '')) FOR c IN string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ',')]::DOUBLE[] AS v"


FOLDED = "translate(text, 'jv', 'iu')"


@query(
    f"""WITH a AS (SELECT row_number() OVER () AS id, {FOLDED} AS text, {_letters(f"lower({FOLDED})")} FROM conversations WHERE trim(text) <> ''),
 b AS (SELECT item_id, {FOLDED} AS text, {_letters(f"lower({FOLDED})")} FROM benchmark WHERE trim(text) <> ''),
 s AS (SELECT a.id, a.text AS anchor, b.item_id, b.text AS negative, list_cosine_similarity(a.v, b.v) AS score, contains(lower(a.text), lower(b.text)) OR contains(lower(b.text), lower(a.text)) AS bad FROM a, b),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(coalesce(score, -2), 12) DESC, item_id) AS rank FROM s),
 h AS (SELECT id, min(rank) FILTER (NOT bad AND rank <= 10) AS hit, min(item_id) FILTER (NOT bad) AS other FROM k GROUP BY id)
 SELECT k.anchor, k.anchor AS positive, k.negative, round(k.score, 4) AS neg_cos_sim FROM h JOIN k USING (id) WHERE k.rank = h.hit OR h.hit IS NULL AND k.item_id = h.other"""
)
def triplet_mining(spark, sf_dir):
    """All turns of the conversations, against the passages, by letter counts."""
    pairs = table(spark, sf_dir, "conversations").select(F.col("text").alias("sentence"), F.col("text").alias("biblical_text"))
    cands = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cand"), F.col("text").alias("candidate"))
    return similarity.triplets(pairs, cands, letter_encoder)
