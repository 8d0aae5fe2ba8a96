"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only.

A line is removed if an earlier one is equal to it, or, for lines of at least
MIN_BYTES bytes, lies within EDITS edits of it; edits count UTF-8 bytes. Lines
are ranked by document and line number. Copies of a line are one distinct line
with its first place. Shorter lines are compared for equality only, as two
edits make another line of them; empty lines are kept.

Every distinct line is cut into EDITS + 1 segments, indexed by their content,
number and the line's length. If two lines lie within EDITS edits, one segment
of the shorter is left unchanged, and stands in the longer within a few places
of its own: line lengths and segment number bound how far edits before and
after it can have moved it. Those substrings are probed. Candidates are
verified by a banded bit-parallel edit distance, on what is left of them
without their common beginning and end.

All joins are equi-joins on hashes of content; texts stay where they are, but
for those of lines that share a segment with another one. Those have their letters and
digits counted, and lines whose counts lie further apart than edits allow are no candidates.
Counts are kept as codes of three bits that differ in as many bits as the counts do, modulo 6.

Where over CROWDED lines of one length share a segment, it goes on mattering
what else they have: without that segment, and without what all lines of the group begin and end
with, they lie within as many edits as before. These rests are cut into segments and joined in
the same way, until groups are small or at most EDITS bytes are left. So
variants of boilerplate, with numbers in it, hardly multiply. Only groups whose
rows become more and more that way, as of copies of one long line that
are changed in many places, are joined by the counts at once. The segments that most lines share don't cross the network at all.

Edge cases: null and empty texts have one empty line. A null doc_id ranks last;
documents without one, or with the same one, rank by a hash of their text. Rows
that repeat one another in full tie, so neither removes the other's lines. Empty
tables give empty results. Very long lines are joined like others, very long
texts line by line. `deduplicated` keeps all columns whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, join_counted, stored

EDITS, MIN_BYTES = 2, 20
#: Indexed lines under one segment from which on their rests are looked at.
CROWDED = 32
#: Rests of so many bytes are always cut into segments again; longer ones unless that makes GROWTH times as many rows of them.
NARROW, GROWTH = 16, 1.5
#: Segments whose lines are known to be crowded where they lie, as so many of them share it.
HEAVY = 1000
#: Signs that are counted, and the codes of 0 to 5: a code's neighbours differ in one bit.
SIGNS, CODES = "etanisorhd 0123456789", (0, 1, 3, 7, 6, 4)
#: Pieces of a candidate that are looked up in the other line before the distance is taken.
PIECES = 12
#: Lines whose hashes and places (44 bytes each) are broadcast to pick their texts; more are joined by a shuffle.
FEW = 500_000
LAST = 2**63 - 1
DOC = ["_fx_key", "_fx_key2"]


def _identified(docs: DataFrame, *columns) -> DataFrame:
    """docs' columns with 128 bits that stand for a document, by its doc_id and text."""
    keys = [F.xxhash64("doc_id", "text").alias(DOC[0]), F.xxhash64(F.lit(1), "doc_id", "text").alias(DOC[1])]
    return docs.select(*keys, *columns)


def line_rows(docs: DataFrame) -> DataFrame:
    """_fx_key, _fx_key2 (document), _fx_rank, _fx_pos, line, h1, h2 (hashes) of each line that isn't empty."""
    rows = _identified(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_fx_rank"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("_fx_pos", "line"))
    return rows.where("line <> ''").withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _places(edits: int):
    """(segment, how much shorter the indexed line is, offset of the substring from the segment's place) of each probe."""
    for delta in range(edits + 1):
        for i in range(edits + 1):
            lo, hi = max(-i, delta - (edits - i)), min(i, delta + (edits - i))
            for off in range(lo, hi + 1):
                yield i, delta, off


def _cut(size: Column, i, parts: int) -> Column:
    return F.floor(size * i / parts).cast("int")


def _key(line: str, size: Column, i: int, parts: int, off: int = 0, group: Column | None = None) -> Column:
    """The hash of segment i of a line of size bytes, taken off places further on."""
    a, b = _cut(size, i, parts), _cut(size, i + 1, parts)
    content = F.substring(line, a + off + 1, b - a)
    key = F.xxhash64(*([] if group is None else [group]), size, F.lit(i), content)
    return key if off >= 0 else F.when(a + off >= 0, key)


def _counts(string: Column) -> Column:
    """The codes of the counts of SIGNS, in a long."""
    codes = F.array(*[F.lit(c).cast("long") for c in CODES])
    count = lambda c: (F.octet_length(string) - F.octet_length(F.replace(string, F.lit(c), F.lit("")))) % len(CODES)
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.get(codes, count(c)), 3 * j) for j, c in enumerate(SIGNS)])


def _live(rows: DataFrame) -> DataFrame:
    """rows of segments that two lines or more share, with n, the number of indexed ones. rows: k, h1, own (whether it is indexed), and more."""
    own = F.col("own").cast("int")
    heavy = F.broadcast(rows.where("own").groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).orderBy(F.col("n").desc(), "k").limit(HEAVY))
    by_key = Window.partitionBy("k")
    rest = rows.join(heavy, "k", "left_anti").withColumns({"n": F.sum(own).over(by_key), "least": F.min("h1").over(by_key), "most": F.max("h1").over(by_key)})
    return rest.where("n > 0 and least <> most").drop("least", "most").unionByName(rows.join(heavy, "k"))


def _paired(rows: DataFrame, key: str, edits: int) -> DataFrame:
    """(a1, b1): lines of one group that may lie within edits edits. rows: the group's key, h1, counts, own, delta; probing lines have own = false."""
    a = rows.where("own").select(F.col(key).alias("x"), F.col("h1").alias("a1"), F.col("counts").alias("ac"))
    b = rows.where("not own").select(F.col(key).alias("y"), F.col("h1").alias("b1"), F.col("counts").alias("bc"), "delta")
    # an edit changes two counts by one at most; lines of one length meet twice, and count once
    close = F.bit_count(F.col("ac").bitwiseXOR(F.col("bc"))) <= 2 * edits
    return a.join(b, (a.x == b.y) & ((F.col("delta") > 0) | (F.col("a1") < F.col("b1"))) & close).select("a1", "b1")


def _shared(a: Column, b: Column, most: Column) -> Column:
    """How long a beginning two strings share, up to most: by halving steps."""
    piece = lambda x, p, s: F.substring(x, p + 1, s)
    step = lambda p, s: F.when((p + s <= most) & (piece(a, p, s) == piece(b, p, s)), p + s).otherwise(p)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), step)


def _rest(s: str, edits: int) -> Column:
    """A line without the segment that it has at its place at."""
    places = list(_places(edits))
    i, delta, off = (F.element_at(F.array(*[F.lit(x[k]) for x in places]), F.col("at") + 1) for k in range(3))
    size = F.length(s) - F.when(F.col("own"), 0).otherwise(delta)
    begin, width = _cut(size, i, edits + 1), _cut(size, i + 1, edits + 1) - _cut(size, i, edits + 1)
    begin = begin + F.when(F.col("own"), 0).otherwise(off)
    return F.concat(F.substring(s, F.lit(1), begin), F.substring(s, begin + width + 1, F.length(s)))


def _stripped(rows: DataFrame) -> DataFrame:
    """Groups g without what all their lines begin and end with; size is what is left of the indexed ones. rows: g, h1, counts, own, delta, r."""
    rows, back = stored(rows, "rests", "lz4_raw"), F.reverse("r")
    ends = rows.groupBy("g").agg(F.count("*").alias("n"), F.min(F.length("r") - F.when(F.col("own"), 0).otherwise(F.col("delta"))).alias("size"), F.min("r").alias("a"), F.max("r").alias("b"), F.min(back).alias("c"), F.max(back).alias("d"))
    ends = ends.withColumn("p", _shared(F.col("a"), F.col("b"), F.col("size"))).withColumn("q", _shared(F.col("c"), F.col("d"), F.col("size") - F.col("p")))
    ends = stored(ends.select("g", "n", "p", "q", (F.col("size") - F.col("p") - F.col("q")).alias("size")), "ends", "lz4_raw")
    return join_counted(rows, ends, ["g"]).select("g", "h1", "counts", "own", "delta", F.substring("r", F.col("p") + 1, F.length("r") - F.col("p") - F.col("q")).alias("r"), "size")


def candidates(rows: DataFrame, edits: int, texts) -> DataFrame:
    """(a1, b1): hashes of lines that share a segment and have nearly the same letters. texts: gives (h1, line) of those of a table of h1."""
    parts, places = edits + 1, list(_places(edits))
    delta_of = F.element_at(F.array(*[F.lit(d) for _, d, _ in places]), F.col("at") + 1)
    indexed = [k for k, (_, delta, off) in enumerate(places) if delta == off == 0]
    n, line = F.octet_length("line"), F.col("line").cast("binary")
    names = [f"k{k}" for k in range(len(places))]
    # copies have equal keys, so they are merged before anything is multiplied, and texts stay where they are
    keys = [_key("line", n - delta, i, parts, off).alias(c) for (i, delta, off), c in zip(places, names, strict=True)]
    keyed = rows.withColumn("line", line).select("h1", "h2", *keys).groupBy("h1", "h2").agg(*[F.max(c).alias(c) for c in names])
    every = keyed.select("h1", F.posexplode(F.array(*names)).alias("at", "k")).where("k is not null").withColumn("own", F.col("at").isin(indexed))
    found = stored(_live(every), "shared", "lz4_raw")
    own = texts(found.select("h1").distinct()).select("h1", _counts(F.col("line")).alias("counts"), F.decode(F.col("line").cast("binary"), "ISO-8859-1").alias("s"))
    own = stored(own, "sharing", "lz4_raw")
    # what is indexed under a segment probes it as well
    found = found.join(own.select("h1", "counts"), "h1").withColumn("delta", delta_of)
    small = found.where(F.col("n") <= CROWDED)
    out = checkpoint(_paired(small.where("own").unionByName(small.withColumn("own", F.lit(False))), "k", edits).distinct())
    crowd = found.where(F.col("n") > CROWDED).join(own.select("h1", "s"), "h1")
    # groups by how much longer the probing lines are
    probing = crowd.withColumn("own", F.lit(False))
    crowd = crowd.where("own").withColumn("delta", F.explode(F.array(*[F.lit(d) for d in range(edits + 1)]))).unionByName(probing)
    crowd = crowd.select(F.xxhash64("k", "delta").alias("g"), "h1", "counts", "own", "delta", _rest("s", edits).alias("r"))
    while not crowd.isEmpty():
        rest = stored(_stripped(crowd), "stripped", "lz4_raw")
        key = lambda i, off: _key("r", F.col("size"), i, parts, off, F.col("g"))
        chosen = [F.when(F.col("own"), key(i, off) if k in indexed else None).when(F.col("delta") == delta, key(i, off)) for k, (i, delta, off) in enumerate(places)]
        every = rest.where(F.col("size") > edits).select("g", "h1", "counts", "own", "delta", "r", F.posexplode(F.array(*chosen)).alias("at", "k")).where("k is not null")
        found = stored(_live(every), "shared", "lz4_raw")
        crowd = found.where(F.col("n") > CROWDED)
        # at most as many bytes as edits are left: few lines can differ so little, and those of one length are all true pairs
        whole = rest.groupBy("g").agg(F.count("*").alias("before"), F.first("size").alias("size")).join(crowd.groupBy("g").agg(F.count("*").alias("after")), "g", "left")
        whole = checkpoint(whole.where((F.col("size") <= edits) | (F.col("size") > NARROW) & (F.col("after") > GROWTH * F.col("before"))).select("g"))
        out = out.unionByName(checkpoint(_paired(rest.join(whole, "g", "left_semi"), "g", edits).unionByName(_paired(found.where(F.col("n") <= CROWDED).join(whole, "g", "left_anti"), "k", edits)).distinct()))
        crowd = crowd.join(whole, "g", "left_anti").select(F.col("k").alias("g"), "h1", "counts", "own", "delta", _rest("r", edits).alias("r"))
    return out.distinct()


def banded_distance(a: str, b: str, edits: int) -> Column:
    return F.expr(_walked(a, b, edits))


def _walked(a: str, b: str, edits: int) -> str:
    """The edit distance of two binary columns if it is at most edits, else something larger.

    Lengths must be at least edits, and differ by edits at most. The columns of
    the distance matrix are walked with a window of 2 * edits + 1 rows around
    the diagonal, whose vertical differences are two words of bits: bit k of
    column j is row j - edits + k. The score follows the window's last row down
    to the last row of the matrix, and that row from there on.
    """
    t, w = edits, 2 * edits + 1
    ones, top = (1 << w) - 1, w - 1
    # places that match; a place outside of the line is null, and matches nothing
    match = " + ".join(f"if(get(p, j - {t} + {k} - 1) <=> get(q, j - 1), {1 << k}L, 0L)" for k in range(w))
    diagonal = f"(((((x & v.vp) + v.vp) ^ v.vp) | x | v.vn) & {ones}L)"
    plus, minus = f"((v.vn | ~(d | v.vp)) & {ones}L)", "(d & v.vp)"
    bit = lambda x, k: f"cast(shiftright({x}, {k}) & 1L as int)"
    score = f"v.s + if(j <= m - {t}, 1 - {bit('d', top)}, {bit(plus, f'm - j + {t}')} - {bit(minus, f'm - j + {t}')})"
    step = f"named_struct('vp', ({minus} | ~(shiftright(d, 1) | {plus})) & {ones}L, 'vn', shiftright(d, 1) & {plus}, 's', {score})"
    bound = f"transform(array({match}), x -> transform(array({diagonal}), d -> {step})[0])[0]"
    walk = f"aggregate(sequence(1, n), named_struct('vp', {ones - (1 << t) + 1}L, 'vn', 0L, 's', {t}), (v, j) -> {bound}, v -> v.s)"
    chars = lambda c: f"split(decode({c}, 'ISO-8859-1'), '')"
    return f"transform(array(struct({chars(a)} as p, {chars(b)} as q, octet_length({a}) as m, octet_length({b}) as n)), z -> {_inside(walk)})[0]"


def _inside(expression: str) -> str:
    """p, q, m and n as fields of z."""
    return re.sub(r"(?<![\w.'])([pqmn])(?![\w('])", r"z.\1", expression)


def _alike(edits: int) -> Column:
    """Whether all pieces of line a, but one for each edit, stand in line b, at most as many places from their own as edits."""
    n = F.octet_length("a")

    def seen(k: Column) -> Column:
        begin, end = F.floor(n * k / PIECES).cast("int"), F.floor(n * (k + 1) / PIECES).cast("int")
        piece = F.substring("a", begin + 1, end - begin)
        return reduce(lambda x, y: x | y, [(begin + off >= 0) & (F.substring("b", begin + off + 1, end - begin) == piece) for off in range(-edits, edits + 1)])

    return F.size(F.filter(F.array(*[F.lit(k) for k in range(PIECES)]), seen)) >= PIECES - edits


def pairs(docs: DataFrame, first: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(a1, a2, b1, b2): pairs of different lines within edits edits, by their hashes. first: h1, h2 and the first place of each distinct line."""

    def texts(hashes: DataFrame) -> DataFrame:
        """h1, h2, line of the lines with some h1, each picked from the document that has it first."""
        wanted = checkpoint(first.join(hashes, "h1").select("h1", "h2", *[F.col(f"first.{c}").alias(c) for c in (*DOC, "_fx_pos")]))
        near = F.broadcast if wanted.count() <= FEW else lambda x: x
        some = _identified(docs, "doc_id", "text").join(near(wanted.select(*DOC).distinct()), DOC, "left_semi").select("doc_id", "text")
        return line_rows(some).join(near(wanted), ["h1", "h2", *DOC, "_fx_pos"]).groupBy("h1", "h2").agg(F.first("line").alias("line"))

    found = checkpoint(candidates(line_rows(docs).where(F.octet_length("line") >= min_bytes), edits, texts))
    line = checkpoint(texts(found.select(F.col("a1").alias("h1")).unionByName(found.select(F.col("b1").alias("h1"))).distinct()).withColumn("line", F.col("line").cast("binary")))
    left = line.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a"))
    right = line.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b"))
    # one key may hold many candidates that no other task shares: they are dealt out before they are verified
    both = found.join(left, "a1").join(right, "b1").where((F.abs(F.octet_length("a") - F.octet_length("b")) <= edits) & (F.col("a") != F.col("b"))).repartition("a1", "b1")
    both = both.where(_alike(edits))
    return both.where(_distance(edits) <= edits).select("a1", "a2", "b1", "b2")


def _distance(edits: int) -> Column:
    """The distance of lines a and b, of what their common beginning and end leave; at least edits bytes stay.

    Each step is bound by the array of one element, so that it is taken once.
    """
    steps = ", ".join(str(1 << k) for k in range(30, -1, -1))
    room = f"(least(octet_length(a), octet_length(b)) - {edits})"
    begin = f"aggregate(array({steps}), 0, (v, s) -> if(v + s <= {room} and substring(a, v + 1, s) = substring(b, v + 1, s), v + s, v))"
    end = f"aggregate(array({steps}), 0, (v, s) -> if(v + s <= {room} - u and substring(a, octet_length(a) - v - s + 1, s) = substring(b, octet_length(b) - v - s + 1, s), v + s, v))"
    middle = "named_struct('a', substring(a, u + 1, octet_length(a) - u - w), 'b', substring(b, u + 1, octet_length(b) - u - w))"
    return F.expr(f"transform(array({begin}), u -> transform(array({end}), w -> transform(array({middle}), y -> {_walked('y.a', 'y.b', edits)})[0])[0])[0]")


def removals(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """_fx_key, _fx_key2, _fx_rank, _fx_pos, and first, the place of the earliest line within reach, of each removed line."""
    place = F.struct("_fx_rank", *DOC, "_fx_pos")
    places = stored(line_rows(docs).drop("line"), "lines", "lz4_raw")
    first = stored(places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "first", "lz4_raw")
    found = checkpoint(pairs(docs, first, edits, min_bytes))
    both = found.unionByName(found.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    near = both.join(first.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("f")), ["b1", "b2"]).groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.min("f").alias("f"))
    best = checkpoint(first.join(near, ["h1", "h2"], "left").where("n > 1 or f is not null").select("h1", "h2", "n", F.least("first", F.coalesce("f", "first")).alias("first")))
    return join_counted(places, best, ["h1", "h2"]).where(place > F.col("first")).select(*DOC, "_fx_rank", "_fx_pos", "first")


def deduplicated(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs with the removed lines taken out of its text."""
    names = docs.columns
    gone = removals(docs, edits, min_bytes).groupBy(*DOC).agg(F.collect_set("_fx_pos").alias("_fx_gone"))
    keyed = _identified(docs, "*").join(gone, DOC, "left")
    # the array of one struct binds the lines, so that they are split once and not for each of them
    kept = F.expr(r"transform(array(struct(split(text, '\n', -1) as x, _fx_gone as g)), z -> array_join(transform(array_except(sequence(0, size(z.x) - 1), z.g), i -> z.x[i]), '\n'))[0]")
    return keyed.withColumn("text", F.when(F.col("_fx_gone").isNull(), F.col("text")).otherwise(kept)).select(*names)


def op_query(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers from 0), first_doc_ids (documents of the earlier lines)."""
    gone = removals(docs).groupBy(*DOC).agg(
        F.array_join(F.array_sort(F.collect_set("_fx_pos")), ",").alias("removed"),
        F.countDistinct("_fx_pos").alias("n_removed"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("first._fx_rank", F.lit(LAST)))), ",").alias("first_doc_ids"),
    )
    n_lines = F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    rows = _identified(docs, "doc_id", n_lines.cast("long").alias("n_lines"))
    return rows.join(gone, DOC, "left").select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"), F.coalesce("first_doc_ids", F.lit("")).alias("first_doc_ids"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents
), long AS (
  SELECT * FROM lines WHERE line <> ''
), firsts AS (
  SELECT line, strlen(line) AS n, min({{'d': doc_id, 'p': pos}}) AS f FROM long GROUP BY line
), sizes AS (
  SELECT *, n + d AS m FROM firsts, (VALUES (-2), (-1), (0), (1), (2)) AS v(d)
), near AS (
  SELECT a.line, min(b.f) AS f FROM sizes a JOIN firsts b ON a.m = b.n WHERE b.f <= a.f AND (a.line = b.line OR a.n >= {MIN_BYTES} AND b.n >= {MIN_BYTES} AND levenshtein(a.line, b.line) <= {EDITS}) GROUP BY a.line
), gone AS (
  SELECT doc_id, pos, near.f.d AS first_doc FROM (SELECT l.doc_id, l.pos, n.f AS f FROM long l JOIN near n USING (line)) near WHERE {{'d': doc_id, 'p': pos}} > near.f
)
SELECT d.doc_id, (length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), chr(10), '')) + 1)::BIGINT AS n_lines,
  count(g.pos)::BIGINT AS n_removed, coalesce(string_agg(g.pos::VARCHAR, ',' ORDER BY g.pos), '') AS removed,
  coalesce(array_to_string(list_sort(list_distinct(list(g.first_doc) FILTER (g.pos IS NOT NULL))), ','), '') AS first_doc_ids
FROM documents d LEFT JOIN gone g USING (doc_id) GROUP BY d.doc_id, d.text
"""
