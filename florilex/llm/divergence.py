"""How the words of each source differ from those of every other source of its language, and from those of the language.

Terms are counted for each (lang, source) where the texts lie, then summed by a
shuffle over chunks of each language's vocabulary; a language keeps the terms
in at least LEAST of its documents. For the pairs, counts are packed by blocks
of SIDE groups and chunks of at most WIDTH terms, and each pack is sent to the
tiles of its block: one for each pair of blocks and each of SLICES parts of the
vocabulary. A tile takes its chunks one after another, in order, and adds the
divergences of all its pairs up in a matrix; a term that none of its groups
has adds the same amount each time, so such terms are counted only. Sums over
the slices are the results. All arithmetic is that of whole numbers.

Edge cases: null lang, source and text count as ''. Repeated rows are documents
of their own. A group without terms is compared as one with no occurrences; if
a language keeps no term all its pairs have the value 0 and it has no term
rows. A source that is alone in its language has no pairs. Very long texts are
counted in stretches. Ties go by the item's bytes. An empty table gives no
rows. Other columns, whatever their names, are ignored. Numbers are exact as
long as a group has fewer than 9 * 10^15 occurrences.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, in_steps, stored, text_bytes
from .terms import Words

LETTERS = Words(rb"a-z\x80-\xff")
LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Chunks of a vocabulary by hash, parts of it that tiles take, groups in a block, terms in a pack.
CHUNKS, SLICES, SIDE, WIDTH = 4096, 16, 64, 4096
#: Counts that a task holds before it hands them on; counts that a tile takes at once, from chunks that follow one another.
HELD, CELLS = 500_000, 1 << 16
MOST_TASKS = 20_000


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df: partial sums of occurrences and documents; each group also has rows without a term."""

    def work(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows():
            for (lang, source), (n, df) in groups.items():
                size = len(n) + 1
                columns = [pa.array([lang] * size), pa.array([source] * size), pa.array([*n, None], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*(df[t] for t in n), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])
            groups.clear()

        for b in in_steps(batches, "text"):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, df = groups.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for found in LETTERS.lists(text):
                    n.update(found)
                    seen.update(found)
                df.update(seen)
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from rows()
        yield from rows()

    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_bytes("text").alias("text"))
    return named.mapInArrow(work, "lang string, source string, term string, n long, df long")


def kept_terms(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, chunk, idx (of the term in its chunk, without gaps), source, term, n, lang_n of the terms in enough documents. One shuffle, by lang and chunk."""
    spread = parts.where("term is not null").withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(CHUNKS)).cast("int")).repartition("lang", "chunk")
    sums = spread.groupBy("lang", "chunk", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    same = Window.partitionBy("lang", "chunk", "term")
    kept = sums.withColumns({"lang_n": F.sum("n").over(same), "lang_df": F.sum("df").over(same)}).where(F.col("lang_df") >= least)
    place = F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    return kept.withColumn("idx", place).select("lang", "chunk", "idx", "source", "term", "n", "lang_n")


def share(n: str, total: str, v: str) -> Column:
    """p of a count: by a decimal product, as the scaled count may exceed a long."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(19, 0))) div CAST({total} + {v} AS DECIMAL(19, 0))")


def _shares(counts: np.ndarray, totals: np.ndarray, v: int) -> np.ndarray:
    """p of a matrix of counts, whose rows have totals: long division by thousands, so that nothing overflows."""
    each = (totals + v)[:, None]
    out, rest = (counts + 1) // each, (counts + 1) % each
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // each, rest % each
    return out + 1


class _Tile:
    """The divergences of all pairs of two blocks' groups, added up over packs of counts."""

    def __init__(self, v: int, terms: int):
        self.v, self.left, self.names, self.totals = v, terms, {}, {}

    def group(self, block: int, names: list[str], totals: list[int]) -> None:
        self.names[block], self.totals[block] = names, np.array(totals, np.int64)

    def begin(self, i: int, j: int) -> None:
        self.i, self.j = i, j
        self.ahead, self.back = np.zeros((len(self.names[i]), len(self.names[j])), np.int64), np.zeros((len(self.names[j]), len(self.names[i])), np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, times: int = 1) -> None:
        """Counts of the groups of both blocks for the same terms."""
        p, q = _shares(a, self.totals[self.i], self.v), _shares(b, self.totals[self.j], self.v)
        for k, row in enumerate(p):
            square = (row - q) ** 2
            self.ahead[k] += times * (square // q).sum(axis=1)
            if self.i != self.j:
                self.back[:, k] += times * (square // row).sum(axis=1)

    def pack(self, cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """cells: for each block that has any, the places of groups, the terms and the counts."""
        terms = np.unique(np.concatenate([x[1] for x in cells.values()]))
        self.left -= len(terms)
        for at in range(0, len(terms), 512):
            part, dense = terms[at : at + 512], []
            for block in (self.i, self.j):
                counts = np.zeros((len(self.names[block]), len(part)), np.int64)
                if block in cells:
                    place, term, n = cells[block]
                    own = (term >= part[0]) & (term <= part[-1])
                    counts[place[own], np.searchsorted(part, term[own])] = n[own]
                dense.append(counts)
            self.add(*dense)

    def rows(self, lang: str) -> pa.RecordBatch:
        if self.left:  # terms that none of these groups has
            self.add(*(np.zeros((len(self.names[block]), 1), np.int64) for block in (self.i, self.j)), times=self.left)
        a, b = self.names[self.i], self.names[self.j]
        found = [(s, o, int(self.ahead[x, y])) for x, s in enumerate(a) for y, o in enumerate(b) if s != o]
        if self.i != self.j:
            found += [(o, s, int(self.back[y, x])) for x, s in enumerate(a) for y, o in enumerate(b)]
        sources, items, values = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(sources, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], ["lang", "source", "item", "value"])


def _tiles(batches):
    """Rows of tiles, sorted, so that each tile's groups come before its packs: the tiles' divergences."""
    tile = at = chunk = None
    cells: dict[int, list] = {}

    def pack():
        tile.pack({block: tuple(np.concatenate(x) for x in zip(*own, strict=True)) for block, own in cells.items()})
        cells.clear()

    for b in batches:
        heads = {c: b.column(c).to_pylist() for c in b.schema.names if c != "cells"}
        for k, key in enumerate(zip(*(heads[c] for c in ("lang", "i", "j", "slice")), strict=True)):
            now = (heads["chunk"][k], heads["part"][k])
            if cells and (key != at or now != chunk and sum(len(x[2]) for own in cells.values() for x in own) >= CELLS):
                pack()
            if key != at:
                if tile is not None:
                    yield tile.rows(at[0])
                tile, at = _Tile(heads["v"][k], heads["terms"][k]), key
            chunk = now
            if chunk[0] < 0:
                tile.group(heads["block"][k], heads["names"][k], heads["totals"][k])
                if len(tile.names) == len({key[1], key[2]}):
                    tile.begin(key[1], key[2])
            else:
                place, idx, n = (b.column("cells")[k].values.field(c).to_numpy() for c in ("place", "idx", "n"))
                cells.setdefault(heads["block"][k], []).append((place, (chunk[0] << 32) + idx.astype(np.int64), n))
    if cells:
        pack()
    if tile is not None:
        yield tile.rows(at[0])


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank: for each source the divergence of its words from every other source of its language (part pair), and the top terms that set it apart from the language (part term)."""
    bounded_batches(docs.sparkSession)
    parts = stored(counted(docs), "counts")
    kept = stored(kept_terms(parts, least), "terms")
    slice_ = F.col("chunk") % SLICES
    sizes = kept.groupBy("lang", "chunk").agg((F.max("idx") + 1).alias("v")).groupBy("lang", slice_.alias("slice")).agg(F.sum("v").alias("terms"))
    vocabulary = sizes.groupBy("lang").agg(F.sum("terms").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = parts.where("term is null").select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["total", "v"])
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stored(groups.withColumn("at", at).select("lang", "source", "total", "v", F.expr(f"at div {side}").cast("int").alias("block"), (F.col("at") % side).alias("place")), "groups")

    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    none = {"names": F.lit(None).cast("array<string>"), "totals": F.lit(None).cast("array<long>")}
    empty = F.lit(None).cast("array<struct<place:int,idx:int,n:long>>")
    members = F.array_sort(F.collect_list(F.struct("place", "source", "total")))
    heads = groups.groupBy("lang", "block", "v").agg(members.alias("m")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).join(sizes, ["lang", "slice"], "left").fillna(0, ["terms"])
    heads = heads.select("lang", "slice", F.lit(-1).alias("chunk"), F.lit(0).alias("part"), "block", "v", "terms", F.col("m.source").alias("names"), F.col("m.total").alias("totals"), empty.alias("cells"))
    placed = kept.join(groups.select("lang", "source", "block", "place"), ["lang", "source"])
    packs = placed.groupBy("lang", "chunk", F.expr(f"idx div {width}").cast("int").alias("part"), "block").agg(F.collect_list(F.struct("place", "idx", "n")).alias("cells"))
    packs = packs.select("lang", slice_.alias("slice"), "chunk", "part", "block", F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("terms"), none["names"].alias("names"), none["totals"].alias("totals"), "cells")
    sent = heads.unionByName(packs).join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    key = ["lang", "i", "j", "slice"]
    tiles = groups.groupBy("lang").agg((F.max("block") + 1).alias("b")).agg(F.sum(F.expr(f"b * (b + 1) div 2 * {SLICES}"))).first()[0]
    pairs = sent.repartition(min(tiles or 1, MOST_TASKS), *key).sortWithinPartitions(*key, "chunk", "part", "block").mapInArrow(_tiles, "lang string, source string, item string, value long")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    pair = ranked(pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))).withColumn("part", F.lit("pair"))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shares = kept.join(groups.select("lang", "source", "total", "v"), ["lang", "source"]).join(whole, "lang").withColumns({"p": share("n", "total", "v"), "q": share("lang_n", "lang_total", "v")})
    apart = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    term = ranked(apart).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")


def op_query(docs: DataFrame) -> DataFrame:
    return audit(docs)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
 t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST}),
 c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
 g AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) USING (lang)),
 l AS (SELECT lang, sum(total) AS total FROM g GROUP BY lang),
 f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p, 1 + {SCALE}::HUGEINT * (k.lang_n + 1) // (l.total + g.v) AS q FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
   UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM f WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM u)
 SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
