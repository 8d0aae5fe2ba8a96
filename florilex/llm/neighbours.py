"""Approximate nearest neighbours by additive quantisation.

A vector is a sum of codewords, one of each of several codebooks that all have
its full width, plus a remainder. The codebooks are fitted, each to what those
before it leave over, on a bounded sample of SAMPLE vectors; every vector is
encoded by a beam search, and stored with its codes, its squared norm and the
length of its remainder. A search takes its queries in blocks of bounded size.
For each block the inner products with all codewords make a table; a first
pass over the codes adds up table entries for all vectors and finds for each
query the score of its SHORTLIST-th best; a second pass computes exact
distances, in double precision, of all vectors that score no worse (ties
included, so their number has no cap) where these lie, and each task hands on
the nearest k of a query only. A third pass checks the answer: it takes
everything that the bound by the remainder's length doesn't exclude, and that
an inner product in double precision doesn't either, so that the result is
that of brute force whatever the vectors look like. exact=False leaves it out.

Codes are those of vectors moved to the mean of the sample and scaled by a
power of two, so that neither an origin far away nor great lengths cost
precision; distances are taken of the vectors as they are.

Equal vectors are one entry, with the k + 1 smallest ids that it has: no
search can return more of them. So a vector that a third of all rows share
costs no more than any other.

Edge cases: rows without an id take no part, nor do vectors that are null,
empty, all zeros, or hold null, NaN or infinite components. Shorter vectors
count as filled up with zeros. Repeated rows count once; if an id has several
vectors, its distance is the least one. Ties go to the smaller id. With fewer
than k candidates all are returned; without queries or rows nothing is. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import sampled
from .common import bounded_batches, stored

#: Codebooks, codewords in each, and partial encodings that are kept from one codebook to the next.
BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors that codebooks are fitted on, rounds of k-means, distinct vectors of a query that are ranked again, queries in a block.
SAMPLE, ROUNDS, SHORTLIST, BLOCK = 16_384, 8, 512, 2048
#: Entries of the index in a task at least (there are as many tasks as cores, if that makes more), and at once.
TASK, CHUNK = 1 << 20, 2048

FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, vector of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col(id_).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).alias("vector"))


def matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _means(rows: np.ndarray, words: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres of k-means, and what rows leave over; centres that lose their rows stay where they are."""
    centres = rows[rng.choice(len(rows), words, replace=len(rows) < words)].copy()
    for k in range(rounds + 1):
        near = ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)
        if k < rounds:
            order = np.argsort(near, kind="stable")
            own, first, n = np.unique(near[order], return_index=True, return_counts=True)
            centres[own] = np.add.reduceat(rows[order], first) / n[:, None]
    return centres, rows - centres[near]


class Codebooks(NamedTuple):
    """Codebooks (books x words x width) of vectors times factor, less centre."""

    words: np.ndarray
    centre: np.ndarray
    factor: float

    def placed(self, x: np.ndarray) -> np.ndarray:
        return x * self.factor - self.centre

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """What codes stand for, in double precision."""
        return sum(book[c] for book, c in zip(self.words.astype(float), codes.T, strict=True))


def fit(rows: DataFrame, width: int, total: int, books: int = BOOKS, words: int = WORDS, sample: int = SAMPLE, seed: int = 1) -> Codebooks:
    """Codebooks, fitted on the distinct ones of the sample vectors, of total ones, whose ids have the least hashes: a bounded number."""
    rng = np.random.default_rng(seed)
    chosen = sampled(rows, F.struct("vec_id", "vector"), sample, total).select("vector").toArrow()
    x = np.unique(matrix(pa.concat_arrays(chosen.column("vector").chunks), width), axis=0) if len(chosen) else np.zeros((1, width))
    factor = 2.0 ** -np.clip(np.frexp(np.abs(x).max())[1], -1000, 1000)
    centre = (x * factor).mean(0)
    left, out = (x * factor - centre).astype(np.float32), []
    for _ in range(books):
        centres, left = _means(left, words, ROUNDS, rng)
        out.append(centres)
    return Codebooks(np.stack(out), centre, float(factor))


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one of each book) of the vectors x and what they leave over: of the sums that the beam search reaches, the nearest."""
    n, width = x.shape
    left, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8 if books.shape[1] <= 256 else np.uint32)
    for book in books:
        cost = (left * left).sum(2)[:, :, None] + (book * book).sum(1) - 2 * (left.reshape(-1, width) @ book.T).reshape(n, left.shape[1], -1)
        cost = cost.reshape(n, -1)
        best = np.argpartition(cost, min(beam, cost.shape[1]) - 1, axis=1)[:, :beam]
        before, word = best // len(book), best % len(book)
        left = np.take_along_axis(left, before[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, before[:, :, None], 1), word[:, :, None].astype(codes.dtype)], axis=2)
    best = (left * left).sum(2).argmin(1)
    return codes[np.arange(n), best], left[np.arange(n), best]


def index(rows: DataFrame, books: Codebooks, k: int = 10) -> DataFrame:
    """ids (the k + 1 smallest), vector, codes, norm (squared, of the vector as placed), rest (length of the remainder) of each distinct vector, stored."""
    spark, width = rows.sparkSession, books.words.shape[2]
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    kind = distinct.schema["vector"].dataType.simpleString()

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                x = books.placed(matrix(part.column("vector"), width))
                codes, _ = encode(x.astype(np.float32), books.words)
                rest = np.sqrt(((x - books.sums(codes)) ** 2).sum(1))
                columns = [part.column("ids"), part.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((x * x).sum(1)), pa.array(rest)]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "vector", "codes", "norm", "rest"])

    out = stored(distinct.select("ids", "vector").mapInArrow(work, f"ids array<long>, vector {kind}, codes binary, norm double, rest double"), "vectors")
    return out.coalesce(max(spark.sparkContext.defaultParallelism, -(-out.count() // TASK)))


def _scored(batches, books: Codebooks, queries: np.ndarray):
    """(slice of a batch, its codes, its scores): rows of squared distances, without the query's own norm, to all queries (as placed) by lookups in the table of inner products."""
    count, words, width = books.words.shape
    table = (books.words.reshape(-1, width) @ queries.T.astype(np.float32)).reshape(count, words, len(queries)) * np.float32(-2)
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            part = b.slice(at, CHUNK)
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8 if words <= 256 else np.uint32).reshape(part.num_rows, count)
            scores = np.repeat(part.column("norm").to_numpy().astype(np.float32)[:, None], len(queries), axis=1)
            for entry, code in zip(table, codes.T, strict=True):
                scores += entry[code]
            yield part, codes, scores


def _limits(entries: DataFrame, books: Codebooks, queries: np.ndarray, most: int) -> np.ndarray:
    """For each query the most-th smallest score over all entries; infinity where there are fewer."""

    def work(batches):
        best = np.zeros((len(queries), 0), np.float32)
        for _, _, scores in _scored(batches, books, books.placed(queries)):
            best = np.concatenate([best, scores.T], axis=1)
            if best.shape[1] > most:
                best = np.partition(best, most - 1, axis=1)[:, :most]
        for at in range(0, len(queries), 256):
            part = best[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(list(part), pa.list_(pa.float32()))], ["at", "scores"])

    parts = entries.mapInArrow(work, "at int, scores array<float>").withColumn("part", F.spark_partition_id() % 64)
    least = F.slice(F.array_sort(F.flatten(F.collect_list("scores"))), 1, most).alias("scores")
    out = np.full(len(queries), np.inf)
    for x in parts.groupBy("at", "part").agg(least).groupBy("at").agg(least).where(F.size("scores") == most).select("at", F.element_at("scores", -1).alias("limit")).collect():
        out[x["at"]] = x["limit"]
    return out


def _nearest(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, id, distance) arrays the k nearest of each query, an id once."""
    at, ids, far = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((far, ids, at))
    at, ids, far = at[order], ids[order], far[order]
    first = np.r_[True, (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])][: len(at)]
    at, ids, far = at[first], ids[first], far[first]
    order = np.lexsort((ids, far, at))
    at, ids, far = at[order], ids[order], far[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return [(at[keep], ids[keep], far[keep])]


def _open(part: pa.RecordBatch, codes: np.ndarray, scores: np.ndarray, books: Codebooks, own: np.ndarray, placed: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which pairs of a slice's entries and the queries (placed, of squared lengths own) may lie no farther apart than reach, by bounds that allow for all rounding."""
    width, reach, sums = books.words.shape[2], reach * (1 + 1e-9), books.sums(codes)
    norms, rests, hats = part.column("norm").to_numpy(), part.column("rest").to_numpy(), (sums * sums).sum(1)
    single, double = 1e-7 * (width + len(books.words) + 8), 1e-15 * (width + 8)  # rounding of scores, and of inner products
    longest = 2 * np.sqrt(own) * np.sqrt((books.words.astype(float) ** 2).sum(2)).max(1).sum()
    out = np.zeros(scores.shape, bool)
    for at in range(0, len(scores), CHUNK // 4):
        rows = slice(at, at + CHUNK // 4)
        norm = norms[rows, None]
        square = own + (hats[rows, None] - norm) + scores[rows] - single * (norm + longest) - 1e-40
        out[rows] = ~(np.sqrt(np.maximum(square, 0)) - rests[rows, None] > reach)
        some = at + np.flatnonzero(out[rows].any(1))
        if len(some):
            x, norm = books.placed(matrix(part.column("vector").take(pa.array(some)), width)), norms[some, None]
            out[some] &= ~((norm + own) * (1 - double) - 2 * (x @ placed.T) > reach * reach)
    return out


def _ranked(entries: DataFrame, books: Codebooks, names: np.ndarray, queries: np.ndarray, k: int, limits: np.ndarray, reach: np.ndarray | None = None) -> DataFrame:
    """query_id, vec_id, score: exact distances of entries whose scores are within limits; or, with reach, of those that may lie no farther than reach."""
    width = books.words.shape[2]
    placed = books.placed(queries)
    own = (placed * placed).sum(1)

    def work(batches):
        found: list = []
        for part, codes, scores in _scored(batches, books, placed):
            near = scores <= limits if reach is None else _open(part, codes, scores, books, own, placed, reach * books.factor)
            rows, at = np.nonzero(near)
            if not len(rows):
                continue
            ids, x = part.column("ids"), matrix(part.column("vector"), width)
            sizes, flat = ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy()
            begin = np.concatenate([[0], np.cumsum(sizes)])
            for step in range(0, len(rows), 1 << 16):
                r, q = rows[step : step + (1 << 16)], at[step : step + (1 << 16)]
                total = np.zeros(len(r))
                for c in range(width):  # one component after another, so that sums have one order
                    total += (x[r, c] - queries[q, c]) ** 2
                n = sizes[r]
                which = np.repeat(np.arange(len(r)), n)
                mine = flat[np.repeat(begin[r], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
                other = mine != names[q[which]]
                found = _nearest([*found, (q[which][other], mine[other], np.sqrt(total)[which][other])], k)
        for at, ids, far in found:
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(ids), pa.array(far)], ["query_id", "vec_id", "score"])

    return entries.mapInArrow(work, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(entries: DataFrame, books: Codebooks, queries: DataFrame, k: int = 10, shortlist: int = SHORTLIST, block: int = BLOCK, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest entries found for each of queries (vec_id, vector); entries and books are those of `index` and `fit`."""
    spark, out = queries.sparkSession, None
    held = queries.dropDuplicates(["vec_id", "vector"])
    parts = max(1, -(-queries.count() // block))
    held = stored(held.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int")).repartitionByRange("block"), "queries")
    for number in range(parts):
        mine = held.where(F.col("block") == number).orderBy("vec_id", "vector").select("vec_id", "vector").toArrow()
        if not len(mine):
            continue
        names, x = mine.column("vec_id").to_numpy(), matrix(pa.concat_arrays(mine.column("vector").chunks), books.words.shape[2])
        limits = _limits(entries, books, x, shortlist + 1)  # the query may be among them
        found = _best(_ranked(entries, books, names, x, k, limits), k)
        if exact:
            found = stored(found, "nearest")
            reach = {v["query_id"]: v["score"] for v in found.where(F.col("rank") == k).select("query_id", "score").collect()}
            rest = _ranked(entries, books, names, x, k, limits, np.array([reach.get(n, np.inf) for n in names]))
            found = _best(found.drop("rank").unionByName(rest), k)
        found = stored(found, "nearest")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def neighbours(rows: DataFrame, asked: Column, k: int = 10, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row (vec_id, vector; see `usable`) for which asked holds, among all rows but its own."""
    bounded_batches(rows.sparkSession)
    width, total = rows.agg(F.max(F.size("vector")), F.count("*")).first()
    books = fit(rows, width or 1, total)
    return search(index(rows, books, k), books, rows.where(asked), k, **options)


def op_query(embeddings: DataFrame) -> DataFrame:
    return neighbours(usable(embeddings), F.col("vec_id") % 100 == 0)


#: Brute force.
ORACLE = """WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, min(list_distance(q.x, c.x)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL),
 r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM s)
 SELECT * FROM r WHERE rank <= 10"""
