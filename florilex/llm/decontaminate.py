"""Benchmark decontamination by SimHash of item-sized windows.

A document is contaminated by an item if some window of it, as long in words as
the item, has a weighted-shingle similarity of at least SIMILAR to it:
sum of minima over sum of maxima of the counts of five-word shingles. Words are
what is left between ASCII punctuation and white space, A-Z lower-cased.

A similar window shares most of its shingles with the item, so windows are
drawn where enough of a document's shingles are known from items of some length at all. Their
fingerprints of BITS bits, sums of bits over the shingles of the window, come
from running sums. A multi-index finds all items of that length within RADIUS
bits: the bits are cut into so many blocks that one of them differs in at most
NEAR bits; each block has a table of the items by its value, in which the window's value
and all its neighbours within NEAR bits are looked up. Exact similarity then
decides. RADIUS lies three deviations above the bits in which two fingerprints
differ on average at similarity SIMILAR, by the binomial law (99.87 % of single windows), which gives blocks of
14 or 15 bits. A block's neighbourhood holds one in 200 of its values, so the blocks together pass about one item in six.

The benchmark is the stated query set. Its size is checked: what exceeds
MOST_BYTES is taken in blocks, one pass over the documents each, and the driver
holds one at a time. Documents are judged row by row, so nothing of them is shuffled.

Edge cases: a null or empty text has no hit; a document shorter than an item is
one window; an item under five words is one shingle; null and wordless items
are ignored; equal items are reported each, with ties the first place. Null
doc_id and repeated rows are kept and reported each. Very long texts are
searched in pieces that overlap by the longest item. Empty tables give no hits. `clean` keeps all columns whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, in_steps, stored
from .simhash import spread

SHINGLE, SIMILAR, BITS, NEAR = 5, 0.8, 512, 2
#: The share of bits in which fingerprints of sets of that similarity differ, and how many that are at most, but for one in 700.
SHARE = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
RADIUS = math.ceil(BITS * SHARE + 3 * math.sqrt(BITS * SHARE * (1 - SHARE)))
MOST_BYTES = 16 << 20
#: Bytes of text that are searched at once, and windows whose neighbourhoods are looked up at once.
PIECE, WINDOWS = 1 << 20, 256
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


class Hasher:
    """Shingle hashes of word sequences; word hashes are remembered, up to a bound."""

    def __init__(self, limit: int = 100_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def shingles(self, seq: list[bytes]) -> np.ndarray:
        if not seq:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in set(seq).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, seq), np.uint64, len(seq))
        n = min(SHINGLE, len(seq))
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = out * STEP + h[k : len(h) - n + 1 + k]
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(27))


def bit_rows(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(spread(h, BITS // 64).astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1)


def prints(sums: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints, as rows of bits, from how many of n shingles have each bit."""
    return (2 * sums > n).astype(np.uint8)


class SizeClass:
    """The items of one length, and the multi-index over their fingerprints."""

    def __init__(self, size: int, numbers: list[int], shingles: list[np.ndarray]):
        self.size, self.numbers = size, np.array(numbers)
        self.counts = [Counter(s.tolist()) for s in shingles]
        self.prints = np.concatenate([prints(bit_rows(s).sum(axis=0, dtype=np.int64)[None], len(s)) for s in shingles])
        parts = RADIUS // (NEAR + 1) + 1
        cut = [BITS * k // parts for k in range(parts + 1)]
        self.blocks = []
        for a, b in zip(cut, cut[1:], strict=False):
            value = self.block(self.prints, a, b)
            order = np.argsort(value, kind="stable")
            taken = np.zeros(1 << (b - a), bool)
            taken[value] = True
            self.blocks.append((a, b, order, value[order], np.packbits(taken), neighbours(b - a)))

    @staticmethod
    def block(x: np.ndarray, a: int, b: int) -> np.ndarray:
        return x[:, a:b].astype(np.int64) @ (1 << np.arange(b - a - 1, -1, -1))

    def met(self, x: np.ndarray) -> np.ndarray:
        """(window, item) pairs, as window * items + item, that have a block within NEAR bits."""
        found = []
        for a, b, order, values, taken, masks in self.blocks:
            value = (self.block(x, a, b)[:, None] ^ masks).ravel()
            hit = np.flatnonzero(taken[value >> 3] >> (7 - (value & 7)) & 1)
            lo = np.searchsorted(values, value[hit])
            n = np.searchsorted(values, value[hit], side="right") - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.repeat(hit // len(masks), n) * len(self.numbers) + order[at])
        return np.unique(np.concatenate(found))

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within RADIUS bits, by the multi-index."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(x), WINDOWS):
            part = x[k : k + WINDOWS]
            w, i = np.divmod(self.met(part), len(self.numbers))
            ok = (part[w] != self.prints[i]).sum(axis=1) <= RADIUS
            left.append(w[ok] + k)
            right.append(i[ok])
        return np.concatenate(left), np.concatenate(right)


def neighbours(width: int) -> np.ndarray:
    """What a block's value is XORed with to give all values within NEAR bits."""
    return np.array([sum(1 << k for k in bits) for n in range(NEAR + 1) for bits in combinations(range(width), n)], np.int64)


class Finder:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.hasher = Hasher()
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for number, (_, text) in enumerate(items):
            seq = words(text)
            if seq:
                by_size.setdefault(len(seq), []).append((number, self.hasher.shingles(seq)))
        self.items = items
        self.classes = [SizeClass(n, [x for x, _ in g], [s for _, s in g]) for n, g in sorted(by_size.items())]
        pairs = sorted({(h, k) for k, c in enumerate(self.classes) for counts in c.counts for h in counts})
        self.known = np.array([h for h, _ in pairs], np.uint64)
        self.owner = np.array([k for _, k in pairs], np.int64)
        self.bits = max(16, int(len(pairs)).bit_length() + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.known >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.short = {c.size for c in self.classes if c.size < SHINGLE}

    def hits(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item number, similarity, first word, words) of the best window for each item."""
        best: dict[int, tuple[float, int, int]] = {}
        if not len(self.known):
            return []
        for base, seq in self.pieces(text):
            h = self.hasher.shingles(seq)
            if not len(h):
                continue
            own: dict[int, tuple[float, int, int]] = {}
            self.search(h, len(seq), SHINGLE, own)
            for n in self.short:  # items that are one short shingle: equal runs of words
                if n <= len(seq):
                    for c in (c for c in self.classes if c.size == n):
                        runs = {b" ".join(seq[k : k + n]): k for k in range(len(seq) - n, -1, -1)}
                        for number in c.numbers.tolist():
                            at = runs.get(b" ".join(words(self.items[number][1])))
                            if at is not None:
                                own[number] = (1.0, at, n)
            for number, (similar, at, n) in own.items():
                if similar > best.get(number, (0.0,))[0]:
                    best[number] = (similar, base + at, n)
        return [(k, *v) for k, v in best.items()]

    def pieces(self, text: str | None):
        """(place of its first word, words) of the pieces of a text, which overlap by all but one of the words of the longest item."""
        raw = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)
        base, kept, at = 0, [], 0
        longest = self.classes[-1].size if self.classes else 1
        while at < len(raw) or not at:
            end = raw.rfind(b" ", at + 1, at + PIECE) if len(raw) - at > PIECE else len(raw)
            end = end if end > at else len(raw)
            seq = kept + raw[at:end].split()
            yield base, seq
            kept = seq[max(0, len(seq) - longest + 1) :]
            base, at = base + len(seq) - len(kept), max(end, 1)

    def search(self, h: np.ndarray, total: int, gram: int, best: dict) -> None:
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        lo, hi = np.searchsorted(self.known, h[at], "left"), np.searchsorted(self.known, h[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        touched: dict[int, list[int]] = {}
        for j, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for k in self.owner[a:b].tolist():
                touched.setdefault(k, []).append(j)
        for k, places in touched.items():
            c = self.classes[k]
            n = min(c.size, total) - gram + 1  # shingles of a window
            if c.size < SHINGLE or n < 1:
                continue
            # windows with so many known shingles that they may be similar
            need = math.ceil(SIMILAR * (n + c.size - gram + 1) / (1 + SIMILAR) - 1e-9)
            j = np.array(places)
            if len(j) < need:
                continue
            known = np.concatenate(([0], np.cumsum(np.bincount(j, minlength=len(h)))))
            starts = np.flatnonzero(known[n:] - known[:-n] >= need)
            for part in (x[q : q + WINDOWS] for x in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1) for q in range(0, len(x), WINDOWS)):
                base = int(part[0])
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bit_rows(h[base : int(part[-1]) + n]), axis=0, dtype=np.int32)])
                w, i = c.near(prints(sums[part - base + n] - sums[part - base], n))
                for s, item in zip(part[w].tolist(), i.tolist(), strict=True):
                    x, y = Counter(h[s : s + n].tolist()), c.counts[item]
                    both = sum((x & y).values())
                    similar = both / (n + y.total() - both)
                    number = int(c.numbers[item])
                    if similar >= SIMILAR and similar > best.get(number, (0.0,))[0]:
                        best[number] = (similar, s, n + gram - 1)


def item_blocks(benchmark: DataFrame, most: int = MOST_BYTES):
    """The items in blocks of about the size that a task may hold, fetched one at a time; one block unless the benchmark is larger than that."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-total // most))
    for k in range(parts):
        yield k + 1 == parts, [(x.item_id, x.text) for x in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: each item's best window in each document that has one."""
    out = None
    for last, items in item_blocks(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches, shared=shared):
            finder = Finder(shared.value)
            for b in in_steps(batches, "text"):
                rows = [(d, finder.items[n][0], s, at, w) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, s, at, w in finder.hits(t)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, item_id long, similarity double, first_word int, n_words int")
        if not last:
            found = checkpoint(found)
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    for last, items in item_blocks(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches, shared=shared):
            finder = Finder(shared.value)
            for b in in_steps(batches, "text"):
                yield b.filter(pa.array([not finder.hits(t) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
        if not last:
            docs = stored(docs, "uncontaminated")
            shared.unpersist()
    return docs


def op_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
