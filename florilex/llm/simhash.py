"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are majority votes over the 64-bit hashes of a text's word
shingles. Two texts are linked if one of their fingerprint words differs in at
most ``radius`` bits (and, for fingerprints of several words, the whole
fingerprint in at most ``most`` bits). The self-join walks a binary trie of the
fingerprints, pairing nodes and adding up differing bits, and drops a pair of
nodes as soon as its bits exceed the budget.

Distribution: a pair within the budget agrees on at least one of radius + 1
blocks of bits, so each word is kept in radius + 1 rotated tries, whose top
levels (one block, no errors left to spend there) are the shuffle key. Crowded
keys are divided further in the same way, as long as they are crowded. A task emits a spanning forest of
the links that it finds, never all pairs of a group.

Edge cases: a null text counts as empty; texts without words have fingerprint
zero and are linked like any other; texts with fewer words than a shingle hash
as one whole sequence. A null doc_id keeps its row and takes the least doc_id
of its component, null if there is none. Repeated rows share a component. Very
long texts are handled one at a time, their shingles 255 at a time. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, in_steps, join_counted
from .components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Keys with more entries are divided by a second block.
CROWDED = 50_000
#: Complete keys are joined in chunks of about so many entries.
CHUNK = 30_000
#: Groups of more candidates than this under one key are decided in two passes.
SMALL = 2
#: Sets of up to so many shingles are also linked with those that have one fewer: fingerprints of few shingles say little.
FEW = 9
#: Nodes of a cluster that are compared with one another in one task; blocks that a cluster may have, beyond which its nodes are dealt out by their keys.
BLOCK, MOST_BLOCKS = 2048, 80


def shingles(text: bytes, size: int) -> list[bytes]:
    """The word shingles of a text, repeats included; words are split at ASCII white space, A-Z lower-cased."""
    words = text.translate(LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def spread(h: np.ndarray, words64: int) -> np.ndarray:
    """As many 64-bit words for each hash, the first of them the hash itself."""
    out = np.empty((len(h), words64), np.uint64)
    out[:, 0] = h
    for k in range(1, words64):
        x = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in set(shingles(text, size))), np.uint64))


def fingerprint(text: bytes, size: int, words64: int, distinct: bool) -> bytes:
    """Big-endian bytes; a bit is 1 if it is set in over half of the hashes."""
    found = shingles(text, size)
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in (set(found) if distinct else found)), np.uint64), words64)


def majority(h: np.ndarray, words64: int) -> bytes:
    if not len(h):
        return bytes(8 * words64)
    counts = np.zeros(64 * words64, np.int64)
    for at in range(0, len(h), 255):
        bits = np.unpackbits(spread(h[at : at + 255], words64).astype(">u8").view(np.uint8).reshape(-1, 8 * words64), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h)).tobytes()


def fingerprints(docs: DataFrame, size: int, words64: int, distinct: bool) -> DataFrame:
    """(doc_id, node, fp): node is a long that stands for the fingerprint (itself if it has 64 bits, else its hash)."""

    def work(batches):
        for b in in_steps(batches, "text"):
            fps = [fingerprint((t or "").encode("utf-8", "surrogatepass"), size, words64, distinct) for t in b.column(1).to_pylist()]
            nodes = [int.from_bytes(x, "big", signed=True) if words64 == 1 else xxhash.xxh64_intdigest(x) - 2**63 for x in fps]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(fps, pa.binary())], ["doc_id", "node", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, node long, fp binary")


def set_fingerprints(docs: DataFrame, size: int, words64: int) -> DataFrame:
    """(doc_id, node, fp, n, fewer): node is a long that stands for the shingle set, n the number of its shingles, fewer the nodes of the sets with one shingle less, of sets of up to FEW."""
    number = lambda h: xxhash.xxh64_intdigest(h.tobytes()) - 2**63

    def work(batches):
        for b in in_steps(batches, "text"):
            sets = [shingle_set((t or "").encode("utf-8", "surrogatepass"), size) for t in b.column(1).to_pylist()]
            fewer = [[number(np.delete(h, k)) for k in range(len(h))] if len(h) <= FEW else [] for h in sets]
            columns = [pa.array([number(h) for h in sets], pa.int64()), pa.array([majority(h, words64) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int32()), pa.array(fewer, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "node", "fp", "n", "fewer"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, node long, fp binary, n int, fewer array<long>")


def blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of some blocks of nearly equal width."""
    cuts = [bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def rotated(nodes: DataFrame, words64: int, bits: int, radius: int, carried: list[str] = [], check: int | None = None) -> DataFrame:  # noqa: B006
    """(key, rest, width, node, fp, and what is carried): one row for each word of a fingerprint and rotation; rest is the word without the block that is in the key.

    Words are whole bytes; what is left of the fingerprint makes no word. fp: its last check bytes, or all.
    """
    cut = blocks(bits, radius + 1)
    size, wide = bits // 8, 8 * words64

    def work(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            whole = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(n, wide)
            more = [pa.array([x.tobytes() for x in whole[:, -check:]], pa.binary()) if check else b.column("fp"), *(b.column(x) for x in carried)]
            for w in range(wide // size):
                word = np.zeros(n, np.uint64)
                for k in range(size):
                    word = word << np.uint64(8) | whole[:, w * size + k]
                for r, (low, width) in enumerate(cut):
                    block = word >> np.uint64(low) & np.uint64((1 << width) - 1)
                    rest = word >> np.uint64(low + width) << np.uint64(low) | word & np.uint64((1 << low) - 1)
                    key = block.astype(np.int64) | np.int64(w * (radius + 1) + r) << np.int64(48)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rest.view(np.int64)), pa.array(np.full(n, bits - width, np.int32)), b.column("node"), *more], ["key", "rest", "width", "node", "fp", *carried])

    more = "".join(f", {x.name} {x.dataType.simpleString()}" for x in nodes.select(*carried).schema)
    return nodes.select("node", "fp", *carried).mapInArrow(work, "key long, rest long, width int, node long, fp binary" + more)


def divided(rows: DataFrame, radius: int, carried: list[str] = []) -> DataFrame:  # noqa: B006
    """Divides keys with over CROWDED entries by further blocks, of which one must agree as well, until none is crowded or few bits are left; all else stays."""
    rows, parts = rows.withColumn("sub", F.lit(0).cast("long")), radius + 1
    while True:
        sizes = rows.groupBy("key", "sub").agg(F.count("*").alias("n"), F.max("width").alias("width"))
        crowded = checkpoint(sizes.where((F.col("n") > CROWDED) & (F.col("width") > parts)).select("key", "sub", F.lit(True).alias("crowded")))
        if crowded.isEmpty():
            return rows
        cuts = F.array(*[F.floor(F.col("width") * k / parts).cast("int") for k in range(parts + 1)])
        joined = rows.join(crowded, ["key", "sub"], "left").withColumn("cuts", cuts)
        split = joined.withColumn("part", F.explode(F.when(F.col("crowded") & (F.col("width") > parts), F.sequence(F.lit(0), F.lit(radius))).otherwise(F.array(F.lit(-1)))))
        low, high = F.element_at("cuts", F.col("part") + 1), F.element_at("cuts", F.col("part") + 2)
        block = F.expr("shiftrightunsigned(rest, element_at(cuts, part + 1)) & (shiftleft(1L, element_at(cuts, part + 2) - element_at(cuts, part + 1)) - 1)")
        rest = F.expr("shiftleft(shiftrightunsigned(rest, element_at(cuts, part + 2)), element_at(cuts, part + 1)) | (rest & (shiftleft(1L, element_at(cuts, part + 1)) - 1))")
        rows = split.select(
            "key", F.when(F.col("part") < 0, F.col("rest")).otherwise(rest).alias("rest"), F.when(F.col("part") < 0, F.col("width")).otherwise(F.col("width") - (high - low)).alias("width"), "node", "fp",
            F.when(F.col("part") < 0, F.col("sub")).otherwise(F.xxhash64("sub", "part", block)).alias("sub"), *carried,
        )


def trie_pairs(group: np.ndarray, value: np.ndarray, width: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries (sorted by group and value, which are distinct within it) whose values differ in at most radius bits.

    A frontier of node pairs descends level by level through the tries of all
    groups at once. A node is a range of entries; a pair of nodes carries the
    bits in which its paths differ. Pairs of single entries are decided at once.
    """
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    a0, a1 = edge[:-1], edge[1:]
    keep = a1 - a0 > 1
    a0, a1 = a0[keep].astype(np.int32), a1[keep].astype(np.int32)
    b0, b1, err, bit = a0, a1, np.zeros(len(a0), np.int8), width[a0].astype(np.int8)
    left, right = [], []
    while len(a0):
        bit = bit - np.int8(1)
        am, bm = _turn(value, a0, a1, bit), _turn(value, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        new = [
            (a0, am, b0, bm, err, bit),
            (am, a1, bm, b1, err, bit),
            (a0, am, bm, b1, err + np.int8(1), bit),
            (am[~same], a1[~same], b0[~same], bm[~same], err[~same] + np.int8(1), bit[~same]),
        ]
        a0, a1, b0, b1, err, bit = (np.concatenate(x) for x in zip(*new, strict=True))
        mirror = (a0 == b0) & (a1 == b1)
        live = (a1 > a0) & (b1 > b0) & (err <= radius) & ~(mirror & (a1 - a0 == 1))
        a0, a1, b0, b1, err, bit = (x[live] for x in (a0, a1, b0, b1, err, bit))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = np.bitwise_count(value[x] ^ value[y]) <= radius
            left.append(x[near])
            right.append(y[near])
            a0, a1, b0, b1, err, bit = (z[~leaf] for z in (a0, a1, b0, b1, err, bit))
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _turn(value: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The first entry of each range with a 1 in its bit; entries of a range agree on the bits above. Binary search, all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (value[np.minimum(mid, len(value) - 1)] >> np.maximum(bit, 0).astype(np.uint64) & np.uint64(1)).astype(bool)
        hi, lo = np.where(open_ & one, mid, hi), np.where(open_ & ~one, mid + np.int32(1), lo)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the least one that links (a, b) reach."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        if (lo == hi).all():
            return root
        np.minimum.at(root, hi, lo)
        while not (root == root[root]).all():
            root = root[root]


def reach(fps: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """A spanning forest of fingerprints (rows of 64-bit words) that differ in at most most bits in all: each one reached looks only at those not reached yet."""
    left, right, rest = [], [], np.arange(len(fps))
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        at = queue.pop()
        near = np.bitwise_count(fps[rest] ^ fps[at]).sum(axis=1, dtype=np.int64) <= most
        if near.any():
            new = rest[near].tolist()
            left += [at] * len(new)
            right += new
            queue += new
            rest = rest[~near]
    return left, right


def links(rows: DataFrame, words64: int, radius: int, most: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each key."""

    def join(t: pa.Table) -> pa.RecordBatch:
        node = t.column("node").to_numpy()
        group = np.stack([t.column("key").to_numpy(), t.column("sub").to_numpy()])
        value, width = t.column("rest").to_numpy().view(np.uint64), t.column("width").to_numpy()
        order = np.lexsort((value, group[1], group[0]))
        node, value, width, group = node[order], value[order], width[order], group[:, order]
        fresh = np.concatenate(([True], (group[:, 1:] != group[:, :-1]).any(axis=0)))
        at = np.cumsum(fresh)
        first = fresh | np.concatenate(([True], value[1:] != value[:-1]))
        leaf0 = np.flatnonzero(first)
        leaf1 = np.append(leaf0[1:], len(value))
        x, y = trie_pairs(at[leaf0], value[leaf0], width[leaf0], radius)
        if words64 == 1:  # equal words are one node, and no further check is needed
            root = forest(len(leaf0), x, y)
            child = np.flatnonzero(root != np.arange(len(root)))
            a, b = node[leaf0[child]], node[leaf0[root[child]]]
        else:
            fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, words64)[order]
            one = (leaf1 - leaf0)[x] * (leaf1 - leaf0)[y] == 1
            p, q = leaf0[x[one]], leaf0[y[one]]
            near = np.bitwise_count(fps[p] ^ fps[q]).sum(axis=1, dtype=np.int64) <= most if len(p) else np.zeros(0, bool)
            left, right = [p[near]], [q[near]]
            for i in np.flatnonzero(leaf1 - leaf0 > 1):
                u, v = reach(fps[leaf0[i] : leaf1[i]], most)
                left.append(leaf0[i] + np.array(u, np.int64))
                right.append(leaf0[i] + np.array(v, np.int64))
            for i, j in zip(x[~one].tolist(), y[~one].tolist(), strict=True):
                both = np.concatenate((np.arange(leaf0[i], leaf1[i]), np.arange(leaf0[j], leaf1[j])))
                u, v = reach(fps[both], most)
                left.append(both[np.array(u, np.int64)])
                right.append(both[np.array(v, np.int64)])
            root = forest(len(node), np.concatenate(left), np.concatenate(right))
            child = np.flatnonzero(root != np.arange(len(root)))
            a, b = node[child], node[root[child]]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return by_keys(rows, join, "a long, b long")


def by_keys(rows: DataFrame, join, schema: str) -> DataFrame:
    """join over chunks of complete keys."""

    def work(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < CHUNK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key, sub = t.column("key").to_numpy(), t.column("sub").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
            if not len(last):
                continue
            yield join(t.slice(0, last[-1] + 1))
            held = t.slice(last[-1] + 1).to_batches()
            size = sum(x.num_rows for x in held)
        if size:
            yield join(pa.Table.from_batches(held))

    return rows.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(work, schema)


def spanning(n: int, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of those of the edges (a, b) that make a shortest spanning forest of n items."""
    order = np.argsort(length, kind="stable")
    a, b, root = a[order], b[order], np.arange(n)
    taken, live = np.zeros(len(a), bool), np.arange(len(a))
    while len(live := live[root[a[live]] != root[b[live]]]):
        best = np.full(n, len(a))
        np.minimum.at(best, root[a[live]], live)
        np.minimum.at(best, root[b[live]], live)
        taken[best[best < len(a)]] = True
        root = forest(n, a[taken], b[taken])
    return order[taken]


def candidates(rows: DataFrame, words64: int, radius: int, most: int, similarity: float, second: bool = False) -> DataFrame:
    """(a, b, all): pairs of nodes within the budget whose set sizes allow the similarity. fp has words64 words, of which most bits may differ.

    Under one key, groups of up to SMALL nodes give all their pairs, larger
    ones a shortest spanning tree (all is false). The second pass gives every pair of
    nodes of different components (column comp); what is connected already needs no more links.
    """

    def join(t: pa.Table) -> pa.RecordBatch:
        node = t.column("node").to_numpy()
        group = np.stack([t.column("key").to_numpy(), t.column("sub").to_numpy()])
        value, width = t.column("rest").to_numpy().view(np.uint64), t.column("width").to_numpy()
        order = np.lexsort((value, group[1], group[0]))
        node, value, width, group, n = node[order], value[order], width[order], group[:, order], t.column("n").to_numpy()[order]
        comp = t.column("comp").to_numpy()[order] if second else None
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, words64)[order]
        fresh = np.concatenate(([True], (group[:, 1:] != group[:, :-1]).any(axis=0)))
        at = np.cumsum(fresh)
        leaf0 = np.flatnonzero(fresh | np.concatenate(([True], value[1:] != value[:-1])))
        count = np.diff(np.append(leaf0, len(value)))
        x, y = trie_pairs(at[leaf0], value[leaf0], width[leaf0], radius)
        twins = np.flatnonzero(count > 1)
        x, y = np.concatenate((x, twins)), np.concatenate((y, twins))
        left, right, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sizes, k = count[x] * count[y], 0
        while k < len(x):  # pairs of entries, a bounded number at a time
            end = max(k + 1, k + int(np.searchsorted(np.cumsum(sizes[k : k + 200_000]), 200_000, side="right")))
            i, j, m = x[k:end], y[k:end], sizes[k:end]
            nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wide = np.repeat(count[j], m)
            p, q = np.repeat(leaf0[i], m) + nth // wide, np.repeat(leaf0[j], m) + nth % wide
            ok = (np.repeat(i != j, m) | (p < q)) & (np.minimum(n[p], n[q]) >= similarity * np.maximum(n[p], n[q]) - 1e-9)
            if second:
                ok &= comp[p] != comp[q]
            p, q = p[ok], q[ok]
            d = np.bitwise_count(fps[p] ^ fps[q]).sum(axis=1, dtype=np.int64)
            left.append(p[d <= most])
            right.append(q[d <= most])
            far.append(d[d <= most])
            k = end
        p, q, d = np.concatenate(left), np.concatenate(right), np.concatenate(far)
        if second:
            whole = np.ones(len(p), bool)
        else:
            root = forest(len(node), p, q)
            whole = (np.bincount(root, minlength=len(node))[root] <= SMALL)[p]
            big = np.flatnonzero(~whole)
            keep = np.sort(np.concatenate((np.flatnonzero(whole), big[spanning(len(node), p[big], q[big], d[big])])))
            p, q, whole = p[keep], q[keep], whole[keep]
        a, b = np.minimum(node[p], node[q]), np.maximum(node[p], node[q])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(whole)], ["a", "b", "all"])

    return by_keys(rows, join, "a long, b long, all boolean")


def verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets have the Jaccard similarity at least."""

    def sets(batches):
        for b in in_steps(batches, "text"):
            found = [shingle_set((t or "").encode("utf-8", "surrogatepass"), size).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(h) - 2**63 for h in found], pa.int64()), pa.array(found, pa.binary())], ["node", "hashes"])

    def decide(batches):
        for b in batches:
            held = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                held.append(both >= similarity * (len(s) + len(t) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(held, pa.bool_()))

    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = prints.join(ends, "node").groupBy("node").agg(F.min("doc_id").alias("wanted")).select("wanted").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    own = checkpoint(texts.mapInArrow(sets, "node long, hashes binary").join(ends, "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.select("a", "b").join(own.select(F.col("node").alias("a"), F.col("hashes").alias("s")), "a").join(own.select(F.col("node").alias("b"), F.col("hashes").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(decide, "a long, b long")


def exact_components(docs: DataFrame, prints: DataFrame, nodes: DataFrame, size: int, words64: int, bits: int, radius: int, most: int, check64: int, whole: int, similarity: float) -> DataFrame:
    """(node, root): the components of the links of at least the similarity, in two passes; together they connect what all candidates would.

    The first tests a shortest spanning forest of the candidates under each key.
    The second takes the nodes of groups of which not all pairs were tested. All candidates of theirs lie in one cluster, as the forests
    connect them; it tests every pair of a cluster whose ends still lie in different components, told by whole
    fingerprints (of which whole bits may differ) and not by a part of them. After that no untested candidate joins two components.
    Sets of few shingles are linked with those of one fewer by their numbers.
    """
    few = nodes.where((F.size("fewer") > 0) & (F.col("n") - 1 >= similarity * F.col("n") - 1e-9)).select("node", F.explode("fewer").alias("a"))
    subsets = few.join(nodes.where(F.col("n") < FEW).select(F.col("node").alias("a")), "a").select("a", F.col("node").alias("b"))

    def found(some: DataFrame, carried: list[str], words: int, most: int, second: bool) -> DataFrame:
        rows = divided(rotated(some, words64, bits, radius, carried, 8 * words), radius, carried)
        return checkpoint(candidates(rows, words, radius, most, similarity, second).groupBy("a", "b").agg(F.max("all").alias("all")))

    pairs = found(nodes, ["n"], check64, most, False)
    out = checkpoint(verified(pairs, docs, prints, size, similarity).unionByName(subsets))
    first = checkpoint(components(out))
    root = lambda df, end: df.join(first.select(F.col("node").alias(end), F.col("root").alias("_fx_root")), end, "left").withColumn(end, F.coalesce("_fx_root", end)).drop("_fx_root")
    part = checkpoint(pairs.where("not all").select("a", "b"))
    clusters = components(root(root(part, "a"), "b").select("a", "b")).select(F.col("node").alias("comp"), F.col("root").alias("cluster"))  # of components that meet
    ends = part.select(F.col("a").alias("node")).unionByName(part.select(F.col("b").alias("node"))).distinct()
    crowd = ends.withColumn("comp", F.col("node")).transform(root, "comp").join(clusters, "comp")
    again = nodes.join(crowd, "node").select("node", "fp", "n", "comp", "cluster")
    sizes = again.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    again = checkpoint(again.join(sizes, "cluster"))
    if again.isEmpty():
        return first
    rest = apart(again.where(F.col("blocks") <= MOST_BLOCKS), words64, whole, similarity)
    giant = again.where(F.col("blocks") > MOST_BLOCKS)
    if not giant.isEmpty():  # more blocks than a fingerprint has keys: by its keys once more
        rest = rest.unionByName(found(giant.select("node", "fp", "n", "comp"), ["n", "comp"], words64, whole, True).select("a", "b"))
    rest = checkpoint(rest.join(pairs, ["a", "b"], "left_anti"))
    more = checkpoint(root(root(verified(rest, docs, prints, size, similarity), "a"), "b").select("a", "b").distinct())
    if more.isEmpty():
        return first
    second = checkpoint(components(more))  # of components and of nodes that had no link so far
    whole_ = first.unionByName(second.join(first, "node", "left_anti").select("node", F.col("node").alias("root")))
    return checkpoint(whole_.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def apart(nodes: DataFrame, words64: int, most: int, similarity: float) -> DataFrame:
    """(a, b): all pairs of nodes of one cluster and of different components, whose fingerprints differ in at most most bits and whose set sizes allow the similarity.

    A cluster of several blocks is compared block by block: each pair of blocks is a task's, and each pair of nodes is compared once.
    """
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    tiles = nodes.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = tiles.select(F.col("cluster").alias("key"), (F.least("own", "other").cast("long") * (MOST_BLOCKS + 1) + F.greatest("own", "other")).alias("sub"), "own", "node", "fp", "n", "comp")

    def join(t: pa.Table) -> pa.RecordBatch:
        order = np.lexsort((t.column("sub").to_numpy(), t.column("key").to_numpy()))
        key, sub, own, node, n, comp = (t.column(c).to_numpy()[order] for c in ("key", "sub", "own", "node", "n", "comp"))
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, words64)[order]
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]), True])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            within = sub[a] // (MOST_BLOCKS + 1) == sub[a] % (MOST_BLOCKS + 1)
            for at in range(a, b, 32):
                x, y = slice(at, min(at + 32, b)), slice(at if within else a, b)
                near = comp[x][:, None] != comp[y]
                near &= (node[x][:, None] < node[y]) | ((node[x][:, None] > node[y]) & (np.arange(y.start, y.stop) >= x.stop)) if within else (own[x][:, None] < own[y])
                small, large = np.minimum(n[x][:, None], n[y]), np.maximum(n[x][:, None], n[y])
                p, q = np.nonzero(near & (small >= similarity * large - 1e-9))
                p, q = p + x.start, q + y.start
                keep = np.bitwise_count(fps[p] ^ fps[q]).sum(axis=1, dtype=np.int64) <= most
                left.append(p[keep])
                right.append(q[keep])
        p, q = node[np.concatenate(left)], node[np.concatenate(right)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    return by_keys(rows, join, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, words64: int = 1, bits: int = 64, radius: int = 2, most: int | None = None, distinct: bool = False, similarity: float | None = None, check64: int = 2, whole: int | None = None) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable, itself included) of each document.

    size: words of a shingle. words64: 64-bit words of a fingerprint, cut into
    tries of bits bits each. distinct: each shingle votes once. most: bits in
    which whole fingerprints may differ. similarity: the exact Jaccard
    similarity of the shingle sets that a link must have (shingles are then
    distinct, and fingerprints are compared in their last check64 words, of which most bits may differ, or as a whole,
    of which whole bits may); without it fingerprints decide alone.
    """
    most = radius if most is None else most
    if similarity is None:
        prints = checkpoint(fingerprints(docs, size, words64, distinct))
        nodes = checkpoint(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
        roots = components(links(divided(rotated(nodes, words64, bits, radius), radius), words64, radius, most).distinct())
    else:
        prints = checkpoint(set_fingerprints(docs, size, words64))
        nodes = checkpoint(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("fewer").alias("fewer"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
        roots = exact_components(docs, prints, nodes.select("node", "fp", "n", "fewer"), size, words64, bits, radius, most, check64, words64 * most // check64 if whole is None else whole, similarity)
    rooted = nodes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = checkpoint(rooted.join(least, "root").select("node", "copies", "component_id"))
    return join_counted(prints, known, ["node"], "copies").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay if one document of each component does: the one with the least doc_id.

    Rows without doc_id come after all others, in the order of a hash of their text; of rows with one doc_id one stays.
    """
    names = docs.columns
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + F.pmod(F.xxhash64("text"), F.lit(2**61)))
    found = near_duplicates(docs.select(number.alias("doc_id"), "text"), **options)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_fx_number")).distinct()
    return docs.withColumn("_fx_number", number).join(keep, "_fx_number", "left_semi").dropDuplicates(["_fx_number"]).select(*names)


def op_query(docs: DataFrame) -> DataFrame:
    """The columns of the op4 contract."""
    return near_duplicates(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
