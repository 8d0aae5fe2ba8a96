"""Repeated substrings across documents, by suffix arrays of candidate regions.

A byte is removed if a string of MATCH bytes that covers it also starts in a
document with a smaller doc_id.

1. Anchors. Each MATCH-byte window has an anchor, a gram of over half its length
   at a place that its content decides, so equal windows have equal anchors at
   equal places. A few per cent of all places are anchors. Anchors' hashes, packed by hash range,
   are grouped over all documents; those of one document only can't begin a
   repeat.
2. Regions. For each remaining anchor, its windows (a run of places) make a
   region of text. Regions are dealt out by the anchor's hash, so all windows
   that can equal one another meet. Equal regions of a batch are merged
   first, as a group that most documents share would else meet in one task:
   all but those of the least document are removed for certain.
3. Suffix arrays, by two-stage sorting: suffixes smaller than their successors
   are sorted directly (to the depth that matters), all others are induced by
   one scan over the buckets of first bytes. Adjacent common prefixes of at
   least MATCH bytes make the groups, whose least document keeps its copy.
   Equal regions go into an array once, for the least document that has them.
4. The removed ranges are joined back to the documents and merged.

Texts cross the network once (both joins use the same exchange), compressed and
keyed by document, never by content. Hashes only select candidates: every removal rests
on a comparison of bytes, in a suffix array or in a merge of equal regions. An
anchor with more than CROWDED entries is dealt out by its single windows
instead of by its gram, so that no region group grows with the corpus.

Edge cases: null and empty texts and those under MATCH bytes lose nothing. A
null doc_id counts as larger than all others. Rows with one doc_id never remove
one another's bytes; rows repeated in full give the same result each. Very long
texts are cut into overlapping pieces for the anchor search only. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, gathered, in_steps, text_bytes

MATCH = 50
#: Bytes of the seeds by which grams are placed.
SEED = 5
LAST = 2**63 - 1
#: Text bytes for each hash range of anchors, and for the pieces in which anchors are sought.
RANGE_BYTES, PIECE = 16 << 20, 1 << 19
#: Text bytes whose anchors or regions are packed together.
SLICE = 8 << 20
#: Hash ranges at least.
LEAST_RANGES = 64
#: Up to FAN * FAN hash ranges (64 GB of text) anchors cross the network once.
FAN = 64
#: A hash range is handled in so many parts, one after another (a power of two).
SUBRANGES = 4
#: Region bytes for one suffix array.
ARRAY_BYTES = 1 << 18
CROWDED = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each gram of size bytes, by doubling."""
    h, done, factor = BYTE[data], 1, int(MIX)
    parts = {1: h}
    while done * 2 <= size:
        h = h[: len(h) - done] * np.uint64(factor) + h[done:]
        factor, done = factor * factor & LAST * 2 + 1, done * 2
        parts[done] = h
    at, out = done, h
    for n in sorted(parts, reverse=True)[1:]:
        while at + n <= size:
            m = len(data) - at - n + 1
            out = out[:m] * np.uint64(pow(int(MIX), n, 2**64)) + parts[n][at : at + m]
            at += n
    out = (out ^ (out >> np.uint64(32))) * MIX
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, match: int = MATCH):
    """(hash, document number, first window, number of windows) of each anchor; windows lie within a document. data: under 16 MB.

    In each window the seed (SEED bytes) of least hash is sought; its place modulo
    half the window is where the window's gram begins. That keeps
    anchors as rare as seeds of least hash are, with grams of over half the window.
    """
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    half, gram = _halves(match)
    if len(data) < match:
        return none
    h = gram_hashes(data, SEED)
    low = np.uint64(0xFFFFFF)
    least = h & ~low | np.arange(len(h), dtype=np.uint64)
    del h
    span, done = match - SEED + 1, 1
    while done * 2 <= span:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    if span > done:
        least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    at = (least & low).astype(np.int32)  # of each window's seed
    del least
    at -= (at - np.arange(len(at), dtype=np.int32)) // half * half  # of its gram
    ok = np.zeros(len(at) + 1, np.int32)
    full = sizes >= match
    np.add.at(ok, starts[full], 1)
    np.add.at(ok, starts[full] + sizes[full] - match + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    new = np.concatenate(([True], at[1:] != at[:-1]))
    new[starts[full]] = True
    first = np.flatnonzero(new & ok)
    if not len(first):
        return none
    edge = np.flatnonzero(np.concatenate((new | ~ok, [True])))
    n = edge[np.searchsorted(edge, first, side="right")] - first
    doc = np.searchsorted(starts, first, side="right") - 1
    # documents without bytes share a start with the next one
    return gram_hashes(data, gram)[at[first]], doc, first - starts[doc], n


def _halves(match: int) -> tuple[int, int]:
    """How many places grams may begin at, and their length."""
    half = min(31, (match - SEED + 1) // 2)
    return half, match - half + 1


def sevens(t: np.ndarray) -> np.ndarray:
    """Each number of t with the six that follow it, in one word."""
    wide = np.concatenate((t, np.zeros(8, t.dtype))).astype(np.uint64)
    two = wide[:-1] << np.uint64(9) | wide[1:]
    four = two[:-2] << np.uint64(18) | two[2:]
    return (four[: len(t) + 2] << np.uint64(27) | two[4 : len(t) + 6] << np.uint64(9) | wide[6 : len(t) + 8])[: len(t)]


def _next(flags: np.ndarray) -> np.ndarray:
    """The first flagged place at or after each, or the length."""
    return np.minimum.accumulate(np.where(flags, np.arange(len(flags)), len(flags))[::-1])[::-1]


def suffix_array(t: np.ndarray, depth: int, wanted: np.ndarray | None = None, seven: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of t (numbers under 512, 0 as a separator) in order of their first depth numbers, or as far as a separator.

    Two-stage sorting: a suffix is of type B if it is smaller than its
    successor. Those are sorted directly, by their first depth numbers.
    Within the bucket of a first number the others (type A) come first; a scan
    of the buckets in order puts each suffix's predecessor, if of type A, at the
    next place of its own bucket. wanted: places whose suffixes are asked for;
    then only those of type B are sorted that they, or their chains of type A, need.
    """
    n = len(t)
    seven = sevens(t) if seven is None else seven
    after = _next(np.append(t[:-1] != t[1:], True))  # the last of each run; the last suffix is larger than the empty one
    small = np.append(t, 0)[np.minimum(after + 1, n)] > t[after]
    small[after == n - 1] = False

    b = np.flatnonzero(small)
    if wanted is not None:
        need = np.zeros(n + 1, bool)
        need[_next(small)[wanted]] = True
        b = np.flatnonzero(need[:n])
    if n and t.max() < 256:  # as fixed strings of bytes; UTF-8 has no byte 255
        plain = np.concatenate((t, np.zeros(depth, t.dtype))).astype(np.uint8)
        b = b[np.argsort(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(plain, depth)[b]).view(f"S{depth}").ravel())]
    else:
        far = np.concatenate((seven, np.zeros(depth, np.uint64)))
        b = b[np.lexsort([far[b + k] for k in range(0, depth, 7)][::-1])]
    firsts = np.searchsorted(t[b], np.arange(513), side="left")

    larger = ~small
    heads: list[list[np.ndarray]] = [[] for _ in range(513)]
    if n and larger[n - 1]:
        heads[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(int(t.max()) + 1 if n else 0):
        own = heads[c]
        if not own and firsts[c] == firsts[c + 1]:
            continue
        front = np.concatenate(own) if own else np.zeros(0, np.int64)
        made = [front]
        while len(front):  # runs of c
            front = front[front > 0] - 1
            front = front[(t[front] == c) & larger[front]]
            made.append(front)
        bucket = np.concatenate([*made, b[firsts[c] : firsts[c + 1]]])
        out.append(bucket)
        q = bucket[bucket > 0] - 1
        q = q[larger[q] & (t[q] > c)]
        if len(q):
            q = q[np.argsort(t[q], kind="stable")]
            cut = np.flatnonzero(np.diff(t[q])) + 1
            for piece in np.split(q, cut):
                heads[t[piece[0]]].append(piece)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated(regions: list[bytes], docs: list[int], match: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """The least document in whose regions each window of the regions stands, and where each region's windows begin (and the last ones end).

    docs: the least document that has each region; match: seven at least.
    """
    sizes = np.array([len(r) for r in regions])
    data = np.frombuffer(b"".join(regions), np.uint8)
    owner = np.repeat(np.arange(len(regions)), sizes)
    t = np.zeros(len(data) + len(regions), np.uint16)
    t[np.arange(len(data)) + owner] = data.astype(np.uint16) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    whose = np.repeat(np.arange(len(regions)), sizes + 1)
    room = starts[whose] + sizes[whose] - np.arange(len(t)) >= match  # windows
    seven = sevens(t)
    sa = suffix_array(t, match, room, seven)
    sa = sa[room[sa]]
    begins = np.concatenate(([0], np.cumsum(np.maximum(sizes - match + 1, 0))))
    if not len(sa):
        return np.zeros(0, np.int64), begins
    # adjacent common prefixes of at least match numbers
    x, y = sa[:-1], sa[1:]
    same = np.ones(len(x), bool)
    for k in range(0, match, 7):  # seven numbers at a time, the last of them up to the whole length
        live, k = np.flatnonzero(same), min(k, match - 7)
        same[live] = seven[x[live] + k] == seven[y[live] + k]
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    rank = np.array(docs, np.int64)[whose[sa]]
    least = np.minimum.reduceat(rank, head)
    first = np.zeros(len(t), np.int64)
    first[sa] = np.repeat(least, np.diff(np.append(head, len(sa))))
    return first[room], begins


def runs(flags: np.ndarray, at: int, match: int) -> list[tuple[int, int]]:
    """Byte ranges that the flagged windows cover; the first window begins at a place at."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return [(at + a, at + b - 1 + match) for a, b in edge.reshape(-1, 2).tolist()]


def pack(*arrays: np.ndarray) -> bytes:
    return struct.pack("<I", len(arrays[0])) + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<I", blob)[0], 4, []
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def pack_ranges(ends: list[int]) -> bytes:
    """Begins and ends of ranges of under 256 bytes."""
    x = np.array(ends, np.int64).reshape(-1, 2)
    return pack(x[:, 0].astype("<u4"), (x[:, 1] - x[:, 0]).astype("u1"))


def by_part(batches, done):
    """Calls done(rows) for each run of rows of one part; rows are (key, rank, blob). Batches are sorted by part."""
    part, rows = None, []
    for b in batches:
        for p, *row in zip(*(b.column(c).to_pylist() for c in NAMES), strict=True):
            if p != part and rows:
                yield from done(rows)
                rows = []
            part = p
            rows.append(row)
    if rows:
        yield from done(rows)


def row_batches(rows, names, kinds, size: int = 256):
    rows = iter(rows)
    while chunk := [r for _, r in zip(range(size), rows, strict=False)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk, strict=True), kinds, strict=True)], names)


PACKED = "part int, key long, rank long, blob binary"
NAMES, KINDS = ["part", "key", "rank", "blob"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def packed_anchors(h: np.ndarray, key: np.ndarray, first: np.ndarray, n: np.ndarray):
    """Rows of anchors, packed by their hash range (the upper half of h), by which they are sorted."""
    part = h >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(h) else []
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        keys, which = np.unique(key[lo:hi], return_inverse=True)
        kind = np.uint16 if len(keys) < 2**16 else np.uint32
        blob = struct.pack("<III", hi - lo, len(keys), int(part[lo])) + keys.astype("<i8").tobytes() + h[lo:hi].astype("<u4").tobytes() + which.astype(kind).tobytes() + first[lo:hi].tobytes() + n[lo:hi].tobytes()
        yield int(part[lo]), None, None, blob


def unpacked_anchors(blob: bytes, sub: int | None = None):
    """hash, document, first window, number of windows of a blob's anchors, or of those in one part of its range."""
    size, m, part = struct.unpack_from("<III", blob)
    kind = np.dtype(np.uint16 if m < 2**16 else np.uint32)
    at = 12 + 8 * m
    keys, low = np.frombuffer(blob, "<i8", m, 12), np.frombuffer(blob, "<u4", size, at)
    own = slice(None) if sub is None else (low & np.uint32(SUBRANGES - 1)) == sub
    which = np.frombuffer(blob, kind, size, at + 4 * size)[own]
    at += (4 + kind.itemsize) * size
    return low[own].astype(np.uint64) | np.uint64(part << 32), keys[which], np.frombuffer(blob, "<u4", size, at)[own], np.frombuffer(blob, np.uint8, size, at + 4 * size)[own]


def gathered_anchors(rows: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """Packed anchors of many slices, put together by hash range: where a slice has few anchors in each of very many
    ranges, they go by groups of fan ranges first, and are packed anew there."""
    if parts <= fan * fan:
        return rows

    def work(batches):
        held, size = [], 0

        def done():
            h, key, first, n = (np.concatenate(x) for x in zip(*(unpacked_anchors(x) for x in held), strict=True))
            order = np.lexsort((key, h))
            return row_batches(packed_anchors(h[order], key[order], first[order], n[order]), NAMES, KINDS)

        for b in batches:
            single = b.filter(pc.is_valid(b.column("key")))
            if single.num_rows:
                yield single
            for blob in b.filter(pc.is_null(b.column("key"))).column("blob").to_pylist():
                held.append(blob)
                size += len(blob)
                if size >= 4 * SLICE:
                    yield from done()
                    held, size = [], 0
        if held:
            yield from done()

    return rows.repartition(F.floor(F.col("part") / fan)).mapInArrow(work, PACKED)


def anchor_rows(texts: DataFrame, parts: int, match: int) -> DataFrame:
    """Packed anchors by hash range (key null), and those of crowded anchors that need no comparison (key: the document's)."""

    def blocks(keys, data):
        held, size = [], 0
        for key, text in zip(keys, data, strict=True):
            for at in range(0, max(1, len(text) - match + 1), PIECE):
                piece = text[at : at + PIECE + match - 1]
                if len(piece) < match:
                    continue
                held.append((key, at, piece))
                size += len(piece)
                if size >= PIECE:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def work(batches):
        for b in gathered(batches, "_fx_text", SLICE):
            got = []
            for held in blocks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sizes = np.array([len(x) for _, _, x in held])
                h, doc, first, n = anchors(np.frombuffer(b"".join(x for _, _, x in held), np.uint8), np.cumsum(sizes) - sizes, sizes, match)
                at = np.array([x for _, x, _ in held])
                key = np.array([x for x, _, _ in held])
                got.append((h, key[doc], (first + at[doc]).astype(np.uint32), n.astype(np.uint8)))
            if not got:
                continue
            h, key, first, n = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((key, h))
            h, key, first, n = h[order], key[order], first[order], n[order]
            # the hash range and four bytes more tell anchors apart well enough: what they mix up is found to differ
            h = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.diff(np.append(head, len(h)))
            place = np.arange(len(h)) - np.repeat(head, count)
            tail = np.repeat(head + count - 1, count)
            crowded = np.repeat((count > 64) & (key[head] != key[head + count - 1]), count)
            alone = crowded & (place >= 8) & (np.arange(len(h)) != tail)
            if alone.any():
                a = np.flatnonzero(alone)
                a = a[np.argsort(key[a], kind="stable")]
                for piece in np.split(a, np.flatnonzero(np.diff(key[a])) + 1):
                    yield from row_batches([(int(key[piece[0]] % parts), int(key[piece[0]]), None, pack(h[piece], first[piece], n[piece] | 2 << 6))], NAMES, KINDS)
            h, key, first, n = h[~alone], key[~alone], first[~alone], n[~alone]
            yield from row_batches(packed_anchors(h, key, first, n), NAMES, KINDS)

    return texts.select("_fx_key", "_fx_text").mapInArrow(work, PACKED)


def shared_anchors(rows: DataFrame, match: int) -> DataFrame:
    """(key, blob): for each document and hash range the anchors that other documents have as well."""

    def done(rows):
        yield from ((k, blob) for k, _, blob in rows if k is not None)
        packed = [blob for k, _, blob in rows if k is None]
        kept = []
        for sub in range(SUBRANGES) if packed else ():
            h, key, first, n = (np.concatenate(x) for x in zip(*(unpacked_anchors(blob, sub) for blob in packed), strict=True))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            head = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            k = key[order]
            many = np.minimum.reduceat(k, head) != np.maximum.reduceat(k, head)
            count = np.diff(np.append(head, len(h)))
            keep = order[np.repeat(many, count)]
            flag = np.repeat(count[many] > CROWDED, count[many]).astype(np.uint8) << 6
            kept.append((h[keep], key[keep], first[keep], n[keep] | flag))
        if kept:
            h, key, first, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.argsort(key, kind="stable")
            h, key, first, n = h[order], key[order], first[order], n[order]
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else []
            yield from ((int(key[a]), pack(h[a:b], first[a:b], n[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=False))

    def work(batches):
        yield from row_batches(by_part(batches, done), ["key", "blob"], [pa.int64(), pa.binary()], 2000)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(work, "key long, blob binary")


def region_rows(joined: DataFrame, parts: int, match: int) -> DataFrame:
    """Packed regions by hash (key null), and ranges known to be removed (key: the document's). joined has (_fx_key, doc_id, _fx_zip, blobs)."""

    def work(batches):
        packer, plain = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        for b in gathered(batches, "_fx_zip", SLICE):
            merged: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            for key, doc, text, blobs in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if not blobs:
                    continue
                text = plain.decompress(text)
                rank = LAST if doc is None else doc
                for blob in blobs:
                    for h, first, n in zip(*(x.tolist() for x in unpack(blob, "<u8", "<u4", "u1")), strict=True):
                        flag, n = n >> 6, n & 63
                        if flag != 1:
                            merged.setdefault((h & 0xFFFFFFFFFFFF, text[first : first + n + match - 1]), []).append((rank, key, first))
                        if flag:
                            for at in range(first, first + n):
                                w = text[at : at + match]
                                merged.setdefault((xxhash.xxh64_intdigest(w) & 0xFFFFFFFFFFFF, w), []).append((rank, key, at))
            gone: dict[tuple[int, int], list[int]] = {}
            sent: dict[int, list[tuple]] = {}
            for (h, region), members in merged.items():
                least = min(members)[0]
                for rank, key, at in members:
                    if rank > least:
                        gone.setdefault((key, rank), []).extend((at, at + len(region)))
                    else:
                        sent.setdefault(h % parts, []).append((h, rank, key, at, region))
            del merged
            for part, rows in sent.items():
                for k in range(0, len(rows), 5000):
                    h, rank, key, at, region = zip(*rows[k : k + 5000], strict=True)
                    blob = pack(np.array(h, "<u8"), np.array(rank, "<i8"), np.array(key, "<i8"), np.array(at, "<u4"), np.array([len(r) for r in region], "<u1")) + b"".join(region)
                    yield from row_batches([(part, None, None, packer.compress(blob))], NAMES, KINDS)
            yield from row_batches(((k % parts, k, rank, pack_ranges(v)) for (k, rank), v in gone.items()), NAMES, KINDS, 2000)

    return joined.mapInArrow(work, PACKED)


def removed_ranges(rows: DataFrame, match: int) -> DataFrame:
    """(key, rank, blob): removed byte ranges, from the suffix arrays of the regions that share an anchor."""

    def done(rows):
        yield from (row for row in rows if row[0] is not None)
        packed = [zstandard.ZstdDecompressor().decompress(blob) for k, _, blob in rows if k is None]
        gone: dict[tuple[int, int], list[int]] = {}
        for sub in range(SUBRANGES):
            settle(packed, sub, gone)
        yield from ((k, rank, pack_ranges(v)) for (k, rank), v in gone.items())

    def settle(packed, sub, gone):
        merged: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
        for blob in packed:
            h, rank, key, at, size = unpack(blob, "<u8", "<i8", "<i8", "<u4", "<u1")
            begin = len(blob) - int(size.sum()) + np.cumsum(size, dtype=np.int64) - size
            own = (h >> np.uint64(20) & np.uint64(SUBRANGES - 1)) == sub
            for g, r, d, a, n, pos in zip(*(x[own].tolist() for x in (h, rank, key, at, size, begin)), strict=True):
                merged.setdefault(g, {}).setdefault(blob[pos : pos + n], []).append((r, d, a))
        block: list[tuple[bytes, list]] = []
        size = 0

        def flush():
            least = [min(m)[0] for _, m in block]
            first, begins = repeated([r for r, _ in block], least, match)
            lo, hi = (f.reduceat(first, begins[:-1]).tolist() for f in (np.minimum, np.maximum))
            for i, (region, members) in enumerate(block):
                for r, d, a in members:
                    if r > hi[i]:
                        gone.setdefault((d, r), []).extend((a, a + len(region)))
                    elif r > lo[i]:
                        gone.setdefault((d, r), []).extend(x for run in runs(first[begins[i] : begins[i + 1]] < r, a, match) for x in run)

        for regions in merged.values():
            # one region of one document repeats nothing
            if len(regions) > 1 or len({r for r, _, _ in next(iter(regions.values()))}) > 1:
                block += regions.items()
                size += sum(map(len, regions))
                if size > ARRAY_BYTES:
                    flush()
                    block, size = [], 0
        if block:
            flush()

    def work(batches):
        yield from row_batches(by_part(batches, done), NAMES[1:], KINDS[1:], 2000)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(work, "key long, rank long, blob binary")


def merge(blobs: list[bytes]) -> list[tuple[int, int]]:
    """Maximal runs of packed byte ranges."""
    out: list[list[int]] = []
    for a, b in sorted((a, a + n) for blob in blobs for a, n in zip(*(x.tolist() for x in unpack(blob, "<u4", "u1")), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def zipped(texts: DataFrame) -> DataFrame:
    """(_fx_key, doc_id, _fx_zip): the texts compressed, as they cross the network."""

    def work(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in in_steps(batches, "_fx_text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t) for t in b.column(2).to_pylist()], pa.binary())], ["_fx_key", "doc_id", "_fx_zip"])

    return texts.select("_fx_key", "doc_id", "_fx_text").mapInArrow(work, "_fx_key long, doc_id long, _fx_zip binary")


def spans(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """doc_id, _fx_zip (the compressed text) and blobs of the removed ranges."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(LEAST_RANGES, -(-total // RANGE_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_fx_text")).withColumn("_fx_key", F.xxhash64("doc_id", "_fx_text"))
    gather = lambda df, what, name: df.groupBy(F.col("key").alias("_fx_key")).agg(F.collect_list(what).alias(name))
    shared = gather(shared_anchors(gathered_anchors(anchor_rows(texts, parts, match), parts), match), "blob", "blobs")
    moved = zipped(texts)
    first = moved.join(shared, "_fx_key", "left").select("_fx_key", "doc_id", "_fx_zip", "blobs")
    gone = gather(removed_ranges(region_rows(first, parts, match), match), F.struct("rank", "blob"), "gone")
    # documents are known by 64 bits of their text and by their number, so that equal hashes take no bytes from one another
    mine = F.filter("gone", lambda x: x["rank"] == F.coalesce("doc_id", F.lit(LAST)))
    return moved.join(gone, "_fx_key", "left").select("doc_id", "_fx_zip", F.transform(mine, lambda x: x["blob"]).alias("gone"))


def deduplicated(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each document."""

    def work(batches):
        plain = zstandard.ZstdDecompressor()
        for b in in_steps(batches, "_fx_zip", STEP // 2):
            n, removed, count, kept = [], [], [], []
            for text, blobs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = plain.decompress(text)
                runs_ = merge(blobs) if blobs else []
                edges = [0, *(x for r in runs_ for x in r), len(text)]
                n.append(len(text))
                removed.append(sum(e - a for a, e in runs_))
                count.append(len(runs_))
                kept.append(b"".join(text[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return spans(docs, match).select("doc_id", "_fx_zip", "gone").mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op_query(docs: DataFrame) -> DataFrame:
    """The columns of the op8 contract."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
