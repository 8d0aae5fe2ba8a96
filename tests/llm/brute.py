"""Plain versions to compare with."""

import re


def words(text: bytes) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))


def components(items, linked):
    """item -> the least item reachable."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def similar(rows, size, least):
    """(a, b), a < b: the documents whose sets of word shingles have at least that Jaccard similarity, by an index of all shingles."""
    sets, having, shared = {}, {}, {}
    for d, text in rows:
        w = words((text or "").encode())
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) > size else {tuple(w)} if w else set()
        for x in sets[d]:
            having.setdefault(x, []).append(d)
    for ds in having.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                pair = (min(a, b), max(a, b))
                shared[pair] = shared.get(pair, 0) + 1
    empty = sorted(d for d, x in sets.items() if not x)
    found = {(a, b) for (a, b), n in shared.items() if n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9}
    return found | set(zip(empty, empty[1:], strict=False))
