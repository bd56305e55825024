"""Plain, quadratic or worse versions of operators, for small tables only."""

import re

import xxhash

LOWER = bytes(range(256)).translate(bytes(range(256)).lower())


def words(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode().lower())


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def components(prints, radius=2):
    """{id: smallest id reachable} for {id: fingerprint}, over all pairs."""
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def kept_lines(texts, min_words=5):
    """{id: (lines, kept lines)}: every run of 2**k lines, k by k, against all earlier runs."""
    split = {i: (t or "").split("\n") for i, t in texts.items()}
    gone = {i: set() for i in texts}
    size = 1
    while any(len(x) >= size for x in split.values()):
        seen = set()
        for i in sorted(split):
            for at in range(len(split[i]) - size + 1):
                run = tuple(split[i][at : at + size])
                if run in seen and sum(len(re.findall(r"[^ \t-\r]+", line)) for line in run) >= min_words:
                    gone[i].update(range(at, at + size))
                seen.add(run)
        size *= 2
    return {i: (x, [line for at, line in enumerate(x) if at not in gone[i]]) for i, x in split.items()}


def contaminated(text, items, window=10):
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    doc = words(text, pattern)
    grams = {}
    for item in items:
        w = words(item, pattern)
        n = min(len(w), window)
        for at in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, set()).add(tuple(w[at : at + n]))
    return any(tuple(doc[at : at + n]) in grams[n] for n in grams for at in range(len(doc) - n + 1))


def shingles(text, size=5):
    """Distinct word shingles; fewer words are one shingle, no words none."""
    w = words(text)
    return frozenset(b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def similar_pairs(texts, least=0.8):
    """Pairs of ids whose texts share so many of their distinct shingles."""
    sets, ids = {i: shingles(t) for i, t in texts.items()}, sorted(texts)
    out = set()
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < least * max(len(x), len(y)):
                continue
            shared = len(x & y)
            if shared >= least * (len(x) + len(y) - shared):
                out.add((a, b))
    return out


def joined(ids, pairs):
    """{id: smallest id reachable over the pairs}."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
