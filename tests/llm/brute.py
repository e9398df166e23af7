"""Plain versions of the operators, for small inputs."""

from collections import Counter


def word_sets(rows):
    """doc -> set of five-word shingles."""
    out = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        out[doc] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def jaccard_classes(rows):
    """doc -> (set size, smallest doc reachable)."""
    sets = word_sets(rows)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for d in sorted(sets):
        seen = Counter(e for s in sets[d] for e in holders.get(s, ()))
        for e, k in seen.items():
            if 100 * k >= 80 * (len(sets[d]) + len(sets[e]) - k):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def within_one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :]


def repeated_bytes(texts, span):
    """For each text, flags of bytes covered by a string of ``span`` bytes that also starts elsewhere."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + span] for x in raw for i in range(len(x) - span + 1))
    out = []
    for x in raw:
        flags = [False] * len(x)
        for i in range(len(x) - span + 1):
            if count[x[i : i + span]] > 1:
                flags[i : i + span] = [True] * span
        out.append(flags)
    return out


def repeated_passages(texts, span, words):
    """The same, without runs of such bytes that hold fewer than ``words`` words."""
    out = []
    for text, flags in zip(texts, repeated_bytes(texts, span)):
        raw, edges = (text or "").encode(), [0, *flags, 0]
        starts = [i for i in range(len(raw)) if edges[i + 1] and not edges[i]]
        for a in starts:
            b = a
            while b < len(raw) and flags[b]:
                b += 1
            if len(raw[a:b].split()) < words:
                flags[a:b] = [False] * (b - a)
        out.append(flags)
    return out
