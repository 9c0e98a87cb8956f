"""Brute force shared by tests."""

from collections import Counter, defaultdict


def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_brute(rows):
    """(doc_id, least doc_id of its group, links) of each row, by all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    both = Counter()
    for found in by.values():
        for k, a in enumerate(found):
            for b in found[:k]:
                both[b, a] += 1
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows)]
