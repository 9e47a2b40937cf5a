"""Plain Python versions of the operators, for small tables."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size=4):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near_components(rows, size=4, threshold=85):
    """{id: (set size, smallest id in the component)}; pairs are found by an inverted index, verified on whole sets."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    by_set, root = {}, {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for i, s in sets.items():
        if s:
            if s in by_set:
                join(i, by_set[s])
            else:
                by_set[s] = i
    index, tested = {}, set()
    for s, i in by_set.items():
        for t in s:
            index.setdefault(t, []).append(i)
    for ids in index.values():
        for a, b in combinations(ids, 2):
            if (a, b) in tested or find(a) == find(b):
                continue
            tested.add((a, b))
            both = len(sets[a] & sets[b])
            if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                join(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
