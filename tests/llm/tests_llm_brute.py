"""Near-duplicate classes by comparing all pairs, for small tables."""

import itertools


def near_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
            a_, b_ = sorted((find(i), find(j)))
            parent[b_] = a_
    return {i: find(i) for i in sets}
