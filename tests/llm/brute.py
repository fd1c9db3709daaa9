"""Near duplicates by comparing all pairs."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def groups(rows, k, percent=80):
    """Rows (id, text, ...) that are connected, as lists of places, and their sets."""
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    found: dict = {}
    for a in range(len(rows)):
        found.setdefault(root(a), []).append(a)
    return list(found.values()), sets


def kept_by_brute_force(rows, k):
    found, _ = groups(rows, k)
    return sorted(min(rows[a][0] for a in group) for group in found)
