"""Plain versions of the operators, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, words=5):
    found = WORD.findall(lower(text))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def components(rows):
    """``{id: smallest id reachable}`` of ``(id, text)`` rows; texts link at 4/5 Jaccard."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        shared = {}
        for x in s:
            for other in holders[x]:
                if other < k:
                    shared[other] = shared.get(other, 0) + 1
        for other, both in shared.items():
            j, t = sets[other]
            if 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}
