"""Plain Python versions of the operators, for small tables."""

import re

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
NON_SPACE = re.compile("[^\x20\x09-\x0d]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            self.up[n] = self.up[self.up[n]]
            n = self.up[n]
        return n

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = NON_SPACE.findall(fold(text))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def similar(a, b):
    return bool(a) and 100 * len(a & b) >= 75 * len(a | b)


def components(texts):
    """id -> smallest id that links lead to."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids, union = sorted(sets), Union(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if similar(sets[a], sets[b]):
                union.tie(a, b)
    return {i: union.find(i) for i in ids}


def hits(texts, items):
    """id -> (words, words inside a window, items found)."""
    windows = {}
    for item, text in items:
        w = ALNUM.findall(fold(text))
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(item))
    out = {}
    for i, text in texts.items():
        w, hit, found = ALNUM.findall(fold(text)), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit.update(range(j, j + k))
                    found |= windows[tuple(w[j : j + k])]
        out[i] = (len(w), len(hit), found)
    return out
