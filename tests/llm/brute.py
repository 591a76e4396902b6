"""Plain forms of what the operators compute, for small tables."""

import re
from collections import defaultdict


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_components(texts, percent=75):
    """{doc_id: (set size, smallest id of its component)}"""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                common[a, b] += 1
    union = Union()
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            union.join(a, b)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def line_shingles(line, k=8):
    """``k`` characters from each word start on, and from every place from which a word has as many."""
    starts = (p for p in range(len(line)) if line[p] != " " and (p == 0 or line[p - 1] == " "))
    inner = (p for p in range(len(line) - k + 1) if " " not in line[p : p + k])
    return frozenset(line[p : p + k] for p in (*starts, *inner))


def line_dedup(texts, similarity=0.8):
    """{doc_id: text} with one line kept of each component of alike lines, by comparing all lines that share a shingle."""
    places = defaultdict(list)
    for i in sorted(texts):
        for n, line in enumerate((texts[i] or "").split("\n")):
            line = line.strip(" \r")
            if line:
                places[line].append((i, n))
    every = list(places)
    sets = [line_shingles(line) for line in every]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    union = Union()
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if n >= similarity * (len(s) + len(sets[j]) - n):
                union.join(i, j)
    groups = defaultdict(list)
    for i, line in enumerate(every):
        groups[union.find(i)] += places[line]
    gone = {p for held in groups.values() for p in sorted(held)[1:]}
    return {
        i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        for i, t in texts.items()
    }
