"""Brute-force twins of the operators."""

from __future__ import annotations

from collections import Counter, defaultdict


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def jaccard_components(sets: dict, num: int, den: int) -> dict:
    """Smallest node of each component of sets linked at num / den or more; exact, by a prefix index."""
    frequency = Counter(x for s in sets.values() for x in s)
    parts, index = Union(sets), defaultdict(list)
    for node in sorted(sets, key=lambda n: len(sets[n])):
        items = sorted(sets[node], key=lambda x: (frequency[x], x))
        size, near = len(items), set()
        for x in items[: size - (num * size + den - 1) // den + 1]:
            near.update(index[x])
            index[x].append(node)
        for other in near:
            both = len(sets[node] & sets[other])
            if den * both >= num * (size + len(sets[other]) - both):
                parts.join(node, other)
    return {n: parts.root(n) for n in sets}


def word_shingles(text: str | None, k: int) -> frozenset:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))
