"""Similarity join of sets in a trie of their globally ordered elements.

Linked sets share one of the few rarest elements of both, so an index of these names the sets a query can link with; the
trie, in which frequent elements come first, then counts the overlaps of all of them at once along their common paths.
"""

from __future__ import annotations

import numpy as np

#: Two sets link if PART * intersection >= LEAST * union.
PART, LEAST = 100, 80


def linked(overlap: int, size_a: int, size_b: int) -> bool:
    return PART * overlap >= LEAST * (size_a + size_b - overlap)


class Node:
    """`label` holds the elements on the edge to the node, `depth` counts those of its whole path; `lo` and `hi` bound the
    sizes of the sets below it, `ends` are the sets that end here."""

    __slots__ = ("label", "depth", "children", "ends", "lo", "hi", "parent", "asked")

    def __init__(self, label: np.ndarray, depth: int) -> None:
        self.label, self.depth, self.children, self.ends, self.lo, self.hi = label, depth, [], [], 1 << 60, 0
        self.parent, self.asked = None, 0


class Trie:
    """Sets of the elements 0 .. n - 1, each an ascending array; common beginnings are stored once.

    `sizes` are the sets' sizes where they have more elements than are stored (elements that no other set has).
    """

    def __init__(self, sets: list[np.ndarray], n: int, sizes: list[int] | None = None) -> None:
        self.sizes, self.inside, self.queries = sizes or [len(s) for s in sets], np.zeros(n, bool), 0
        self.root = Node(np.zeros(0, np.int64), 0)
        path, before = [self.root], np.zeros(0, np.int64)
        for k in sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes()):
            now = sets[k]
            m = min(len(now), len(before))
            apart = np.flatnonzero(now[:m] != before[:m])
            common = int(apart[0]) if len(apart) else m
            last = None
            while path[-1].depth > common:
                last = path.pop()
            if path[-1].depth < common:  # the last node popped is cut in two
                top = path[-1]
                upper = Node(last.label[: common - top.depth], common)
                last.label = last.label[common - top.depth :]
                top.children[top.children.index(last)] = upper
                upper.children.append(last)
                path.append(upper)
            if len(now) > common:
                leaf = Node(now[common:], len(now))
                path[-1].children.append(leaf)
                path.append(leaf)
            path[-1].ends.append(k)
            before = now
        order, self.node = [self.root], [self.root] * len(sets)
        for node in order:
            order += node.children
            for child in node.children:
                child.parent = node
            for k in node.ends:
                self.node[k] = node
        for node in reversed(order):
            sizes = [x for c in node.children for x in (c.lo, c.hi)] + [self.sizes[k] for k in node.ends]
            node.lo, node.hi = min(sizes, default=1 << 60), max(sizes, default=0)

    def query(self, items: np.ndarray, size: int | None = None, among: list[int] | None = None) -> list[int]:
        """The stored sets, all or `among` some, that link with the ascending `items`; `size` counts elements that no stored
        set has as well.

        The overlap of a path is counted once for all sets below it. A subtree is left out if its sets can't link, given
        what remains of the query behind the path's last element and of the longest set below.
        """
        size = len(items) if size is None else size
        self.queries += 1
        for k in range(len(self.node)) if among is None else among:
            node = self.node[k]
            while node is not None and node.asked != self.queries:
                node.asked = self.queries
                node = node.parent
        wanted = None if among is None else set(among)
        self.inside[items] = True
        found, todo = [], [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            overlap += int(np.count_nonzero(self.inside[node.label]))
            rest = len(items) - int(np.searchsorted(items, node.label[-1], "right")) if len(node.label) else len(items)
            best = overlap + min(rest, node.hi - node.depth)
            if (PART + LEAST) * best < LEAST * (size + node.lo):
                continue
            found += [k for k in node.ends if (wanted is None or k in wanted) and linked(overlap, size, self.sizes[k])]
            todo += [(c, overlap) for c in node.children if c.asked == self.queries]
        self.inside[items] = False
        return found


class Ranked:
    """Sets over 0 .. n - 1, frequent elements first so that likeness shows as common beginnings, without elements that only
    one set has; and the rarest elements of each, one of which two linked sets have in common."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.n, self.sizes = int((counts > 1).sum()), [len(s) for s in sets]
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
        parts = np.split(rank[place], np.cumsum(self.sizes)[:-1])
        self.items = [np.sort(x[x < self.n]) for x in parts]
        # of the n // 5 + 1 rarest elements, those of this set alone come first
        self.rare = [x[max(0, len(x) - max(0, n // 5 + 1 - (n - len(x)))) :] for x, n in zip(self.items, self.sizes, strict=True)]
        self.having: list[list[int]] = [[] for _ in range(self.n)]
        for k, own in enumerate(self.rare):
            for e in own.tolist():
                self.having[e].append(k)


def link_roots(sets: list[np.ndarray]) -> list[int]:
    """For each set the smallest index in its connected component of links.

    A set asks for links with those that share one of its rarest elements and aren't in its component yet. An element
    whose sets are all in one component is closed for good, so copies of one text are asked about once.
    """
    ranked = Ranked(sets)
    having = [np.array(x, np.int64) for x in ranked.having]
    component, members = np.arange(len(sets)), [[k] for k in range(len(sets))]

    def join(a: int, b: int) -> None:
        a, b = int(component[a]), int(component[b])
        if a != b:
            a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
            component[members[b]] = a
            members[a] += members[b]
            members[b] = []

    trie = Trie(ranked.items, ranked.n, ranked.sizes)
    closed = np.zeros(ranked.n, bool)
    for k in range(len(sets)):
        others = []
        for e in ranked.rare[k][~closed[ranked.rare[k]]].tolist():
            apart = having[e][component[having[e]] != component[k]]
            closed[e] = not len(apart)
            others.append(apart)
        if others and len(among := np.unique(np.concatenate(others))):
            for other in trie.query(ranked.items[k], ranked.sizes[k], among.tolist()):
                join(k, other)
    smallest = np.full(len(sets), len(sets))
    np.minimum.at(smallest, component, np.arange(len(sets)))
    return smallest[component].tolist()
