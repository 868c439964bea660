"""A signature tree over token sets: components of the sets whose Jaccard similarity reaches a threshold.

A leaf holds a few sets that stand next to each other by size and least token; a node has the OR of its sets'
token bitmaps, their range of sizes and the most tokens by which a set exceeds its bitmap's bits. Two nodes are
traversed together only if some pair below them can reach the overlap that the sizes demand, and only while
their sets are not all in one component: a group of near copies costs about one comparison a set.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 16, 8
#: Bits of a bitmap: four a token, within these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 16


def bitmap_bits(largest: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << int(4 * max(largest, 1) - 1).bit_length()))


class SignatureTree:
    """sets: sorted arrays of the tokens that count for overlaps; sizes: the whole sets' sizes, at least as large."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray | None = None, share: tuple[int, int] = (75, 100), bits: int = 0):
        self.sets, self.sizes, self.share = sets, np.asarray(sizes, np.int64), share
        k = len(sets)
        self.labels = np.arange(k) if labels is None else labels
        bits = bits or bitmap_bits(max(map(len, sets), default=1))
        self.maps = np.zeros((k, bits // 64), np.uint64)
        for j, s in enumerate(sets):
            row = np.zeros(bits, bool)
            row[(s % np.uint64(bits)).astype(np.int64)] = True
            self.maps[j] = np.packbits(row, bitorder="little").view(np.uint64)
        self.excess = np.array([len(s) for s in sets], np.int64) - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        level = np.floor(np.log(np.maximum(self.sizes, 1)) / np.log(share[1] / share[0]))
        least = np.array([s[(s * np.uint64(0x9E3779B97F4A7C15)).argmin()] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((self.sizes, least, level))
        self._build()

    def _build(self) -> None:
        """Nodes, leaves first: ranges of `order`, then children ranges of nodes."""
        k, o = len(self.sets), self.order
        self.low, self.high, self.kids, self.maps_or, self.least, self.most, self.over = [], [], [], [], [], [], []
        level = []
        for a in range(0, k, LEAF):
            mine = o[a : a + LEAF]
            level.append(self._node(a, min(a + LEAF, k), (), np.bitwise_or.reduce(self.maps[mine], 0), self.sizes[mine].min(), self.sizes[mine].max(), self.excess[mine].max()))
        while len(level) > 1:
            up = []
            for a in range(0, len(level), FAN):
                c = level[a : a + FAN]
                up.append(self._node(self.low[c[0]], self.high[c[-1]], tuple(c), np.bitwise_or.reduce([self.maps_or[x] for x in c], 0), min(self.least[x] for x in c), max(self.most[x] for x in c), max(self.over[x] for x in c)))
            level = up
        self.root = level[0] if level else None

    def _node(self, low, high, kids, maps, least, most, over) -> int:
        for column, value in zip((self.low, self.high, self.kids, self.maps_or, self.least, self.most, self.over), (low, high, kids, maps, int(least), int(most), int(over)), strict=True):
            column.append(value)
        return len(self.low) - 1

    def _may_link(self, a: int, b: int) -> bool:
        """Whether some pair below two nodes can reach the threshold."""
        p, q = self.share
        if q * self.most[a] < p * self.least[b] or q * self.most[b] < p * self.least[a]:
            return False
        overlap = int(np.bitwise_count(self.maps_or[a] & self.maps_or[b]).sum()) + min(self.over[a], self.over[b])
        return (p + q) * overlap >= p * (self.least[a] + self.least[b])

    def _same(self, a: int, b: int) -> bool:
        """Whether all sets below two nodes are in one component."""
        x, y = self.labels[self.order[self.low[a] : self.high[a]]], self.labels[self.order[self.low[b] : self.high[b]]]
        return bool((x == x[0]).all() and (y == x[0]).all())

    def linked(self, i: int, j: int) -> bool:
        p, q = self.share
        both = np.intersect1d(self.sets[i], self.sets[j], assume_unique=True).size
        return both > 0 and q * both >= p * (self.sizes[i] + self.sizes[j] - both)

    def _leaves(self, a: int, b: int) -> None:
        p, q = self.share
        left, right = self.order[self.low[a] : self.high[a]], self.order[self.low[b] : self.high[b]]
        common = np.bitwise_count(self.maps[left][:, None] & self.maps[right][None]).sum(2, dtype=np.int64)
        common += np.minimum(self.excess[left][:, None], self.excess[right][None])
        total = self.sizes[left][:, None] + self.sizes[right][None]
        able = (p + q) * common >= p * total
        if a == b:
            able &= np.arange(len(left))[:, None] < np.arange(len(left))[None]
        for x, y in np.argwhere(able):
            i, j = left[x], right[y]
            one, other = self.labels[i], self.labels[j]
            if one != other and self.linked(i, j):
                self.labels[self.labels == max(one, other)] = min(one, other)

    def join(self) -> np.ndarray:
        """Labels of the components among all sets."""
        if self.root is None:
            return self.labels
        todo = [(self.root, self.root)]
        while todo:
            a, b = todo.pop()
            if self._same(a, b) or a != b and not self._may_link(a, b):
                continue
            if not self.kids[a] and not self.kids[b]:
                self._leaves(a, b)
            elif a == b:
                kids = self.kids[a]
                todo += [(x, y) for k, x in enumerate(kids) for y in kids[k + 1 :]] + [(x, x) for x in kids]
            elif self.kids[a] and (not self.kids[b] or self.high[a] - self.low[a] >= self.high[b] - self.low[b]):
                todo += [(x, b) for x in self.kids[a]]
            else:
                todo += [(a, x) for x in self.kids[b]]
        return self.labels
