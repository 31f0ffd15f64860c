"""All trees of a model as flat arrays, so that one walk serves all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .tree import Tree

#: Row and tree pairs that a walk holds at once.
CELLS = 1 << 18


class Flat:
    """Node arrays of all trees, one after the other; leaves lead to themselves."""

    def __init__(self, trees: list[Tree]):
        nodes = [n for t in trees for n in t.nodes]
        sizes = np.array([len(t.nodes) for t in trees], np.int64)
        self.root = np.cumsum(sizes) - sizes if len(trees) else np.zeros(0, np.int64)
        start = np.repeat(self.root, sizes)
        left = np.array([n.left for n in nodes], np.int64)
        own = np.arange(len(nodes))
        self.leaf = left < 0
        self.left = np.where(self.leaf, own, left + start)
        self.right = np.where(self.leaf, own, np.array([n.right for n in nodes], np.int64) + start)
        self.feature = np.where(self.leaf, 0, np.array([n.feature for n in nodes], np.int64))
        self.threshold = np.where(self.leaf, np.inf, np.array([n.threshold for n in nodes], float))
        self.default = np.array([n.default_left for n in nodes], bool) | self.leaf
        self.child = np.stack((self.right, self.left), 1).ravel()  # by 2 * node + goes left
        self.depth, at, self.deepest = np.zeros(len(nodes), np.int64), self.root, 0
        while len(at := at[~self.leaf[at]]):  # imported nodes don't say how deep they are
            at = np.concatenate((self.left[at], self.right[at]))
            self.deepest += 1
            self.depth[at] = self.deepest
        self.value = np.array([n.value for n in nodes], float)
        self.cover = np.array([n.h for n in nodes], float)
        self.tree = np.repeat(np.arange(len(trees)), sizes)
        self.weight = np.array([t.weight for t in trees], float)
        self.classes = np.array([t.class_idx for t in trees], np.int64)
        self.cats = {k: np.array(n.cat_left) for k, n in enumerate(nodes) if n.cat_left is not None}
        for tree in np.unique(self.tree[self.cover <= 0]):  # a model without cover: leaves count alike
            inside = self.tree == tree
            self.cover[inside] = np.where(self.leaf[inside], 1.0, 0.0)
            for d in range(self.deepest - 1, -1, -1):
                k = np.flatnonzero(inside & ~self.leaf & (self.depth == d))
                self.cover[k] = self.cover[self.left[k]] + self.cover[self.right[k]]

    def goes_left(self, x: np.ndarray, at: np.ndarray, gaps: bool) -> np.ndarray:
        """The decision of rows (first axis of ``at``) at nodes."""
        place = self.feature[at]
        place += (np.arange(len(x)) * x.shape[1])[:, None]
        v = x.ravel()[place]
        go = v < self.threshold[at]
        for k, cats in self.cats.items():
            here = at == k
            go[here] = np.isin(v[here], cats)
        return np.where(np.isnan(v), self.default[at], go) if gaps else go

    def steps(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """For blocks of rows and each level: the nodes (rows x trees) before and after."""
        gaps, block = bool(np.isnan(x).any()), max(1, CELLS // max(1, len(self.root)))
        for i in range(0, len(x), block):
            rows = slice(i, min(len(x), i + block))
            at = np.broadcast_to(self.root, (rows.stop - i, len(self.root)))
            if not self.deepest:
                yield rows, at, at
            for _ in range(self.deepest):
                after = self.child[2 * at + self.goes_left(x[rows], at, gaps)]
                yield rows, at, after
                at = after

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node that each tree puts a row into (rows x trees, counted over all trees)."""
        out = np.empty((len(x), len(self.root)), np.int64)
        for rows, _, after in self.steps(x):
            out[rows] = after
        return out

    def means(self) -> np.ndarray:
        """The expectation of the leaf values below each node."""
        out = np.where(self.leaf, self.value, 0.0)
        for d in range(self.deepest - 1, -1, -1):
            k = np.flatnonzero(~self.leaf & (self.depth == d))
            a, b = self.left[k], self.right[k]
            out[k] = (self.cover[a] * out[a] + self.cover[b] * out[b]) / (self.cover[a] + self.cover[b])
        return out
