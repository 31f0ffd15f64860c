"""Trees as records, and the split search over histograms.

One routing rule holds everywhere: a value below the threshold goes left, a
missing one goes where the node says.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

from ..plans.params import Params

NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()), T.StructField("node_id", T.IntegerType()), T.StructField("class_idx", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()), T.StructField("cat_left", T.ArrayType(T.DoubleType())), T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()), T.StructField("default_left", T.BooleanType()), T.StructField("leaf_value", T.DoubleType()), T.StructField("leaf_vector", T.ArrayType(T.DoubleType())),
    T.StructField("gain", T.DoubleType()), T.StructField("sum_grad", T.DoubleType()), T.StructField("sum_hess", T.DoubleType()), T.StructField("tree_weight", T.DoubleType()),
])


@dataclass
class Node:
    depth: int = 0
    feature: int = -1
    threshold: float = 0.0
    cat_left: list[float] | None = None
    left: int = -1
    right: int = -1
    default_left: bool = True
    value: float = 0.0
    vector: list[float] | None = None
    gain: float = 0.0
    g: float = 0.0
    h: float = 0.0
    bin: int = 0
    group: int = -1
    cat_bins: list | None = None

    @property
    def is_leaf(self) -> bool:
        return self.left < 0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=lambda: [Node()])
    class_idx: int = 0
    weight: float = 1.0

    def split(self, k: int, best: Split, cuts: list[np.ndarray]) -> tuple[int, int]:
        """Make node k an inner node; returns its children."""
        n, at = self.nodes[k], len(self.nodes)
        n.feature, n.gain, n.default_left, n.bin = best.feature, best.gain, best.default_left, best.bin
        n.threshold = best.threshold if best.threshold is not None else float(cuts[best.feature][best.bin])
        n.cat_left, n.left, n.right = best.cat_left, at, at + 1
        self.nodes += [Node(n.depth + 1, g=best.gl, h=best.hl, group=n.group), Node(n.depth + 1, g=n.g - best.gl, h=n.h - best.hl, group=n.group)]
        return at, at + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf index of every row of a float matrix; NaN is missing."""
        at = np.zeros(len(x), np.int64)
        feature = np.array([n.feature for n in self.nodes])
        left, right = np.array([n.left for n in self.nodes]), np.array([n.right for n in self.nodes])
        threshold, default = np.array([n.threshold for n in self.nodes]), np.array([n.default_left for n in self.nodes])
        cats = {k: np.array(n.cat_left) for k, n in enumerate(self.nodes) if n.cat_left is not None}
        live = np.arange(len(x)) if left[0] >= 0 else np.zeros(0, np.int64)
        while len(live):
            k = at[live]
            v = x[live, feature[k]]
            go = np.where(np.isnan(v), default[k], v < threshold[k])
            for c, own in cats.items():
                here = k == c
                if here.any():
                    go[here] = np.where(np.isnan(v[here]), default[c], np.isin(v[here], own))
            at[live] = np.where(go, left[k], right[k])
            live = live[left[at[live]] >= 0]
        return at

    def values(self) -> np.ndarray:
        return np.array([n.vector for n in self.nodes]) if self.nodes[0].vector is not None else np.array([n.value for n in self.nodes])


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    gl: float
    hl: float
    default_left: bool
    threshold: float | None = None
    cat_left: list[float] | None = None


def leaf_value(g: float, h: float, c: Params) -> float:
    d = h + c.lambda_
    if d <= 0:
        return 0.0
    w = -g / d
    w = np.sign(w) * max(abs(w) - c.alpha / d, 0.0)
    return float(np.clip(w, -c.max_delta_step, c.max_delta_step)) if c.max_delta_step else float(w)


def _part(g: np.ndarray, h: np.ndarray, c: Params) -> np.ndarray:
    t = np.sign(g) * np.maximum(np.abs(g) - c.alpha, 0) if c.alpha else g
    d = h + c.lambda_
    if c.lambda_ > 0:  # hessian sums aren't negative
        return t * t / d
    return np.where(d > 0, t * t / np.where(d > 0, d, 1), 0.0)


def best_splits(hist: np.ndarray, g: np.ndarray, h: np.ndarray, c: Params, allowed: list[list[int]], sizes: list[int], values: list[np.ndarray] | None = None) -> list[Split | None]:
    """The split of each node from its histogram (node, [g, h, n], feature, bin).

    The last bin holds the missing rows. Both directions are tried for them, left
    on ties; among equal gains the first feature and the first bin win. ``values``
    gives a feature's bin values for categories and for exact growth. Only bins with
    rows are compared: a split after an empty bin is that after the last one with rows.
    After a feature's last bin only the missing rows are left; exact growth, whose
    thresholds lie between two values of the node, has no such split.
    """
    nodes, _, features, width = hist.shape
    parent = _part(g, h, c)
    own, miss = hist[..., :-1], hist[..., -1]
    plain = [f for f in range(features) if sizes[f] >= 2 and f not in c.categorical]
    usable = np.zeros((nodes, features), bool)
    for k, fs in enumerate(allowed):
        usable[k, plain if len(fs) == features else [f for f in fs if f in plain]] = True
    here = own[:, 2] > 0
    if c.tree_method == "exact":
        here &= np.cumsum(here[..., ::-1], -1)[..., ::-1] > 1
    here &= usable[:, :, None]
    cells = np.flatnonzero(here)
    node, rest = np.divmod(cells, max(features * (width - 1), 1))
    feature, bin_ = np.divmod(rest, max(width - 1, 1))
    column = node * features + feature
    many = np.bincount(column, minlength=nodes * features)
    place = np.arange(len(cells)) - (np.cumsum(many) - many)[column]
    packed = np.zeros((3, nodes * features, many.max(initial=0)))  # bins with rows, moved up to each other
    for i in range(3):
        packed[i, column, place] = own[node, i, feature, bin_]
    left_g, left_h, left_n = (x[column, place] for x in np.cumsum(packed, 2))
    total = (own[:, 2].sum(2) + miss[:, 2])[node, feature]
    gn, hn, pn = g[node], h[node], parent[node]
    signs = np.array([c.monotone.get(f, 0) for f in range(features)])[feature] if any(c.monotone.values()) else None
    some = miss[:, 2].any()
    best_gain, sides = None, []
    for left in (True, False) if some else (True,):
        a = left_g + miss[node, 0, feature] if left and some else left_g
        b = left_h + miss[node, 1, feature] if left and some else left_h
        n = left_n + miss[node, 2, feature] if left and some else left_n
        gr, hr = gn - a, hn - b
        ok = (b >= c.min_child_weight) & (hr >= c.min_child_weight) & (total - n > 0)
        gain = _part(a, b, c) + _part(gr, hr, c) - pn
        if signs is not None:
            ok &= signs * (a * (hr + c.lambda_) - gr * (b + c.lambda_)) >= 0
        gain = np.where(ok, gain, -1.0)
        sides.append((gain, a, b))
        best_gain = gain if best_gain is None else np.maximum(best_gain, gain)
    ends = np.searchsorted(node, np.arange(nodes + 1))
    out: list[Split | None] = []
    for k in range(nodes):
        best, mine = None, best_gain[ends[k] : ends[k + 1]]
        top = mine.max() if len(mine) else -1.0
        if top > max(c.gamma, 0.0):
            at = int(ends[k]) + int(np.argmax(mine >= top * (1 - 1e-12)))
            f, b = int(feature[at]), int(bin_[at])
            near = [i for i, s in enumerate(sides) if s[0][at] >= top * (1 - 1e-12)]
            gain, a, w = sides[near[0]]
            best = Split(float(gain[at]), f, b, float(a[at]), float(w[at]), near[0] == 0)
            if values is not None and c.tree_method == "exact":
                after = b + 1 + int(np.argmax(own[k, 2, f, b + 1 :] > 0))
                best.threshold = float((values[f][b] + values[f][min(after, len(values[f]) - 1)]) / 2)
        for f in c.categorical:
            if f in allowed[k] and sizes[f] >= 2 and (found := _categorical(own[k, :, f, : sizes[f]].T, miss[k, :, f], g[k], h[k], float(parent[k]), c, f, values[f])):
                if found.gain > max(c.gamma, best.gain if best else 0.0) * (1 + 1e-12):
                    best = found
        out.append(best)
    return out


def _categorical(own: np.ndarray, miss: np.ndarray, g: float, h: float, parent: float, c: Params, f: int, values: np.ndarray) -> Split | None:
    """One category against the rest, or a prefix of the categories by g / h."""
    there = np.flatnonzero(own[:, 2] > 0)
    if len(there) < 2:
        return None
    best = None
    if len(there) <= c.max_cat_to_onehot:
        sets = [there[[k]] for k in range(len(there))]
    else:
        order = there[np.argsort(own[there, 0] / (own[there, 1] + 1e-10), kind="stable")]
        sets = [order[:k] for k in range(1, len(order))]
    for s in sets:
        for left in (True, False):
            a, b = own[s, 0].sum() + (miss[0] if left else 0), own[s, 1].sum() + (miss[1] if left else 0)
            if b < c.min_child_weight or h - b < c.min_child_weight:
                continue
            gain = float(_part(a, b, c) + _part(g - a, h - b, c) - parent)
            if gain > (best.gain if best else 0.0) * (1 + 1e-12):
                best = Split(gain, f, int(s[0]), float(a), float(b), left, 0.0, sorted(values[s].tolist()))
    return best
