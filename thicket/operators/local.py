"""Whole fits on one machine's numpy arrays.

The same split search as on the cluster, for data under a checked size and for
the many models of cross-validation and search, which Spark fits side by side.
"""

from __future__ import annotations

import heapq

import numpy as np

from ..functions.expressions import logit
from ..functions.metrics import higher_is_better, np_metric
from ..functions.objectives import np_gradient, np_link
from ..plans.params import Params
from . import sampling
from .flat import Flat
from .quantize import bin_matrix, cuts_of
from .tree import Split, Tree, best_splits, leaf_value


#: Histogram cells (nodes x features x bins) that are searched at once.
LEVEL_CELLS = 4_000_000


def base_margin(c: Params, y: np.ndarray) -> float:
    """The start of every margin: from the mean label where the objective defines it."""
    if c.objective in ("binary:logistic", "binary:logitraw"):
        return logit(float(np.mean(y > 0))) if c.boost_from_average else logit(c.base_score)
    if not c.boost_from_average:
        return c.base_score
    mean = float(np.mean(y)) if len(y) else 0.0
    if c.objective == "reg:squarederror":
        return mean
    if c.objective == "reg:logistic":
        return mean if c.compat else logit(mean)
    return c.base_score


class Bins:
    """Cuts and bins of a matrix; for exact growth every distinct value is a bin."""

    def __init__(self, x: np.ndarray, h: np.ndarray, c: Params):
        self.values: list[np.ndarray] | None = None
        if c.tree_method == "exact" or c.categorical:
            self.values = [np.unique(col[~np.isnan(col)]) for col in x.T]
        self.cuts = []
        for f, col in enumerate(x.T):
            there = ~np.isnan(col)
            if c.tree_method == "exact" or f in c.categorical:
                self.cuts.append(self.values[f][1:] if len(self.values[f]) else np.zeros(0))
            else:
                v, at = np.unique(col[there & (h > 0)].astype(np.float32), return_inverse=True)
                self.cuts.append(cuts_of(v.astype(np.float64), np.bincount(at, h[there & (h > 0)], minlength=len(v)), c.max_bin))
        full = c.tree_method == "exact"
        self.sizes = [len(v) if full or f in c.categorical else len(self.cuts[f]) for f, v in enumerate(self.values or self.cuts)]
        self.width = max([1, *self.sizes]) + 1
        self.bins = bin_matrix(x, [np.append(k, np.inf) if full or f in c.categorical else k for f, k in enumerate(self.cuts)])
        self.features = x.shape[1]
        self.flat = np.where(self.bins < 0, self.width - 1, self.bins) + np.arange(x.shape[1]) * self.width

    def histograms(self, groups: list[np.ndarray], g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(group, [g, h, n], feature, bin) of groups of rows; the last bin is for missing rows."""
        rows = np.concatenate(groups)
        size = self.features * self.width
        at = (self.flat[rows] + np.repeat(np.arange(len(groups)) * size, [len(x) for x in groups])[:, None]).ravel()
        parts = [np.bincount(at, np.repeat(v[rows], self.features), minlength=size * len(groups)) for v in (g, h, n)]
        return np.stack([p.reshape(len(groups), self.features, self.width) for p in parts], 1)


def allowed_features(c: Params, mask: list[int], group: int) -> list[int]:
    """Features a node may split on, given the interaction group of its path."""
    if not c.interactions:
        return mask
    owner = {f: k for k, fs in enumerate(c.interactions) for f in fs}
    return [f for f in mask if f not in owner or group < 0 or owner[f] == group]


def path_group(c: Params, feature: int, group: int) -> int:
    owner = {f: k for k, fs in enumerate(c.interactions) for f in fs}
    return owner.get(feature, group)


def grow(b: Bins, g: np.ndarray, h: np.ndarray, n: np.ndarray, mask: list[int], c: Params, seed: int = 0) -> tuple[Tree, np.ndarray]:
    """One tree (level by level, or best leaf first) and each row's node.

    ``n`` is a row's multiplicity; g and h include it. Rows with n = 0 are routed
    but don't count. The larger child's histogram is its parent's less its sister's.
    """
    tree = Tree()
    root = tree.nodes[0]
    node_of = np.zeros(len(g), np.int64)
    use = np.flatnonzero(n > 0)
    root.g, root.h = float(g[use].sum()), float(h[use].sum())

    def find(items: list[tuple], level: list[int]) -> list[Split | None]:
        if not items:
            return []
        own = [sampling.sample_columns(level, c.colsample_bynode, seed * 7919 + k * 31 + 7) if c.colsample_bynode < 1 else level for k, _, _ in items]
        may = [allowed_features(c, fs, tree.nodes[k].group) for fs, (k, _, _) in zip(own, items, strict=True)]
        gs, hs = np.array([tree.nodes[k].g for k, _, _ in items]), np.array([tree.nodes[k].h for k, _, _ in items])
        return best_splits(np.stack([hist for _, _, hist in items]), gs, hs, c, may, b.sizes, b.values)

    def part(items: list[tuple], found: list[Split | None]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        made = []
        for (k, rows, hist), best in zip(items, found, strict=True):
            if best is None:
                continue
            node = tree.nodes[k]
            left, right = tree.split(k, best, b.cuts)
            node.group = path_group(c, best.feature, node.group)
            tree.nodes[left].group = tree.nodes[right].group = node.group
            every = rows if whole else np.flatnonzero(node_of == k)
            node_of[every] = np.where(_goes_left(b, every, best), left, right)
            goes = node_of[rows] == left
            made.append((left, rows[goes], right, rows[~goes], hist))
        if not made:
            return []
        small = b.histograms([x if len(x) <= len(z) else z for _, x, _, z, _ in made], g, h, n)
        out = []
        for (left, x, right, z, hist), own in zip(made, small, strict=True):
            rest = hist - own
            np.maximum(rest[1], 0, out=rest[1])
            np.rint(rest[2], out=rest[2])
            pair = (own, rest) if len(x) <= len(z) else (rest, own)
            for child, rows, mine in ((left, x, pair[0]), (right, z, pair[1])):
                tree.nodes[child].g, tree.nodes[child].h = float(g[rows].sum()), float(h[rows].sum())
                out.append((child, rows, mine))
        return out

    whole = len(use) == len(g)
    first = (0, use, b.histograms([use], g, h, n)[0])
    if c.max_leaves:
        level = sampling.sample_columns(mask, c.colsample_bylevel, seed * 7919)
        heap: list = []

        def offer(items: list[tuple]) -> None:
            items = [x for x in items if len(x[1]) > 1 and (not c.max_depth or tree.nodes[x[0]].depth < c.max_depth)]
            for (k, rows, hist), best in zip(items, find(items, level), strict=True):
                if best:
                    heapq.heappush(heap, (-best.gain, k, rows, hist, best))

        offer([first])
        leaves = 1
        while heap and leaves < c.max_leaves:
            _, k, rows, hist, best = heapq.heappop(heap)
            offer(part([(k, rows, hist)], [best]))
            leaves += 1
    else:
        frontier = [first]
        for depth in range(c.max_depth):
            level = sampling.sample_columns(mask, c.colsample_bylevel, seed * 7919 + depth)
            frontier = [x for x in frontier if len(x[1]) > 1]
            step = max(1, LEVEL_CELLS // (b.features * b.width))
            after = []
            for i in range(0, len(frontier), step):
                after += part(frontier[i : i + step], find(frontier[i : i + step], level))
            frontier = after
    for node in tree.nodes:
        if node.is_leaf:
            node.value = leaf_value(node.g, node.h, c)
    return tree, node_of


def _goes_left(b: Bins, rows: np.ndarray, s: Split) -> np.ndarray:
    own = b.bins[rows, s.feature]
    if s.cat_left is not None:
        inside = np.isin(b.values[s.feature], s.cat_left)
        return np.where(own < 0, s.default_left, np.append(inside, False)[own])
    return np.where(own < 0, s.default_left, own <= s.bin)


def choose_dropped(trees: list[Tree], c: Params, seed: int) -> list[int]:
    """Indices of the trees that a dart round leaves out."""
    n = len(trees)
    u = sampling.draws(seed, n + 2)
    if not n or u[0] < c.skip_drop:
        return []
    if c.sample_type == "weighted":
        w = np.array([t.weight for t in trees])
        p = c.rate_drop * w * n / max(w.sum(), 1e-12)
    else:
        p = np.full(n, c.rate_drop)
    out = np.flatnonzero(u[2:] < p).tolist()
    return out or ([int(u[1] * n)] if c.one_drop else [])


def dart_weights(trees: list[Tree], dropped: list[int], new: list[Tree], c: Params) -> None:
    """Scale new and dropped trees as in the DART paper (Rashmi and Gilad-Bachrach, 2015)."""
    k = len(dropped)
    if c.normalize_type == "tree":
        fresh, factor = 1 / (k + c.eta), k / (k + c.eta)
    else:
        fresh, factor = 1 / (1 + c.eta), 1 / (1 + c.eta)
    for t in new:
        t.weight *= fresh if k else 1.0
    for d in dropped:
        trees[d].weight *= factor


class LocalData:
    """Columns in numpy; ``key`` holds a hash of each row's id, which row sampling follows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, margin: np.ndarray | None = None, group: np.ndarray | None = None, key: np.ndarray | None = None):
        self.x, self.y, self.w, self.margin, self.group = np.asarray(x, float), np.asarray(y, float), w, margin, group
        self.key = sampling.hash_long(np.arange(len(self.y)), np.uint64(42)).view(np.int64) if key is None else key


def margins(trees: list[Tree], x: np.ndarray, c: Params, base: float, start: np.ndarray | None = None, flat: Flat | None = None) -> np.ndarray:
    k = c.classes
    out = np.full((len(x), k), base)
    if start is not None:
        out = start.reshape(len(x), -1) + np.zeros((1, k))
    if trees and all(t.nodes[0].vector is None for t in trees):
        flat = flat or Flat(trees)
        at = flat.leaves(x)
        for cls in range(k):
            own = np.flatnonzero(flat.classes == cls)
            out[:, cls] += c.eta * (flat.value[at[:, own]] @ flat.weight[own])
    else:
        for t in trees:
            out[:, t.class_idx] += c.eta * t.weight * t.values()[t.leaves(x)]
    return out if k > 1 else out[:, 0]


def fit(data: LocalData, c: Params, trees: list[Tree] | None = None, base: float | None = None, valid: LocalData | None = None, metrics: tuple[str, ...] = ()) -> tuple[list[Tree], float, list[dict]]:
    """Trees, base margin and history; ``trees`` and ``base`` continue a model."""
    x, y, w, k = data.x, data.y, data.w, c.classes
    if c.objective in ("binary:logistic", "binary:logitraw"):
        y = (y > 0).astype(float)
    trees = list(trees or [])
    done = len(trees) // (k * c.num_parallel_tree)
    if base is None:
        base = base_margin(c, y)
    m = margins(trees, x, c, base, data.margin)
    vm = margins(trees, valid.x, c, base, valid.margin) if valid is not None else None
    h0 = np_gradient(c, margins([], x, c, base, data.margin), y, w, data.group)[1]
    bins = Bins(x, h0[:, 0] if h0.ndim == 2 else h0, c)
    features, history, best = list(range(x.shape[1])), [], None
    names = tuple(metrics) or c.eval_metric
    for it in range(done, done + c.num_trees):
        dropped: list[int] = []
        if c.booster == "dart" and trees:
            dropped = choose_dropped(trees, c, sampling.derive_seed(c.seed, it, 7))
            if dropped:
                m = margins([t for i, t in enumerate(trees) if i not in set(dropped)], x, c, base, data.margin)
        g_all, h_all = np_gradient(c, m, y, w, data.group)
        new = []
        for cls in range(k):
            g, h = (g_all[:, cls], h_all[:, cls]) if k > 1 else (g_all, h_all)
            for p in range(c.num_parallel_tree):
                seed = sampling.derive_seed(c.seed, it * k + cls + p * 1000, p)
                if c.sampling_method == "gradient_based" and c.subsample < 1 and c.num_parallel_tree == 1:
                    n = sampling.sample_by_gradient(g, c.subsample, sampling.derive_seed(c.seed, it * k + cls, 0))
                else:
                    n = np.ones(len(y), np.int64)
                    if c.subsample < 1:
                        n = (sampling.uniforms(data.key, sampling.derive_seed(c.seed, it * k + cls, 0)) < c.subsample).astype(np.int64)
                    if c.num_parallel_tree > 1:  # each tree of a forest draws its own rows
                        n = n * sampling.copies_of(sampling.uniforms(data.key, sampling.derive_seed(c.seed, it * k + cls, 100 + p)))
                mask = sampling.sample_columns(features, c.colsample_bytree, sampling.derive_seed(c.seed, it * k + cls + p * 1000, 1 + (100 if p else 0)), c.feature_weights)
                tree, node_of = grow(bins, g * n, h * n, n.astype(float), mask, c, seed & 0xFFFF)
                tree.class_idx, tree.weight = cls, 1.0 / c.num_parallel_tree
                if c.refresh_leaf:
                    refresh(tree, node_of, g, h, c)
                new.append((tree, node_of))
        if dropped or c.booster == "dart":
            dart_weights(trees, dropped, [t for t, _ in new], c)
        for tree, node_of in new:
            step = c.eta * tree.weight * tree.values()[node_of]
            if k > 1:
                m[:, tree.class_idx] += step
            else:
                m = m + step
            trees.append(tree)
            if vm is not None:
                more = c.eta * tree.weight * tree.values()[tree.leaves(valid.x)]
                if k > 1:
                    vm[:, tree.class_idx] += more
                else:
                    vm = vm + more
        if dropped:
            m = margins(trees, x, c, base, data.margin)
            vm = margins(trees, valid.x, c, base, valid.margin) if valid is not None else None
        row = {"iteration": it}
        for name in names:
            row[f"train-{name}"] = evaluate(name, m, y, c, data.group)
            if valid is not None:
                row[f"valid-{name}"] = evaluate(name, vm, valid.y, c, valid.group)
        if c.custom_metric is not None:
            row["train-custom"] = float(c.custom_metric(m, y)[1])
        history.append(row)
        if c.early_stopping_rounds and valid is not None and names:
            score = row[f"valid-{names[0]}"]
            up = higher_is_better(names[0])
            if best is None or (score > best[0] if up else score < best[0]):
                best = (score, it, len(trees))
            if it - best[1] >= c.early_stopping_rounds:
                trees = trees[: best[2]]
                break
        if any(call(it, history, m) for call in c.callbacks):
            break
    return trees, base, history


def refresh(tree: Tree, node_of: np.ndarray, g: np.ndarray, h: np.ndarray, c: Params) -> None:
    """Leaf values from all rows, also those the tree was not grown on."""
    n = len(tree.nodes)
    gs, hs = np.bincount(node_of, g, minlength=n), np.bincount(node_of, h, minlength=n)
    for k in range(n - 1, -1, -1):
        node = tree.nodes[k]
        if not node.is_leaf:
            gs[k], hs[k] = gs[node.left] + gs[node.right], hs[node.left] + hs[node.right]
        node.g, node.h = float(gs[k]), float(hs[k])
        if node.is_leaf:
            node.value = leaf_value(node.g, node.h, c)


def evaluate(name: str, m: np.ndarray, y: np.ndarray, c: Params, group: np.ndarray | None = None) -> float:
    """A metric on linked predictions (on margins if asked, or where it is defined on them)."""
    if c.on_margin or name.startswith("cox"):
        p = m
    elif name.split("@")[0] in ("merror", "mlogloss"):
        p = np_link(c.with_(objective="multi:softprob"), m)
    else:
        p = np_link(c, m)
    return np_metric(name, p, y, group, c.tweedie_variance_power)
