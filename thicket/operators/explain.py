"""Attributions, importance and partial dependence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .booster import Booster
from .tree import Tree


def importance(model: Booster, spark: SparkSession, kind: str = "weight") -> DataFrame:
    """(feature, name, score) by number of splits, total gain or total cover."""
    score = {"weight": F.count(F.lit(1)).cast("double"), "gain": F.sum("gain"), "cover": F.sum("sum_hess")}[kind]
    names = F.array(*[F.lit(n) for n in model.features])
    used = model.nodes(spark).where("feature >= 0").groupBy("feature").agg(score.alias("score"))
    return used.select("feature", F.element_at(names, F.col("feature") + 1).alias("name"), "score")


def importance_ranking(model: Booster, spark: SparkSession, kind: str = "gain") -> DataFrame:
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "feature")
    return importance(model, spark, kind).withColumn("rank", F.row_number().over(order))


def leaf_magnitude(model: Booster, spark: SparkSession) -> DataFrame:
    return model.nodes(spark).where("left < 0").groupBy("tree_id").agg(F.sum(F.abs("leaf_value")).alias("magnitude"))


def partial_dependence(model: Booster, df: DataFrame, feature: str, points: int = 50) -> DataFrame:
    """(value, mean, low, high, n): mean prediction over all rows at each grid value.

    The band is 1.96 standard errors (population deviation). A constant feature has
    one point without a band. The grid is a small literal table next to the rows.
    """
    x = F.col(f"`{feature}`").cast("double")
    low, high = df.agg(F.min(F.when(~F.isnan(x), x)), F.max(F.when(~F.isnan(x), x))).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "value double, mean double, low double, high double, n long")
    grid = [low] if low == high or points < 2 else [low + i * (high - low) / (points - 1) for i in range(points)]
    at = df.withColumn("__v", F.explode(F.array(*[F.lit(float(v)) for v in grid]))).drop(feature).withColumnRenamed("__v", feature)
    scored = model.predict(at.select(*model.features), out="__p")
    band = F.lit(1.96) * F.stddev_pop("__p") / F.sqrt(F.count(F.lit(1)))
    out = scored.groupBy(F.col(feature).alias("value")).agg(F.avg("__p").alias("mean"), band.alias("band"), F.count(F.lit(1)).alias("n"))
    if len(grid) == 1:
        return out.select("value", "mean", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "n")
    return out.select("value", "mean", (F.col("mean") - F.col("band")).alias("low"), (F.col("mean") + F.col("band")).alias("high"), "n")


def learning_curve(history: list[dict], spark: SparkSession, metric: str = "") -> DataFrame:
    """(iteration, metric, value), of one metric or all."""
    rows = [(h["iteration"], k, float(v)) for h in history for k, v in h.items() if k != "iteration" and (not metric or k == metric)]
    return spark.createDataFrame(rows, "iteration int, metric string, value double")


def best_iteration(history: list[dict], metric: str) -> tuple[int, float]:
    """The first best round by the metric's own direction; (-1, 0) for none."""
    from ..functions.metrics import higher_is_better

    own = [(h["iteration"], h[metric]) for h in history if metric in h]
    if not own:
        return -1, 0.0
    up = higher_is_better(metric.split("-", 1)[-1])
    return max(own, key=lambda x: (x[1], -x[0])) if up else min(own, key=lambda x: (x[1], x[0]))


# ---- attributions ----


def _go_left(tree: Tree, k: int, x: np.ndarray) -> bool:
    n = tree.nodes[k]
    v = x[n.feature]
    if math.isnan(v):
        return n.default_left
    return v in n.cat_left if n.cat_left is not None else v < n.threshold


def _weights(tree: Tree) -> np.ndarray:
    """Cover of each node; where a model has none, leaves count alike."""
    h = np.array([n.h for n in tree.nodes], float)
    if (h <= 0).any():
        h = np.zeros(len(tree.nodes))
        for k in range(len(h) - 1, -1, -1):
            n = tree.nodes[k]
            h[k] = 1.0 if n.is_leaf else h[n.left] + h[n.right]
    return h


def tree_expectation(tree: Tree) -> float:
    h, v = _weights(tree), np.zeros(len(tree.nodes))
    order = sorted(range(len(h)), key=lambda k: -tree.nodes[k].depth)
    for k in order:
        n = tree.nodes[k]
        v[k] = n.value if n.is_leaf else (h[n.left] * v[n.left] + h[n.right] * v[n.right]) / (h[n.left] + h[n.right])
    return float(v[0])


def _leaf_paths(tree: Tree) -> list[tuple[float, list[tuple[int, float, list[tuple[int, bool]]]]]]:
    """For each leaf its value and, by feature, (feature, cover share, its decisions)."""
    h, out = _weights(tree), []

    def down(k: int, path: dict[int, tuple[float, list[tuple[int, bool]]]]) -> None:
        n = tree.nodes[k]
        if n.is_leaf:
            out.append((n.value, [(f, z, steps) for f, (z, steps) in path.items()]))
            return
        for child, left in ((n.left, True), (n.right, False)):
            z, steps = path.get(n.feature, (1.0, []))
            down(child, path | {n.feature: (z * h[child] / (h[n.left] + h[n.right]), [*steps, (k, left)])})

    down(0, {})
    return out


#: Path features up to which a leaf has a table of what each pattern adds, and
#: table cells that are made at once.
TABLE_FEATURES, TABLE_CELLS = 8, 1 << 22


class _LeafTables:
    """Leaves whose paths have the same number m of features, with a table for each.

    A row adds to a leaf's features what the table says for the pattern of features
    by which it follows the path. By the Shapley kernel as an integral over t in
    [0, 1], feature j adds (o_j - z_j) times the integral of prod(z_i (1 - t) + o_i t)
    over the other features; Gauss-Legendre nodes give the polynomial's exact value.
    """

    def __init__(self, leaves: list[tuple[int, float, list[tuple[int, float]]]], slots: list[list[int]]):
        m = len(leaves[0][2])
        self.at = np.array([k for k, _, _ in leaves])
        self.features = np.array([[f for f, _ in path] for _, _, path in leaves])
        self.slots = np.array(slots)
        zero = np.array([[z for _, z in path] for _, _, path in leaves])
        value = np.array([v for _, v, _ in leaves])
        t, w = np.polynomial.legendre.leggauss((m + 1) // 2)
        t, w = (t + 1) / 2, w / 2
        ones = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
        share = np.zeros((len(leaves), 1 << m, m))
        for x, y in zip(t, w, strict=True):
            part = zero[:, None, :] * (1 - x) + ones[None] * x
            share += y * part.prod(2, keepdims=True) / part
        share *= (ones[None] - zero[:, None, :]) * value[:, None, None]
        self.table = share.reshape(-1, m)

    def add(self, out: np.ndarray, missed: np.ndarray) -> None:
        """``missed`` (rows x nodes) has a bit for each feature that left a node's path."""
        rows, width = out.shape
        m = self.features.shape[1]
        code = np.zeros((rows, len(self.at)), np.int64)
        off = missed[:, self.at]
        for j in range(m):
            code |= ((~off >> self.slots[:, j].astype(np.uint64)) & np.uint64(1)).astype(np.int64) << j
        each = self.table[code + np.arange(len(self.at)) * (1 << m)]
        base = np.arange(rows)[:, None] * width
        for j in range(m):
            out += np.bincount((base + self.features[:, j]).ravel(), each[:, :, j].ravel(), minlength=out.size).reshape(out.shape)


def _tables(model: Booster, class_idx: int) -> tuple[list[_LeafTables], np.ndarray, list[tuple[Tree, float]]]:
    """Tables of the leaves, each node's feature as a bit of its tree, and trees without tables."""
    flat = model.flat()
    bit = np.zeros(len(flat.left), np.uint64)
    by_size: dict[int, tuple[list, list]] = {}
    rest = []
    share = np.ones(len(flat.left))
    inner = np.flatnonzero(~flat.leaf)
    for child in (flat.left, flat.right):
        share[child[inner]] = flat.cover[child[inner]] / (flat.cover[flat.left[inner]] + flat.cover[flat.right[inner]])
    left, right, feature, value = flat.left.tolist(), flat.right.tolist(), flat.feature.tolist(), flat.value.tolist()
    shares, is_leaf = share.tolist(), flat.leaf.tolist()
    for k, tree in enumerate(model.trees):
        if tree.class_idx != class_idx:
            continue
        scale = model.params.eta * tree.weight
        nodes = np.flatnonzero((flat.tree == k) & ~flat.leaf)
        own = {f: i for i, f in enumerate(np.unique(flat.feature[nodes]).tolist())}
        if len(own) > 64:
            rest.append((tree, scale))
            continue
        if len(nodes):
            bit[nodes] = np.uint64(1) << np.array([own[f] for f in flat.feature[nodes].tolist()], np.uint64)
        found, stack = [], [(int(flat.root[k]), {})]
        while stack:
            at, path = stack.pop()
            if is_leaf[at]:
                found.append((at, scale * value[at], list(path.items())))
                continue
            for child in (left[at], right[at]):
                stack.append((child, path | {feature[at]: path.get(feature[at], 1.0) * shares[child]}))
        if any(len(p) > TABLE_FEATURES or any(z <= 0 for _, z in p) for _, _, p in found):
            rest.append((tree, scale))
            continue
        for leaf in found:
            if leaf[2]:
                leaves, slots = by_size.setdefault(len(leaf[2]), ([], []))
                leaves.append(leaf)
                slots.append([own[f] for f, _ in leaf[2]])
    out = []
    for m, (leaves, slots) in sorted(by_size.items()):
        step = max(1, TABLE_CELLS // (m << m))
        out += [_LeafTables(leaves[i : i + step], slots[i : i + step]) for i in range(0, len(leaves), step)]
    return out, bit, rest


def shapley(model: Booster, x: np.ndarray, class_idx: int = 0) -> np.ndarray:
    """Path-dependent Shapley values (rows x features + 1, the last the expectation).

    For a leaf, feature j of its path contributes through the polynomial
    prod(z + o t) over the path's other features, weighed by the Shapley kernel;
    z is the share of cover that follows the path, o whether the row itself does.
    """
    x = np.asarray(x, float)
    out = np.zeros((len(x), len(model.features) + 1))
    if model.trees:
        flat = model.flat()
        tables, bit, rest = _tables(model, class_idx)
        block = max(1, CELLS_AT_ONCE // len(flat.left))
        for i in range(0, len(x) if tables else 0, block):
            own = x[i : i + block]
            every = np.broadcast_to(np.arange(len(flat.left)), (len(own), len(flat.left)))
            left = flat.goes_left(own, every, bool(np.isnan(own).any()))
            missed = np.zeros((len(own), len(flat.left)), np.uint64)
            for d in range(flat.deepest):
                k = np.flatnonzero(~flat.leaf & (flat.depth == d))
                missed[:, flat.left[k]] = missed[:, k] | np.where(left[:, k], np.uint64(0), bit[k])
                missed[:, flat.right[k]] = missed[:, k] | np.where(left[:, k], bit[k], np.uint64(0))
            for table in tables:
                table.add(out[i : i + block], missed)
        for tree, scale in rest:
            _add_paths(out, tree, scale, x)
        means = flat.means()[flat.root]
        out[:, -1] += model.params.eta * (flat.weight * means)[flat.classes == class_idx].sum()
    out[:, -1] += model.base
    return out


#: Row and node pairs that an attribution holds at once.
CELLS_AT_ONCE = 1 << 20


def _add_paths(out: np.ndarray, tree: Tree, scale: float, x: np.ndarray) -> None:
    """Adds one tree's attributions leaf by leaf, for paths of any length."""
    left = np.stack([_left_column(tree, k, x) if not n.is_leaf else np.zeros(len(x), bool) for k, n in enumerate(tree.nodes)], 1)
    for value, path in _leaf_paths(tree):
        if path:
            follows = np.stack([np.logical_and.reduce([left[:, k] == d for k, d in steps]) for _, _, steps in path], 1)
            each = _path_shares(follows.astype(float), np.array([z for _, z, _ in path]))
            out[:, [f for f, _, _ in path]] += scale * value * each


def _path_shares(ones: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Shapley share of each path feature (columns) for each pattern of followed decisions (rows)."""
    m = len(zero)
    kernel = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    out = np.empty_like(ones)
    for j in range(m):
        poly = np.zeros((len(ones), m))
        poly[:, 0] = 1
        for i in range(m):
            if i != j:
                shifted = np.zeros_like(poly)
                shifted[:, 1:] = poly[:, :-1] * ones[:, i : i + 1]
                poly = poly * zero[i] + shifted
        out[:, j] = (ones[:, j] - zero[j]) * (poly @ kernel)
    return out


def _left_column(tree: Tree, k: int, x: np.ndarray) -> np.ndarray:
    n = tree.nodes[k]
    v = x[:, n.feature]
    go = np.isin(v, n.cat_left) if n.cat_left is not None else v < n.threshold
    return np.where(np.isnan(v), n.default_left, go)


def interactions(model: Booster, x: np.ndarray, class_idx: int = 0) -> np.ndarray:
    """Shapley interaction values (rows, features + 1, features + 1).

    Off the diagonal, half of the pair's interaction on either side; the diagonal
    takes the rest, so that every row of the matrix sums to the attribution.
    """
    width = len(model.features)
    out = np.zeros((len(x), width + 1, width + 1))
    base = shapley(model, x, class_idx)
    for tree in model.trees:
        if tree.class_idx != class_idx:
            continue
        scale = model.params.eta * tree.weight
        left = np.stack([_left_column(tree, k, x) if not n.is_leaf else np.zeros(len(x), bool) for k, n in enumerate(tree.nodes)], 1)
        for value, path in _leaf_paths(tree):
            m = len(path)
            if m < 2:
                continue
            ones = np.stack([np.logical_and.reduce([left[:, k] == d for k, d in steps]) for _, _, steps in path], 1).astype(float)
            zero = np.array([z for _, z, _ in path])
            kernel = np.array([math.factorial(k) * math.factorial(m - 2 - k) / math.factorial(m - 1) for k in range(m - 1)])
            for a in range(m):
                for b in range(a):
                    poly = np.zeros((len(x), m - 1))
                    poly[:, 0] = 1
                    for i in range(m):
                        if i not in (a, b):
                            shifted = np.zeros_like(poly)
                            shifted[:, 1:] = poly[:, :-1] * ones[:, i : i + 1]
                            poly = poly * zero[i] + shifted
                    both = scale * value * (ones[:, a] - zero[a]) * (ones[:, b] - zero[b]) * (poly @ kernel) / 2
                    fa, fb = path[a][0], path[b][0]
                    out[:, fa, fb] += both
                    out[:, fb, fa] += both
    for f in range(width):
        out[:, f, f] = base[:, f] - out[:, f, :].sum(1)
    out[:, width, width] = base[:, width]
    return out


def approximate(model: Booster, x: np.ndarray, class_idx: int = 0) -> np.ndarray:
    """Fast attributions: each split passes on the change of its node's expectation."""
    x = np.asarray(x, float)
    out = np.zeros((len(x), len(model.features) + 1))
    if model.trees:
        flat = model.flat()
        means, scale = flat.means(), model.params.eta * flat.weight * (flat.classes == class_idx)
        out[:, -1] += (scale * means[flat.root]).sum()
        for rows, at, after in flat.steps(x):
            place = np.arange(len(at))[:, None] * out.shape[1] + flat.feature[at]
            passed = scale * (means[after] - means[at])
            out[rows] += np.bincount(place.ravel(), passed.ravel(), minlength=out[rows].size).reshape(out[rows].shape)
    out[:, -1] += model.base
    return out


def with_attribution(model: Booster, df: DataFrame, kind: str = "exact", out: str = "attribution") -> DataFrame:
    """Adds attributions in Arrow batches: exact, approximate, or interaction (row-major)."""
    make = {"exact": lambda x: shapley(model, x), "approximate": lambda x: approximate(model, x), "interaction": lambda x: interactions(model, x).reshape(len(x), -1)}[kind]
    return model._walk(df, out, T.ArrayType(T.DoubleType()), make)
