"""Tree growth on the cluster.

Rows are binned once and persisted. Each level of a tree is one job: rows find
their node through lookups in small literal arrays (no join), gradients are
Columns, histograms are partial sums in the tasks and a grouped sum, and the split
search is a window over bins with an arg-max for each node. Only the best split of
each open node comes to the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import gain as gain_of
from ..plans.params import Params
from . import sampling
from .local import allowed_features, path_group
from .tree import Node, Split, Tree, _categorical, _part, leaf_value


def route(node: Column, bins: Column, tree: Tree, start: int, exact: bool = False) -> Column:
    """The row's node after the splits of the nodes from ``start`` on; with ``exact``, bins holds the values."""
    own = tree.nodes[start:]
    ints = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    at = node - start + 1
    feature = F.element_at(ints(max(n.feature, 0) for n in own), at)
    value = F.element_at(bins, feature + 1)
    if exact:
        lost, low = value.isNull(), value < F.element_at(F.array(*[F.lit(float(n.threshold)) for n in own]), at)
    else:
        lost, low = value < 0, value <= F.element_at(ints(n.bin for n in own), at)
    for k, n in enumerate(own):
        if n.cat_bins is not None:
            low = F.when(at == k + 1, value.isin(n.cat_bins)).otherwise(low)
    left = F.when(lost, F.element_at(F.array(*[F.lit(bool(n.default_left)) for n in own]), at)).otherwise(low)
    child = F.element_at(ints(n.left for n in own), at)
    inner = F.element_at(F.array(*[F.lit(not n.is_leaf) for n in own]), at)
    return F.when(node < start, node).when(inner, child + F.when(left, 0).otherwise(1)).otherwise(node)


def histogram(rows: DataFrame, features: int, width: int, strategy: str = "arrow") -> DataFrame:
    """(node, feature, bin, g, h, n) of rows (node, g, h, n, bins); bin -1 is missing.

    ``arrow`` sums each task's rows with numpy before the shuffle; ``catalyst``
    unpivots the bins and lets the partial aggregate do it. Both give one table.
    Exact growth has values for bins, null for missing, and takes ``catalyst``.
    """
    if strategy == "catalyst":
        cells = rows.select("node", "g", "h", "n", F.posexplode("bins").alias("feature", "bin"))
        return cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy(zero_copy_only=False)
            values = [batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)]
            bins = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            flat = np.where(bins < 0, width, bins) + np.arange(features) * (width + 1)
            for k in np.unique(node):
                rows_ = node == k
                own = total.setdefault(int(k), np.zeros((3, features * (width + 1))))
                cells = flat[rows_].ravel()
                for i, v in enumerate(values):
                    own[i] += np.bincount(cells, np.repeat(v[rows_], features), minlength=own.shape[1])
        for k, own in total.items():
            at = np.flatnonzero(own[2])
            f, b = at // (width + 1), at % (width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(f.astype(np.int32)), pa.array(np.where(b == width, -1, b).astype(np.int32)), *[pa.array(own[i][at]) for i in range(3)]], names=["node", "feature", "bin", "g", "h", "n"])

    made = rows.select(F.col("node").cast("int"), "g", "h", F.col("n").cast("double").alias("n"), "bins").mapInArrow(partial, "node int, feature int, bin int, g double, h double, n double")
    return made.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def split_candidates(hist: DataFrame, c: Params) -> DataFrame:
    """Every (node, feature, bin, default_left) with its left sums and gain.

    Prefix sums over bins; node totals come from the same histogram; missing rows
    are tried on both sides. In exact growth a bin is a value, null for missing,
    and the threshold lies halfway to the next value of the node.
    """
    whole = Window.partitionBy("node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    exact = c.tree_method == "exact"
    here = F.col("bin").isNotNull() if exact else F.col("bin") >= 0
    only = lambda x: F.sum(F.when(here, F.col(x)).otherwise(0.0)).over(upto)
    lost = lambda x: F.sum(F.when(~here, F.col(x)).otherwise(0.0)).over(whole)
    every = lambda x: F.sum(x).over(whole)
    scan = hist.select("node", "feature", "bin", *[only(x).alias(f"{x}l") for x in "ghn"], *[lost(x).alias(f"{x}m") for x in "ghn"], *[every(x).alias(f"{x}p") for x in "ghn"], *([F.lead("bin").over(whole.orderBy("bin")).alias("after")] if exact else [])).where(here)
    if exact:
        scan = scan.where("after is not null").withColumn("threshold", (F.col("bin") + F.col("after")) / 2)
    sides = scan.withColumn("default_left", F.explode(F.array(F.lit(True), F.lit(False))))
    for x in "ghn":
        sides = sides.withColumn(f"{x}l", F.when(F.col("default_left"), F.col(f"{x}l") + F.col(f"{x}m")).otherwise(F.col(f"{x}l")))
    gr, hr, nr = F.col("gp") - F.col("gl"), F.col("hp") - F.col("hl"), F.col("np") - F.col("nl")
    sides = sides.withColumn("gain", gain_of(F.col("gl"), F.col("hl"), gr, hr, F.col("gp"), F.col("hp"), c.lambda_, c.alpha))
    ok = (F.col("nl") > 0) & (nr > 0) & (F.col("hl") >= c.min_child_weight) & (hr >= c.min_child_weight)
    for f, sign in c.monotone.items():
        if sign:
            ok &= (F.col("feature") != f) | (sign * (F.col("gl") * (hr + c.lambda_) - gr * (F.col("hl") + c.lambda_)) >= 0)
    return sides.where(ok & (F.col("gain") > c.gamma)).select("node", "feature", "bin", "default_left", "gl", "hl", "gp", "hp", "gain", *(["threshold"] if exact else []))


def best_splits(hist: DataFrame, c: Params, allowed: dict[int, list[int]] | None = None) -> DataFrame:
    """The best candidate of each node; ties go to the first feature, bin and left."""
    found = split_candidates(hist, c)
    if allowed is not None:
        keep = F.lit(False)
        for k, fs in allowed.items():
            keep |= (F.col("node") == k) & F.col("feature").isin(fs)
        found = found.where(keep)
    # Gains that differ by the order of summation only are ties: eleven digits count.
    size = F.floor(F.log10("gain"))
    rank = F.struct(size, F.round(F.col("gain") / F.pow(F.lit(10.0), size), 10), -F.col("feature"), -F.col("bin"), F.col("default_left"))
    return found.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "default_left", "gl", "hl", "gp", "hp", "gain", *(["threshold"] if c.tree_method == "exact" else [])), rank).alias("s")).select("node", "s.*")


def _find(now: DataFrame, features: int, width: int, c: Params, allowed: dict[int, list[int]], cuts: list[np.ndarray], strategy: str, restricted: bool) -> dict[int, tuple[Split, float, float]]:
    """The best split of each open node, with the node's sums of g and h.

    Categories are compared on the driver: a node that splits on them lists them.
    """
    exact = c.tree_method == "exact"
    hist = histogram(now.where(F.col("node").isin(list(allowed))), features, width, "catalyst" if exact else strategy)
    plain = {k: [f for f in fs if f not in c.categorical] for k, fs in allowed.items()}
    kinds = sorted({f for fs in allowed.values() for f in fs if f in c.categorical})
    if kinds:
        hist = hist.persist()
    out = {}
    if any(plain.values()):
        for r in best_splits(hist, c, plain if restricted or kinds else None).collect():  # a row for each open node at most
            best = Split(r["gain"], r["feature"], 0 if exact else r["bin"], r["gl"], r["hl"], r["default_left"], r["threshold"] if exact else None)
            out[r["node"]] = best, r["gp"], r["hp"]
    if kinds:
        cells: dict[tuple[int, int], list] = {}
        for r in hist.where(F.col("feature").isin(kinds)).collect():
            cells.setdefault((r["node"], r["feature"]), []).append(r)
        hist.unpersist()
        for (k, f), own in sorted(cells.items()):
            if f not in allowed[k]:
                continue
            values = cuts[f]  # of a categorical feature: its values
            table = np.zeros((len(values) + 1, 3))
            for r in own:
                place = len(values) if _lost(r["bin"]) else int(np.searchsorted(values, r["bin"])) if exact else r["bin"]
                table[place] = r["g"], r["h"], r["n"]
            g, h = float(table[:, 0].sum()), float(table[:, 1].sum())
            found = _categorical(table[:-1], table[-1], g, h, float(_part(np.array(g), np.array(h), c)), c, f, values)
            if found and found.gain > max(c.gamma, out[k][0].gain if k in out else 0.0) * (1 + 1e-12):
                out[k] = found, g, h
    return out


def _lost(bin_: float | None) -> bool:
    return bin_ is None or bin_ < 0


def _split(tree: Tree, k: int, best: Split, cuts: list[np.ndarray], c: Params) -> tuple[int, int]:
    children = tree.split(k, best, cuts)
    if best.cat_left is not None:
        values = best.cat_left if c.tree_method == "exact" else np.searchsorted(cuts[best.feature], best.cat_left)
        tree.nodes[k].cat_bins = [v.item() if hasattr(v, "item") else v for v in values]
    group = path_group(c, best.feature, tree.nodes[k].group)
    for child in children:
        tree.nodes[child].group = group
    return children


def _splittable(mask: list[int], cuts: list[np.ndarray], c: Params) -> list[int]:
    return [f for f in mask if len(cuts[f]) >= 2 or c.tree_method == "exact" and f not in c.categorical]


def grow(rows: DataFrame, features: int, cuts: list[np.ndarray], c: Params, mask: list[int], seed: int = 0, strategy: str = "arrow") -> tuple[Tree, DataFrame]:
    """One tree, level by level, and the rows with their leaf in column node.

    ``rows`` has g, h, n and bins and is read once for each level.
    """
    tree, width = Tree(), max([1, *map(len, cuts)])
    now, start, open_ = rows.withColumn("node", F.lit(0)), 0, [0]
    first = True
    for depth in range(c.max_depth):
        level = _splittable(sampling.sample_columns(mask, c.colsample_bylevel, seed * 7919 + depth), cuts, c)
        if not level or not open_:
            break
        allowed = {k: allowed_features(c, sampling.sample_columns(level, c.colsample_bynode, seed * 7919 + k * 31 + 7), tree.nodes[k].group) for k in open_}
        found = _find(now, features, width, c, allowed, cuts, strategy, bool(c.interactions) or c.colsample_bynode < 1 or len(level) < features)
        if first and found:
            tree.nodes[0].g, tree.nodes[0].h = found[0][1:]
        first = False
        after, at = [], len(tree.nodes)
        for k in open_:
            if k in found:
                after += _split(tree, k, found[k][0], cuts, c)
        if not after:
            break
        now, start, open_ = now.withColumn("node", route(F.col("node"), F.col("bins"), tree, start, c.tree_method == "exact")), at, after
    if not tree.nodes[0].h:
        tree.nodes[0].g, tree.nodes[0].h = rows.agg(F.coalesce(F.sum("g"), F.lit(0.0)), F.coalesce(F.sum("h"), F.lit(0.0))).first()
    for node in tree.nodes:
        if node.is_leaf:
            node.value = leaf_value(node.g, node.h, c)
    return tree, now


def placed(rows: DataFrame, tree: Tree, c: Params) -> DataFrame:
    """The rows with their leaf in column __node, by routing over bins."""
    exact = c.tree_method == "exact"
    if c.max_leaves:  # nodes come in order of gain, not of depth
        return rows.withColumn("__node", bin_case(tree, exact=exact))
    out, at = rows.withColumn("__node", F.lit(0)), 0
    while at < len(tree.nodes) and not all(n.is_leaf for n in tree.nodes[at:]):
        depth = tree.nodes[at].depth
        # deeper nodes count as leaves
        own = Tree([n if n.depth <= depth else Node(n.depth) for n in tree.nodes], tree.class_idx, tree.weight)
        out = out.withColumn("__node", route(F.col("__node"), F.col("bins"), own, at, exact))
        at = next((i for i, n in enumerate(tree.nodes) if n.depth == depth + 1), len(tree.nodes))
    return out


def refresh(tree: Tree, rows: DataFrame, c: Params) -> None:
    """Leaf values and sums from all rows (g, h, bins), also those the tree was not grown on."""
    sums = {r["__node"]: r for r in placed(rows, tree, c).groupBy("__node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}  # a row for each leaf
    for k in range(len(tree.nodes) - 1, -1, -1):
        node = tree.nodes[k]
        if node.is_leaf:
            node.g, node.h = (sums[k]["g"], sums[k]["h"]) if k in sums else (0.0, 0.0)
            node.value = leaf_value(node.g, node.h, c)
        else:
            a, b = tree.nodes[node.left], tree.nodes[node.right]
            node.g, node.h = a.g + b.g, a.h + b.h


def bin_case(tree: Tree, k: int = 0, exact: bool = False) -> Column:
    """The leaf of a row over its bins (values with ``exact``), as nested CASE."""
    n = tree.nodes[k]
    if n.is_leaf:
        return F.lit(k)
    value = F.element_at("bins", n.feature + 1)
    low = value.isin(n.cat_bins) if n.cat_bins is not None else value < n.threshold if exact else value <= n.bin
    left = F.when(value.isNull() if exact else value < 0, F.lit(bool(n.default_left))).otherwise(low)
    return F.when(left, bin_case(tree, n.left, exact)).otherwise(bin_case(tree, n.right, exact))


def grow_by_leaf(rows: DataFrame, features: int, cuts: list[np.ndarray], c: Params, mask: list[int], seed: int = 0, strategy: str = "arrow") -> tuple[Tree, DataFrame]:
    """One tree, best leaf first, up to ``max_leaves`` leaves: one job for each split.

    The driver holds a queue of the open leaves' best splits; a job finds those of
    the two children of the leaf that was split last.
    """
    tree, width = Tree(), max([1, *map(len, cuts)])
    level = _splittable(sampling.sample_columns(mask, c.colsample_bylevel, seed * 7919), cuts, c)
    now, heap = rows.withColumn("node", F.lit(0)), []

    def offer(nodes: list[int]) -> None:
        nodes = [k for k in nodes if not c.max_depth or tree.nodes[k].depth < c.max_depth]
        if not nodes or not level:
            return
        allowed = {k: allowed_features(c, sampling.sample_columns(level, c.colsample_bynode, seed * 7919 + k * 31 + 7), tree.nodes[k].group) for k in nodes}
        for k, (best, gp, hp) in _find(now, features, width, c, allowed, cuts, strategy, True).items():
            if k == 0:
                tree.nodes[0].g, tree.nodes[0].h = gp, hp
            heapq.heappush(heap, (-best.gain, k, best))

    offer([0])
    leaves = 1
    while heap and leaves < c.max_leaves:
        _, k, best = heapq.heappop(heap)
        left, right = _split(tree, k, best, cuts, c)
        now = rows.withColumn("node", bin_case(tree, exact=c.tree_method == "exact"))  # anew from the bins: a chain of columns would grow with the splits
        leaves += 1
        if leaves < c.max_leaves:
            offer([left, right])
    if not tree.nodes[0].h:
        tree.nodes[0].g, tree.nodes[0].h = rows.agg(F.coalesce(F.sum("g"), F.lit(0.0)), F.coalesce(F.sum("h"), F.lit(0.0))).first()
    for node in tree.nodes:
        if node.is_leaf:
            node.value = leaf_value(node.g, node.h, c)
    return tree, now
