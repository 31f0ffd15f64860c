"""The booster: fit, continue, score and explain over DataFrames.

Two strategies give the same trees: ``spark`` grows them with one job a level,
``local`` takes data under a checked size to numpy. ``auto`` counts first, and
``local`` beyond that size is grown on the cluster, too.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import logit
from ..functions.metrics import evaluate as spark_metric
from ..functions.metrics import higher_is_better
from ..functions.objectives import class_gradient, cox_gradient, gradient, link, pair_gradient
from ..plans.params import Params
from . import local, sampling, spark_grow
from .flat import Flat
from .frame import Frame
from .quantize import binned
from .tree import NODE_SCHEMA, Node, Tree

log = logging.getLogger("thicket")
#: Rounds between two lines of the log.
LOG_EVERY = 10
#: Cells (rows x features, with those of a validation set) that the driver takes.
LOCAL_CELLS = 4_000_000
#: Rounds after which the margins' lineage is cut by a checkpoint.
CHECKPOINT_EVERY = 10
#: Nodes of a model up to which scoring is one generated expression.
CASE_NODES = 1500


class Booster:
    """A model: parameters, base margin, trees and feature names."""

    def __init__(self, params: Params, features: tuple[str, ...] = (), trees: list[Tree] | None = None, base: float = 0.0, history: list[dict] | None = None):
        self.params, self.features, self.trees, self.base, self.history = params, tuple(features), list(trees or []), base, list(history or [])
        self._flat: tuple | None = None

    # ---- fitting ----

    @classmethod
    def fit(cls, frame: Frame, params: Params, valid: Frame | None = None, metrics: tuple[str, ...] = (), strategy: str = "auto") -> Booster:
        out = cls(params, frame.features)
        out._train(frame, valid, metrics, strategy)
        return out

    def continue_fit(self, frame: Frame, rounds: int, valid: Frame | None = None, metrics: tuple[str, ...] = (), strategy: str = "auto") -> Booster:
        """More rounds on top of this model's trees; the model itself stays as it is."""
        out = Booster(self.params.with_(num_trees=rounds), self.features, self.trees, self.base, self.history)
        out._train(frame, valid, metrics, strategy, keep=True)
        return out

    def _train(self, frame: Frame, valid: Frame | None, metrics: tuple[str, ...], strategy: str, keep: bool = False) -> None:
        c = self.params
        if strategy in ("auto", "local"):
            cells = frame.cells() + (valid.cells() if valid is not None else 0)
            if self._needs_local() and cells > 25 * LOCAL_CELLS:
                raise ValueError("custom objectives and metrics need the local strategy, and the data are too large for it")
            strategy = "local" if self._needs_local() or cells <= LOCAL_CELLS else "spark"
        if strategy == "local":
            v = None if valid is None else local.LocalData(*valid.arrays())
            self.trees, self.base, more = local.fit(local.LocalData(*frame.arrays()), c, self.trees, self.base if keep else None, v, metrics)
            self.history += more
        elif self._needs_local():
            raise ValueError("the spark strategy has no custom objectives and metrics")
        else:
            self._train_spark(frame, valid, metrics, keep, "catalyst" if strategy == "catalyst" else "arrow")

    def _needs_local(self) -> bool:
        c = self.params
        return bool(c.custom_objective or c.custom_metric)

    def _train_spark(self, frame: Frame, valid: Frame | None, metrics: tuple[str, ...], keep: bool, strategy: str) -> None:
        c, k = self.params, self.params.classes
        dart, by_gradient = c.booster == "dart", c.sampling_method == "gradient_based" and c.subsample < 1 and c.num_parallel_tree == 1
        df = frame.selected().withColumnsRenamed({frame.label: "__y", frame.row: "__row"})
        if c.objective in ("binary:logistic", "binary:logitraw"):
            df = df.withColumn("__y", (F.col("__y") > 0).cast("double"))
        df = df.withColumn("__y", F.col("__y").cast("double")).withColumn("__w", F.col(f"`{frame.weight}`").cast("double") if frame.weight else F.lit(1.0))
        if not keep:
            self.base = self._base(df)
        start = F.array(*[F.lit(self.base)] * k) if frame.margin is None else (F.col(f"`{frame.margin}`") if k > 1 else F.array(F.col(f"`{frame.margin}`").cast("double")))
        df = df.withColumn("__m", start)
        group = frame.group
        g, h = self._gradients(df, group, c)
        # Dart weighs old trees anew: rows keep their features and the margin they start from.
        keep_cols = ["__row", "__y", "__w", "__m", *([group] if group else []), *([f"`{f}`" for f in frame.features] if dart else [])]
        rows, cuts = binned(df.select(*dict.fromkeys([*keep_cols, *[f"`{f}`" for f in frame.features]])), g, list(frame.features), c, F.col("__h")[0])
        if self.trees and not dart:
            rows = self._add_trees(rows, self.trees, frame.features)
        rows = rows.select(*keep_cols, "bins")
        if by_gradient:
            rows = sampling.in_row_order(rows, "__row")
        rows = rows.persist()
        vdf, names, best = None, tuple(metrics) or c.eval_metric, None
        if valid is not None:
            vstart = F.array(*[F.lit(self.base)] * k) if valid.margin is None else (F.col(f"`{valid.margin}`") if k > 1 else F.array(F.col(f"`{valid.margin}`").cast("double")))
            vdf = valid.selected().withColumn("__m", vstart)
            vdf = self._add_trees(vdf, self.trees, self.features) if self.trees and not dart else vdf
            vdf = vdf.persist()
        first, vfirst = rows, vdf
        done = len(self.trees) // (k * c.num_parallel_tree)
        for it in range(done, done + c.num_trees):
            dropped, new = [], []
            if dart:
                dropped = local.choose_dropped(self.trees, c, sampling.derive_seed(c.seed, it, 7))
                rows = self._add_trees(first, [t for i, t in enumerate(self.trees) if i not in set(dropped)], frame.features)
            grads, _ = self._gradients(rows, group, c)
            grads = grads.persist() if dart or by_gradient or k > 1 or group or c.objective == "survival:cox" else grads
            fresh = rows
            for cls, p in [(cls, p) for cls in range(k) for p in range(c.num_parallel_tree)]:
                every = grads.select("__row", F.col("__g")[cls].alias("g"), F.col("__h")[cls].alias("h"), F.lit(1.0).alias("n"), "bins", *(["__part"] if by_gradient else []))
                drawn_by = sampling.derive_seed(c.seed, it * k + cls, 0)
                one = sampling.drawn_by_gradient(every, c.subsample, drawn_by).persist() if by_gradient else sampling.sample_rows_by_hash(every, c.subsample, drawn_by, "__row")
                if c.num_parallel_tree > 1:  # each tree of a forest draws its own rows
                    drawn = sampling.with_multiplicity(one, sampling.derive_seed(c.seed, it * k + cls, 100 + p), "__row").where("copies > 0")
                    one = drawn.select("__row", (F.col("g") * F.col("copies")).alias("g"), (F.col("h") * F.col("copies")).alias("h"), F.col("copies").cast("double").alias("n"), "bins")
                mask = sampling.sample_columns(list(range(len(cuts))), c.colsample_bytree, sampling.derive_seed(c.seed, it * k + cls + p * 1000, 1 + (100 if p else 0)), c.feature_weights)
                make = spark_grow.grow_by_leaf if c.max_leaves else spark_grow.grow
                tree, _ = make(one, len(cuts), cuts, c, mask, sampling.derive_seed(c.seed, it * k + cls + p * 1000, p) & 0xFFFF, strategy)
                tree.class_idx, tree.weight = cls, 1.0 / c.num_parallel_tree
                if c.refresh_leaf:
                    spark_grow.refresh(tree, every, c)
                if by_gradient:
                    one.unpersist()
                new.append(tree)
            if dart:
                local.dart_weights(self.trees, dropped, new, c)
            self.trees += new
            if dart:
                fresh = self._add_trees(first, self.trees, frame.features)
                vdf = None if valid is None else self._add_trees(vfirst, self.trees, self.features)
            for tree in [] if dart else new:
                fresh = self._stepped(fresh, tree, c)
                vdf = None if vdf is None else self._add_trees(vdf, [tree], self.features)
            cut = (it + 1 - done) % CHECKPOINT_EVERY == 0 and not dart and _can_checkpoint(fresh.sparkSession)
            fresh = fresh.checkpoint() if cut else fresh.persist()
            if vdf is not None and cut:
                vdf = vdf.checkpoint()
            row = {"iteration": it}
            for name in names:
                row[f"train-{name}"] = self._spark_metric(fresh, name, "__y", group, "__row")
                if vdf is not None:
                    row[f"valid-{name}"] = self._spark_metric(vdf, name, valid.label, valid.group, valid.row)
            if not names:
                fresh.count()  # so that the old rows can go
            (fresh if dart else rows).unpersist()
            grads.unpersist()
            rows = fresh
            self.history.append(row)
            if it % LOG_EVERY == 0:
                log.info("round %d: %s", it, {n: v for n, v in row.items() if n != "iteration"})
            if c.early_stopping_rounds and vdf is not None and names:
                score, up = row[f"valid-{names[0]}"], higher_is_better(names[0])
                if best is None or (score > best[0] if up else score < best[0]):
                    best = (score, it, len(self.trees))
                if it - best[1] >= c.early_stopping_rounds:
                    self.trees = self.trees[: best[2]]
                    break
            if any(call(it, self.history, rows) for call in c.callbacks):
                break
        for held in (rows, first, vfirst):
            if held is not None:
                held.unpersist()

    def _base(self, df: DataFrame) -> float:
        c = self.params
        if not c.boost_from_average or c.objective not in ("binary:logistic", "binary:logitraw", "reg:squarederror", "reg:logistic"):
            return logit(c.base_score) if c.objective in ("binary:logistic", "binary:logitraw") else c.base_score
        mean = df.agg(F.avg("__y")).first()[0] or 0.0
        return mean if c.objective == "reg:squarederror" or c.objective == "reg:logistic" and c.compat else logit(mean)

    def _gradients(self, df: DataFrame, group: str | None, c: Params) -> tuple[DataFrame, None]:
        """``df`` with arrays __g and __h."""
        m, y, w = F.col("__m"), F.col("__y"), F.col("__w")
        if c.classes > 1:
            g, h = class_gradient(m, y, c.classes, w)
            return df.withColumns({"__g": g, "__h": h}), None
        if c.objective.startswith("rank:") or c.objective == "survival:cox":
            flat = df.select("__row", (F.col(f"`{group}`") if group else F.lit(0)).alias("__grp"), m[0].alias("margin"), y.alias("label"))
            made = cox_gradient(flat, "__row") if c.objective == "survival:cox" else pair_gradient(flat, c.objective, "__grp", "__row", exp_gain=c.ndcg_exp_gain)
            made = made.select(F.col("__row").alias("__r"), F.array(F.col("g")).alias("__g0"), F.array(F.col("h")).alias("__h0"))
            zero = F.array(F.lit(0.0))
            out = df.join(made, F.col("__row") == F.col("__r"), "left")
            return out.withColumns({"__g": F.transform(F.coalesce("__g0", zero), lambda v: v * w), "__h": F.transform(F.coalesce("__h0", zero), lambda v: v * w)}).drop("__r", "__g0", "__h0"), None
        g, h = gradient(c, m[0], y, w)
        return df.withColumns({"__g": F.array(g), "__h": F.array(h)}), None

    def _stepped(self, rows: DataFrame, tree: Tree, c: Params) -> DataFrame:
        """Margins after one tree, by routing over bins and a lookup of leaf values."""
        out = spark_grow.placed(rows, tree, c)
        values = F.array(*[F.lit(float(c.eta * tree.weight * n.value)) for n in tree.nodes])
        step = F.element_at(values, F.col("__node") + 1)
        return out.withColumn("__m", F.transform("__m", lambda v, i: v + F.when(i == tree.class_idx, step).otherwise(0.0))).drop("__node")

    def _add_trees(self, df: DataFrame, trees: list[Tree], features: tuple[str, ...]) -> DataFrame:
        own = Booster(self.params, features, trees, 0.0)
        if not trees:
            return df
        return own.margins(df, "__add").withColumn("__m", F.zip_with("__m", "__add", lambda a, b: a + b)).drop("__add")

    def _spark_metric(self, df: DataFrame, name: str, label: str, group: str | None, row: str) -> float:
        c, m = self.params, F.col("__m")
        base = name.split("@")[0]
        if base in ("merror", "mlogloss"):
            p = link(c.with_(objective="multi:softprob"), m)
        elif c.on_margin or base.startswith("cox"):
            p = m[0]
        else:
            p = link(c, m if c.classes > 1 else m[0])
        return spark_metric(df.select(p.alias("pred"), F.col(f"`{label}`").cast("double").alias("label"), F.col(f"`{row}`").alias("row_id"), *([F.col(f"`{group}`").alias("grp")] if group else [])), name, "pred", "label", "grp" if group else None, "row_id")

    # ---- scoring ----

    def slice(self, first: int = 0, end: int | None = None) -> Booster:
        """The model of a range of rounds; the base margin always counts."""
        per = self.params.classes * self.params.num_parallel_tree
        return Booster(self.params, self.features, self.trees[first * per : None if end is None else end * per], self.base)

    def margins(self, df: DataFrame, out: str = "margins") -> DataFrame:
        """Adds an array with the margin of each class.

        A small model is one generated expression, so that scans prune to the
        features it uses; a larger one is walked in Arrow batches.
        """
        if sum(len(t.nodes) for t in self.trees) <= CASE_NODES and all(n.vector is None for t in self.trees for n in t.nodes):
            return df.withColumn(out, self.margin_expression())
        return self._walk(df, out, T.ArrayType(T.DoubleType()), self._numpy_margins)

    def margin_expression(self) -> Column:
        sums = []
        for k in range(self.params.classes):
            total = F.lit(float(self.base))
            for t in self.trees:
                if t.class_idx == k:
                    total = total + case_of(t, self.features, [self.params.eta * t.weight * n.value for n in t.nodes])
            sums.append(total)
        return F.array(*sums)

    def predict(self, df: DataFrame, margin: bool = False, out: str = "prediction") -> DataFrame:
        """Adds the prediction: the linked margin, or the margin itself."""
        scored = self.margins(df, "__margins")
        m = F.col("__margins") if self.params.classes > 1 else F.col("__margins")[0]
        return scored.withColumn(out, m if margin else link(self.params, m)).drop("__margins")

    def leaf_index(self, df: DataFrame, out: str = "leaves") -> DataFrame:
        """Adds an array with the node that each tree puts the row into."""
        if sum(len(t.nodes) for t in self.trees) <= CASE_NODES:
            return df.withColumn(out, F.array(*[case_of(t, self.features, list(range(len(t.nodes)))) for t in self.trees]))
        return self._walk(df, out, T.ArrayType(T.IntegerType()), lambda x: np.stack([t.leaves(x) for t in self.trees], 1).astype(np.int32))

    def flat(self) -> Flat:
        """The trees as flat arrays, made once for a list of trees."""
        if self._flat is None or self._flat[0] is not self.trees or self._flat[1] != len(self.trees):
            self._flat = self.trees, len(self.trees), Flat(self.trees)
        return self._flat[2]

    def _numpy_margins(self, x: np.ndarray) -> np.ndarray:
        return self.numpy_predict(x).reshape(len(x), -1)

    def numpy_predict(self, x: np.ndarray) -> np.ndarray:
        return local.margins(self.trees, np.asarray(x, float), self.params, self.base, flat=self.flat() if self.trees else None)

    def _walk(self, df: DataFrame, out: str, kind: T.DataType, make) -> DataFrame:
        names = [c for c in df.columns if c != out]
        schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, kind)])
        features = list(self.features)

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(names.index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], 1)
                made = make(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)), pa.array(made.ravel())) if made.ndim == 2 else pa.array(made.tolist())
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], flat], names=schema.names)

        return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(mapped, schema)

    # ---- the model as a table ----

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = []
        for t, tree in enumerate(self.trees):
            for k, n in enumerate(tree.nodes):
                rows.append((t, k, tree.class_idx, n.depth, n.feature, float(n.threshold), n.cat_left, n.left, n.right, bool(n.default_left), float(n.value), n.vector, float(n.gain), float(n.g), float(n.h), float(tree.weight)))
        return spark.createDataFrame(rows, NODE_SCHEMA)

    @classmethod
    def from_nodes(cls, nodes: DataFrame, params: Params, features: tuple[str, ...], base: float) -> Booster:
        trees: dict[int, Tree] = {}
        for r in nodes.orderBy("tree_id", "node_id").collect():
            tree = trees.setdefault(r["tree_id"], Tree([], r["class_idx"], r["tree_weight"]))
            tree.nodes.append(Node(r["depth"], r["feature"], r["threshold"], r["cat_left"], r["left"], r["right"], r["default_left"], r["leaf_value"], r["leaf_vector"], r["gain"], r["sum_grad"], r["sum_hess"]))
        return cls(params, features, [trees[k] for k in sorted(trees)], base)


def _can_checkpoint(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def case_of(tree: Tree, features: tuple[str, ...], values: list, k: int = 0) -> Column:
    """The tree as nested CASE: the missing check stands before the comparison."""
    n = tree.nodes[k]
    if n.is_leaf:
        return F.lit(values[k])
    x = F.col(f"`{features[n.feature]}`").cast("double")
    lost = x.isNull() | F.isnan(x)
    left = x.isin(*n.cat_left) if n.cat_left is not None else x < n.threshold
    go = F.when(lost, F.lit(bool(n.default_left))).otherwise(left)
    return F.when(go, case_of(tree, features, values, n.left)).otherwise(case_of(tree, features, values, n.right))
