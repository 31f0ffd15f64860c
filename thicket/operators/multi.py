"""Multi-output models: one structure, a vector of values in every leaf."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.objectives import gradient, np_gradient
from ..plans.params import Params
from . import sampling, spark_grow
from .booster import CHECKPOINT_EVERY, LOCAL_CELLS, Booster, _can_checkpoint
from .frame import Frame
from .local import Bins, grow
from .quantize import binned
from .tree import leaf_value


class MultiOutput:
    """Trees shared by all targets; the gain is that of the targets' summed gradients or of the first."""

    def __init__(self, params: Params, features: tuple[str, ...], trees: list, base: np.ndarray):
        self.params, self.features, self.trees, self.base = params, features, trees, base

    @classmethod
    def fit(cls, frame: Frame, targets: tuple[str, ...], c: Params, structure: str = "first") -> MultiOutput:
        own = frame.df.select(F.col(f"`{frame.row}`").alias("__row"), *[F.col(f"`{f}`").cast("double").alias(f) for f in frame.features], *[F.col(f"`{t}`").cast("double").alias(f"__t_{t}") for t in targets])
        if frame.df.count() * (len(frame.features) + len(targets)) > LOCAL_CELLS:
            return cls._fit_spark(own, frame.features, [F.col(f"`__t_{t}`") for t in targets], c, structure)
        cols = own.withColumn("__key", sampling.row_key(F.col("__row"))).orderBy("__row").toArrow()
        x, y = (np.stack([cols[n].to_numpy().astype(float) for n in names], 1) for names in (frame.features, [f"__t_{t}" for t in targets]))
        key = cols["__key"].to_numpy()
        base = y.mean(0) if c.boost_from_average else np.full(len(targets), c.base_score)
        m = np.tile(base, (len(x), 1))
        bins, trees = None, []
        for it in range(c.num_trees):
            pairs = [np_gradient(c, m[:, t], y[:, t]) for t in range(y.shape[1])]
            bins = bins or Bins(x, pairs[0][1], c)
            g, h = pairs[0] if structure == "first" else (sum(p[0] for p in pairs), sum(p[1] for p in pairs))
            n = (sampling.uniforms(key, sampling.derive_seed(c.seed, it, 0)) < c.subsample).astype(float)
            tree, node_of = grow(bins, g * n, h * n, n, list(range(x.shape[1])), c, it)
            size = len(tree.nodes)
            sums = [(np.bincount(node_of, p[0] * n, minlength=size), np.bincount(node_of, p[1] * n, minlength=size)) for p in pairs]
            for k, node in enumerate(tree.nodes):
                node.vector = [leaf_value(float(a[k]), float(b[k]), c) if node.is_leaf else 0.0 for a, b in sums]
            m += c.eta * tree.values()[node_of]
            trees.append(tree)
        return cls(c, frame.features, trees, base)

    @classmethod
    def _fit_spark(cls, df: DataFrame, features: tuple[str, ...], targets: list[Column], c: Params, structure: str) -> MultiOutput:
        """The same trees on the cluster: a job for each level, and one for the leaves' vectors."""
        base = np.array([float(v or 0.0) for v in df.agg(*[F.avg(t) for t in targets]).first()]) if c.boost_from_average else np.full(len(targets), c.base_score)
        df = df.select("__row", *[f"`{f}`" for f in features], F.array(*targets).alias("__y"), F.array(*[F.lit(float(v)) for v in base]).alias("__m"))
        pairs = [gradient(c, F.col("__m")[t], F.col("__y")[t]) for t in range(len(targets))]
        rows, cuts = binned(df, df, list(features), c, pairs[0][1])
        rows = rows.select("__row", "__y", "__m", "bins").persist()
        trees = []
        for it in range(c.num_trees):
            own = pairs[:1] if structure == "first" else pairs
            drawn = sampling.sample_rows_by_hash(rows, c.subsample, sampling.derive_seed(c.seed, it, 0), "__row")
            one = drawn.select(sum((p[0] for p in own[1:]), own[0][0]).alias("g"), sum((p[1] for p in own[1:]), own[0][1]).alias("h"), F.lit(1.0).alias("n"), "bins")
            make = spark_grow.grow_by_leaf if c.max_leaves else spark_grow.grow
            tree, _ = make(one, len(features), cuts, c, list(range(len(features))), it)
            sums = {r["__node"]: r for r in spark_grow.placed(drawn, tree, c).groupBy("__node").agg(*[F.sum(v).alias(f"{x}{t}") for t, p in enumerate(pairs) for x, v in zip("gh", p, strict=True)]).collect()}  # a row for each leaf
            for k, node in enumerate(tree.nodes):
                node.vector = [leaf_value(sums[k][f"g{t}"], sums[k][f"h{t}"], c) if node.is_leaf and k in sums else 0.0 for t in range(len(targets))]
            steps = F.array(*[F.array(*[F.lit(float(c.eta * v)) for v in n.vector]) for n in tree.nodes])
            step = F.element_at(steps, F.col("__node") + 1)
            fresh = spark_grow.placed(rows, tree, c).withColumn("__m", F.zip_with("__m", step, lambda a, b: a + b)).drop("__node")
            fresh = fresh.checkpoint() if (it + 1) % CHECKPOINT_EVERY == 0 and _can_checkpoint(fresh.sparkSession) else fresh.persist()
            trees.append(tree)
            if it + 1 < c.num_trees:
                fresh.count()  # so that the old rows can go
            rows.unpersist()
            rows = fresh
        rows.unpersist()
        return cls(c, features, trees, base)

    def numpy_predict(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(x), 1))
        for t in self.trees:
            out += self.params.eta * t.values()[t.leaves(x)]
        return out

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        walker = Booster(self.params, self.features, self.trees)
        return walker._walk(df, out, T.ArrayType(T.DoubleType()), self.numpy_predict)
