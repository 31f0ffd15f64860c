"""Cross-validation and parameter search: many models, fitted side by side.

Folds are a column. Rows of a checked size are sent once; every fold of every
combination is a group of its own, so Spark runs the fits in parallel. Larger
data are fitted on the cluster, one fold of one combination after the other.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import higher_is_better
from ..plans.params import Params
from . import local, sampling
from .booster import LOCAL_CELLS, Booster
from .frame import Frame


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, the last parameter fastest."""
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def random_combinations(space: Mapping[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    r = np.random.default_rng(seed)
    return [{k: v[int(r.integers(len(v)))] for k, v in space.items()} for _ in range(n)]


def cross_validate(frame: Frame, combos: list[Params], k: int = 5, metrics: tuple[str, ...] = ("rmse",), stratified: bool = False, shuffle_seed: int | None = None) -> DataFrame:
    """(combo, fold, split, metric, value) for every fold of every combination.

    Data too large for one fit in a task are fitted on the cluster.
    """
    how = k, frame.row, frame.label if stratified else None, shuffle_seed
    if frame.cells() > LOCAL_CELLS:
        return _cross_validate_spark(frame, sampling.folds_by_edges(frame.selected(), *how), combos, k, metrics)
    rows = sampling.folds(frame.selected(), *how).withColumn("__key", sampling.row_key(F.col(f"`{frame.row}`")))  # row draws follow the ids, as on the cluster
    features, label, weight, group, row = list(frame.features), frame.label, frame.weight, frame.group, frame.row

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        combo, held = key
        c = combos[combo]
        part = part.sort_values(row)

        def data(p: pd.DataFrame) -> local.LocalData:
            return local.LocalData(p[features].to_numpy(float), p[label].to_numpy(float), p[weight].to_numpy(float) if weight else None, None, p[group].to_numpy() if group else None, p["__key"].to_numpy())

        train, test = data(part[part["fold"] != held]), data(part[part["fold"] == held])
        trees, base, _ = local.fit(train, c)
        out = []
        for split, d in (("train", train), ("test", test)):
            m = local.margins(trees, d.x, c, base)
            out += [(combo, held, split, name, local.evaluate(name, m, d.y, c, d.group)) for name in metrics]
        return pd.DataFrame(out, columns=["combo", "fold", "split", "metric", "value"])

    each = rows.withColumn("combo", F.explode(F.sequence(F.lit(0), F.lit(len(combos) - 1)))).withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.groupBy("combo", "held").applyInPandas(one, "combo int, fold int, split string, metric string, value double")


def _cross_validate_spark(frame: Frame, rows: DataFrame, combos: list[Params], k: int, metrics: tuple[str, ...]) -> DataFrame:
    """The same table from fits on the cluster."""
    rows, out = rows.persist(), []
    for held in range(k):
        parts = {"train": rows.where(F.col("fold") != held), "test": rows.where(F.col("fold") == held)}
        train = Frame(parts["train"], frame.features, frame.label, frame.row, frame.weight, None, frame.group)
        for combo, c in enumerate(combos):
            model = Booster.fit(train, c)
            for split, part in parts.items():
                scored = model.margins(part, "__m")
                out += [(combo, held, split, name, model._spark_metric(scored, name, frame.label, frame.group, frame.row)) for name in metrics]
    rows.unpersist()
    return rows.sparkSession.createDataFrame(sorted(out, key=lambda r: r[:2]), "combo int, fold int, split string, metric string, value double")


def summarize(cv: DataFrame) -> DataFrame:
    """(combo, split, metric, mean, std): population deviation over folds."""
    return cv.groupBy("combo", "split", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def search(frame: Frame, base: Params, combos: list[dict], k: int = 5, metrics: tuple[str, ...] = ("rmse",), **how) -> list[tuple[dict, float, float]]:
    """(parameters, mean, deviation) of the first metric on held-out folds, best first."""
    found = summarize(cross_validate(frame, [base.with_(**x) for x in combos], k, metrics, **how)).where((F.col("split") == "test") & (F.col("metric") == metrics[0])).collect()
    up = higher_is_better(metrics[0])
    order = sorted(found, key=lambda r: (-r["mean"] if up else r["mean"], r["combo"]))
    return [(combos[r["combo"]], r["mean"], r["std"]) for r in order]


def grid_search(frame: Frame, base: Params, space: Mapping[str, Sequence], **how) -> list[tuple[dict, float, float]]:
    return search(frame, base, grid(space), **how)


def random_search(frame: Frame, base: Params, space: Mapping[str, Sequence], n: int, seed: int = 0, **how) -> list[tuple[dict, float, float]]:
    return search(frame, base, random_combinations(space, n, seed), **how)
