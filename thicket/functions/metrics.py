"""Evaluation metrics over columns of prediction and label.

Row metrics are one aggregate Column; ranking metrics are window plans that end
in one row. The numpy forms serve the vectorised kernels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import clamp, log1p_safe
from .objectives import rows_by_group

EPS = 1e-15
#: Metrics of which more is better.
HIGHER = ("auc", "aucpr", "ndcg", "map", "pre")


def higher_is_better(name: str) -> bool:
    return name.split("@")[0] in HIGHER


def _logloss(p: Column, y: Column) -> Column:
    q = clamp(p, EPS, 1 - EPS)
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def _mphe(p: Column, y: Column, slope: float = 1.0) -> Column:
    return F.avg(slope * slope * (F.sqrt(1 + F.pow((p - y) / slope, 2)) - 1))


def _stirling(y: Column) -> Column:
    """log(y!) by lgamma's asymptotic series, shifted by 8 so that it holds from 0 on."""
    z = y + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    shift = F.log((y + 1) * (y + 2)) + F.log((y + 3) * (y + 4)) + F.log((y + 5) * (y + 6)) + F.log((y + 7) * (y + 8))
    return series - shift


def _tweedie(p: Column, y: Column, rho: float) -> Column:
    q = F.greatest(p, F.lit(EPS))
    return F.avg(-y * F.pow(q, F.lit(1 - rho)) / (1 - rho) + F.pow(q, F.lit(2 - rho)) / (2 - rho))


def row_metric(name: str, p: Column, y: Column, rho: float = 1.5) -> Column:
    """An aggregate Column for a metric that is a mean over rows."""
    base, _, arg = name.partition("@")
    q = F.greatest(p, F.lit(EPS)) if not base.startswith("m") or base in ("mape", "mae", "mphe") else p
    made: dict[str, Callable[[], Column]] = {
        "rmse": lambda: F.sqrt(F.avg((p - y) * (p - y))),
        "mae": lambda: F.avg(F.abs(p - y)),
        "rmsle": lambda: F.sqrt(F.avg(F.pow(log1p_safe(p) - log1p_safe(y), 2))),
        "mape": lambda: 100 * F.avg(F.abs(p - y) / F.greatest(F.abs(y), F.lit(EPS))),
        "mphe": lambda: _mphe(p, y),
        "logloss": lambda: _logloss(p, y),
        "error": lambda: F.avg(F.when((p >= (float(arg) if arg and float(arg) > 0 else 0.5)) == (y > 0.5), 0.0).otherwise(1.0)),
        "poisson-nloglik": lambda: F.avg(q - y * F.log(q) + _stirling(y)),
        "gamma-nloglik": lambda: F.avg(F.log(q) + y / q),
        "gamma-deviance": lambda: F.avg(2 * (F.log(q / F.greatest(y, F.lit(EPS))) + (y - q) / q)),
        "tweedie-nloglik": lambda: _tweedie(p, y, float(arg) if arg else rho),
        "merror": lambda: F.avg(F.when(F.array_position(p, F.array_max(p)) - 1 == y.cast("int"), 0.0).otherwise(1.0)),
        "mlogloss": lambda: F.avg(-F.log(clamp(F.element_at(p, y.cast("int") + 1), EPS, 1 - EPS))),
    }
    if base not in made:
        raise ValueError(f"unknown metric {name!r}")
    return made[base]()


def auc(df: DataFrame, p: str = "pred", y: str = "label", group: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties averaged; 0.5 with a single class.

    Equal scores are summed first, so the window runs over distinct scores.
    """
    keys = [group] if group else []
    steps = df.groupBy(*keys, F.col(p).alias("s")).agg(F.sum((F.col(y) > 0.5).cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    below = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("neg", F.col("n") - F.col("pos")).withColumn("neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    total = F.sum("pos") * F.sum("neg")
    value = F.when(total > 0, F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / F.when(total > 0, total)).otherwise(0.5)
    return steps.groupBy(*keys).agg(value.alias("auc"))


def aucpr(df: DataFrame, p: str = "pred", y: str = "label") -> DataFrame:
    """Average precision, where the precision may not rise with the rank at hits."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(p), F.col("row_id"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col(y) > 0.5).cast("double")
    ranked = df.select(hit.alias("hit"), F.row_number().over(order).alias("r"), F.sum(hit).over(so_far).alias("hits")).where("hit = 1")
    low = Window.partitionBy(F.lit(0)).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("pre", F.min(F.col("hits") / F.col("r")).over(low))
    return ranked.agg(F.coalesce(F.avg("pre"), F.lit(0.0)).alias("aucpr"))


def ranking(df: DataFrame, name: str, group: str | None = None, p: str = "pred", y: str = "label", row: str = "row_id", exp_gain: bool = True) -> DataFrame:
    """ndcg@k, map@k or pre@k; the mean over groups, or one value for all rows.

    Ties of the score go by row. Without any relevant row ndcg counts as 1 and the
    others as 0.
    """
    base, _, arg = name.partition("@")
    k = int(arg) if arg else 0
    keys = [F.col(group)] if group else [F.lit(0)]
    by_score, by_label = Window.partitionBy(*keys).orderBy(F.desc(p), row), Window.partitionBy(*keys).orderBy(F.desc(y), row)
    gain = (F.pow(F.lit(2.0), F.col(y)) - 1) if exp_gain else F.col(y).cast("double")
    hit = (F.col(y) > 0).cast("double")
    r = df.select(*([group] if group else []), gain.alias("gain"), hit.alias("hit"), F.row_number().over(by_score).alias("r"), F.row_number().over(by_label).alias("best"), F.sum(hit).over(by_score.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    top = (F.col("r") <= k) if k else F.lit(True)
    size = F.count(F.lit(1))
    if base == "ndcg":
        dcg = F.sum(F.when(top, F.col("gain") / F.log2(F.col("r") + 1.0)).otherwise(0.0))
        ideal = F.sum(F.when((F.col("best") <= k) if k else F.lit(True), F.col("gain") / F.log2(F.col("best") + 1.0)).otherwise(0.0))
        value = F.when(ideal > 0, dcg / F.when(ideal > 0, ideal)).otherwise(1.0)
    elif base == "map":
        total = F.least(F.sum("hit"), F.lit(float(k))) if k else F.sum("hit")
        value = F.when(total > 0, F.sum(F.when(top, F.col("hit") * F.col("hits") / F.col("r")).otherwise(0.0)) / F.when(total > 0, total)).otherwise(0.0)
    elif base == "pre":
        value = F.sum(F.when(top, F.col("hit")).otherwise(0.0)) / (F.least(size, F.lit(k)) if k else size)
    else:
        raise ValueError(f"unknown metric {name!r}")
    each = r.groupBy(*([group] if group else [])).agg(value.alias("v"))
    return each.agg(F.avg("v").alias(base))


def cox_nloglik(df: DataFrame, margin: str = "pred", label: str = "label") -> DataFrame:
    """Negative log partial likelihood (Breslow) per row; |label| is the time."""
    t = F.abs(F.col(label))
    times = df.groupBy(t.alias("t")).agg(F.sum(F.exp(margin)).alias("e"), F.sum((F.col(label) > 0).cast("double")).alias("d"), F.sum(F.when(F.col(label) > 0, F.col(margin)).otherwise(0.0)).alias("m"), F.count(F.lit(1)).alias("n"))
    risk = Window.partitionBy(F.lit(0)).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return times.withColumn("at_risk", F.sum("e").over(risk)).agg((F.sum(F.col("d") * F.log("at_risk") - F.col("m")) / F.sum("n")).alias("cox_nloglik"))


def evaluate(df: DataFrame, name: str, p: str = "pred", y: str = "label", group: str | None = None, row: str = "row_id") -> float:
    """One metric as a number."""
    base = name.split("@")[0]
    if base == "auc":
        out = auc(df, p, y)
    elif base == "aucpr":
        out = aucpr(df.withColumn("row_id", F.col(row)), p, y)
    elif base in ("ndcg", "map", "pre"):
        out = ranking(df, name, group, p, y, row)
    elif base == "cox-nloglik":
        out = cox_nloglik(df, p, y)
    else:
        out = df.agg(row_metric(name, F.col(p), F.col(y)))
    return float(out.first()[0])


def np_metric(name: str, p: np.ndarray, y: np.ndarray, group: np.ndarray | None = None, rho: float = 1.5) -> float:
    """The same over numpy vectors (a matrix of class probabilities for merror, mlogloss)."""
    base, _, arg = name.partition("@")
    d = p - y if p.ndim == 1 else None
    if base == "rmse":
        return float(np.sqrt(np.mean(d * d)))
    if base == "mae":
        return float(np.mean(np.abs(d)))
    if base == "rmsle":
        return float(np.sqrt(np.mean((np.log1p(np.maximum(p, -1 + 1e-15)) - np.log1p(y)) ** 2)))
    if base == "mape":
        return float(100 * np.mean(np.abs(d) / np.maximum(np.abs(y), EPS)))
    if base == "mphe":
        return float(np.mean(np.sqrt(1 + d * d) - 1))
    if base == "logloss":
        q = np.clip(p, EPS, 1 - EPS)
        return float(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))
    if base == "error":
        return float(np.mean((p >= (float(arg) if arg and float(arg) > 0 else 0.5)) != (y > 0.5)))
    if base == "merror":
        return float(np.mean(p.argmax(1) != y.astype(int)))
    if base == "mlogloss":
        return float(-np.mean(np.log(np.clip(p[np.arange(len(y)), y.astype(int)], EPS, 1 - EPS))))
    if base in ("poisson-nloglik", "gamma-nloglik", "gamma-deviance", "tweedie-nloglik"):
        q = np.maximum(p, EPS)
        if base == "poisson-nloglik":
            return float(np.mean(q - y * np.log(q) + np.array([math.lgamma(v + 1) for v in y])))
        if base == "gamma-nloglik":
            return float(np.mean(np.log(q) + y / q))
        if base == "gamma-deviance":
            return float(np.mean(2 * (np.log(q / np.maximum(y, EPS)) + (y - q) / q)))
        rho = float(arg) if arg else rho
        return float(np.mean(-y * q ** (1 - rho) / (1 - rho) + q ** (2 - rho) / (2 - rho)))
    if base == "auc":
        pos = y > 0.5
        if pos.all() or not pos.any():
            return 0.5
        s, at = np.unique(p, return_inverse=True)
        a, b = np.bincount(at, pos), np.bincount(at, ~pos)
        return float((a * (np.cumsum(b) - b / 2)).sum() / (a.sum() * b.sum()))
    if base == "aucpr":
        hit = (y[np.argsort(-p, kind="stable")] > 0.5).astype(float)
        pre = np.minimum.accumulate((np.cumsum(hit) / np.arange(1, len(hit) + 1))[hit > 0])
        return float(pre.mean()) if len(pre) else 0.0
    if base in ("ndcg", "map", "pre"):
        return float(np.mean([_np_rank(base, int(arg or 0), p[at], y[at]) for at in rows_by_group(group)] if group is not None else [_np_rank(base, int(arg or 0), p, y)]))
    if base == "cox-nloglik":
        t = np.abs(y)
        times, at = np.unique(t, return_inverse=True)
        risk = np.cumsum(np.bincount(at, np.exp(p))[::-1])[::-1]
        return float(((y > 0) * (np.log(risk[at]) - p)).sum() / len(y))
    raise ValueError(f"unknown metric {name!r}")


def _np_rank(base: str, k: int, p: np.ndarray, y: np.ndarray) -> float:
    k = min(k or len(y), len(y))
    order = np.argsort(-p, kind="stable")
    if base == "ndcg":
        disc = 1 / np.log2(np.arange(2, k + 2))
        ideal = ((2.0 ** np.sort(y)[::-1][:k] - 1) * disc).sum()
        return float(((2.0 ** y[order][:k] - 1) * disc).sum() / ideal) if ideal > 0 else 1.0
    hit = (y[order] > 0).astype(float)
    if base == "pre":
        return float(hit[:k].sum() / k)
    total = min(hit.sum(), k)
    return float((hit * np.cumsum(hit) / np.arange(1, len(hit) + 1))[:k].sum() / total) if total else 0.0
