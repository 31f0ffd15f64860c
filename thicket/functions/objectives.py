"""Gradients, hessians and links of the objectives.

Every pointwise objective is a pair of Columns of margin ``p``, label ``y`` and
weight ``w``; the numpy form of the same pair serves the vectorised kernels. The
ranking and Cox objectives need a group's rows together and take a DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.params import Params
from .expressions import log1p_safe, sigmoid, softmax

Pair = tuple[Column, Column]
TINY = 1e-16


def _logistic(p: Column, y: Column, c: Params) -> Pair:
    s = sigmoid(p)
    scale = F.when(y > 0, F.lit(c.scale_pos_weight)).otherwise(1.0) if c.scale_pos_weight != 1 else F.lit(1.0)
    return (s - y) * scale, F.greatest(s * (1 - s), F.lit(TINY)) * scale


def _tweedie(p: Column, y: Column, c: Params) -> Pair:
    rho = c.tweedie_variance_power
    a, b = y * F.exp((1 - rho) * p), F.exp((2 - rho) * p)
    return b - a, (2 - rho) * b - (1 - rho) * a


def _squared_log(p: Column, y: Column, c: Params) -> Pair:
    d = log1p_safe(p) - F.log1p(y)
    return F.when(p > -1, d / (1 + p)).otherwise(0.0), F.when(p > -1, F.greatest((1 - d) / F.pow(1 + p, 2), F.lit(1e-6))).otherwise(1e-6)


def _absolute(p: Column, y: Column, c: Params) -> Pair:
    d = p - y
    near = F.abs(d) < 1e-8
    return F.when(near, 0.0).otherwise(F.signum(d)), F.when(near, 1.0).otherwise(1 / F.when(~near, F.abs(d)))


def _pseudo_huber(p: Column, y: Column, c: Params) -> Pair:
    d, k = p - y, c.huber_slope
    root = F.sqrt(k * k + d * d)
    return k * d / root, k * k / F.pow(root, 3) * (1.0 if c.compat else k)


def _quantile(p: Column, y: Column, c: Params) -> Pair:
    a = c.quantile_alpha if not c.compat else 1 - c.quantile_alpha
    return F.when(p >= y, F.lit(1 - a)).otherwise(F.lit(-a)), F.lit(1.0)


def _hinge(p: Column, y: Column, c: Params) -> Pair:
    z = 2 * y - 1
    return F.when(z * p < 1, -z).otherwise(0.0), F.lit(1.0)


def _gamma(p: Column, y: Column, c: Params) -> Pair:
    r = y * F.exp(-p)
    return 1 - r, r * F.exp(-p) if c.compat else r


def _aft(p: Column, y: Column, c: Params) -> Pair:
    """Censored log-likelihood: a negative label is a lower bound of the time."""
    k = c.aft_scale
    z = (F.log(F.greatest(F.abs(y), F.lit(1e-6))) - p) / k
    if c.aft_distribution == "normal":
        pdf = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        upper = F.greatest(_normal_tail(z), F.lit(1e-12))
        hazard = pdf / upper
        g, h = -z / k, F.lit(1 / (k * k))
        gc, hc = -hazard / k, hazard * (hazard - z) / (k * k)
    elif c.aft_distribution == "logistic":
        s = sigmoid(z)
        g, h = (1 - 2 * s) / k, 2 * s * (1 - s) / (k * k)
        gc, hc = -s / k, s * (1 - s) / (k * k)
    else:
        e = F.exp(F.least(z, F.lit(30.0)))
        g, h = (1 - e) / k, e / (k * k)
        gc, hc = -e / k, e / (k * k)
    event = y >= 0
    return F.when(event, g).otherwise(gc), F.greatest(F.when(event, h).otherwise(hc), F.lit(TINY))


#: Chebyshev coefficients of erfc (Press et al., fractional error under 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _normal_tail(z: Column) -> Column:
    """1 - Phi(z)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(_ERFC[-1])
    for c in _ERFC[-2::-1]:
        poly = c + t * poly
    tail = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, tail).otherwise(1 - tail)


POINTWISE: dict[str, Callable[[Column, Column, Params], Pair]] = {
    "reg:squarederror": lambda p, y, c: (p - y, F.lit(1.0)),
    "reg:logistic": _logistic, "binary:logistic": _logistic, "binary:logitraw": _logistic,
    "count:poisson": lambda p, y, c: (F.exp(p) - y, F.exp(p)),
    "reg:gamma": _gamma, "reg:tweedie": _tweedie, "reg:squaredlogerror": _squared_log, "reg:absoluteerror": _absolute,
    "reg:pseudohubererror": _pseudo_huber, "reg:quantileerror": _quantile, "binary:hinge": _hinge, "survival:aft": _aft,
}


def gradient(c: Params, margin: Column, label: Column, weight: Column | None = None) -> Pair:
    """Columns g and h of a pointwise objective; the weight multiplies both."""
    g, h = POINTWISE[c.objective](margin, label, c)
    return (g, h) if weight is None else (g * weight, h * weight)


def class_gradient(margins: Column, label: Column, classes: int, weight: Column | None = None) -> tuple[Column, Column]:
    """Arrays of g and h, one for each class, of the softmax objectives."""
    q = softmax(margins)
    w = F.lit(1.0) if weight is None else weight
    g = F.transform(q, lambda v, k: (v - F.when(k == label.cast("int"), 1.0).otherwise(0.0)) * w)
    return g, F.transform(q, lambda v: F.greatest(v * (1 - v), F.lit(TINY)) * w)


def link(c: Params, margin: Column) -> Column:
    """What a margin (an array of them for classes) means to the user."""
    if c.objective in ("reg:logistic", "binary:logistic"):
        return sigmoid(margin)
    if c.objective in ("count:poisson", "reg:gamma", "reg:tweedie", "survival:cox", "survival:aft"):
        return F.exp(margin)
    if c.objective == "binary:hinge":
        return F.when(margin > 0, 1.0).otherwise(0.0)
    if c.objective == "multi:softprob":
        return softmax(margin)
    if c.objective == "multi:softmax":
        return (F.array_position(margin, F.array_max(margin)) - 1).cast("double")
    return margin


def pair_gradient(df: DataFrame, objective: str, group: str = "group_id", row: str = "row_id", margin: str = "margin", label: str = "label", exp_gain: bool = True) -> DataFrame:
    """(group, row, g, h) of the pairwise ranking objectives, as a join within groups.

    Each pair with different labels adds a logistic gradient, weighed for rank:ndcg
    by the change of NDCG and for rank:map by the change of average precision when
    the two rows swap places. Groups meet by an equi-join on the group, so their
    pairs are spread over tasks; no group is collected.
    """
    by_score = Window.partitionBy(group).orderBy(F.desc(margin), F.col(row))
    by_label = Window.partitionBy(group).orderBy(F.desc(label), F.col(row))
    whole = Window.partitionBy(group)
    worth = (F.pow(F.lit(2.0), F.col(label)) - 1) if exp_gain else F.col(label).cast("double")
    ranked = df.select(group, row, F.col(margin).cast("double").alias("m"), F.col(label).cast("double").alias("y"), F.row_number().over(by_score).alias("r"), F.row_number().over(by_label).alias("best"), worth.alias("gain"))
    if objective == "rank:ndcg":
        ranked = ranked.withColumn("idcg", F.sum(F.col("gain") / F.log2(F.col("best") + 1.0)).over(whole))
    elif objective == "rank:map":
        so_far = Window.partitionBy(group).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
        hit = F.when(F.col("y") > 0, 1.0).otherwise(0.0)
        ranked = ranked.withColumn("hits", F.sum(hit).over(so_far)).withColumn("total", F.sum(hit).over(whole))
        ranked = ranked.withColumn("pre", F.sum(hit / F.col("r")).over(so_far))
    names = [c for c in ranked.columns if c != group]
    left = ranked.select(group, *[F.col(c).alias(f"{c}_a") for c in names])
    right = ranked.select(group, *[F.col(c).alias(f"{c}_b") for c in names])
    pairs = left.join(right, group).where(F.col("y_a") > F.col("y_b"))
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    if objective == "rank:ndcg":
        change = F.abs((a("gain") - b("gain")) * (1 / F.log2(a("r") + 1.0) - 1 / F.log2(b("r") + 1.0)))
        weight = F.when(a("idcg") > 0, change / a("idcg")).otherwise(0.0)
    elif objective == "rank:map":
        # Row a is relevant, row b is not; swapping moves the hit from r_a to r_b.
        down = a("hits") / a("r") - b("hits") / b("r") + b("pre") - a("pre")
        up = (b("hits") + 1) / b("r") - a("hits") / a("r") + (a("pre") - 1 / a("r")) - b("pre")
        weight = F.when((a("total") > 0) & (a("y") > 0) & (b("y") <= 0), F.abs(F.when(a("r") < b("r"), down).otherwise(up)) / a("total")).otherwise(0.0)
    else:
        weight = F.lit(1.0)
    rho = sigmoid(b("m") - a("m"))
    pairs = pairs.select(group, a(row).alias("ra"), b(row).alias("rb"), (rho * weight).alias("l"), (F.greatest(rho * (1 - rho), F.lit(TINY)) * weight).alias("h"))
    both = pairs.select(group, F.explode(F.array(F.struct(F.col("ra").alias(row), (-F.col("l")).alias("g"), "h"), F.struct(F.col("rb").alias(row), F.col("l").alias("g"), "h"))).alias("x")).select(group, "x.*")
    return both.groupBy(group, row).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def cox_gradient(df: DataFrame, row: str = "row_id", margin: str = "margin", label: str = "label", stratum: str | None = None) -> DataFrame:
    """(row, g, h) of the Breslow partial likelihood; |label| is the time, label > 0 an event.

    The risk set of a time is all rows with at least that time; ties share it.
    """
    keys = [F.lit(0)] if stratum is None else [F.col(stratum)]
    t, e = F.abs(F.col(label)), F.exp(F.col(margin))
    base = df.select(*([stratum] if stratum else []), row, t.alias("t"), (F.col(label) > 0).alias("event"), e.alias("e"))
    times = base.groupBy(*([stratum] if stratum else []), "t").agg(F.sum("e").alias("e"), F.sum(F.col("event").cast("double")).alias("d"))
    risk = Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    times = times.withColumn("at_risk", F.sum("e").over(risk))
    times = times.withColumns({"r1": F.sum(F.col("d") / F.col("at_risk")).over(past), "r2": F.sum(F.col("d") / F.pow("at_risk", F.lit(2))).over(past)})
    on = ["t"] + ([stratum] if stratum else [])
    out = base.join(times.select(*on, "r1", "r2"), on)
    return out.select(row, (F.col("e") * F.col("r1") - F.col("event").cast("double")).alias("g"), (F.col("e") * F.col("r1") - F.col("e") * F.col("e") * F.col("r2")).alias("h"))


# ---- the same pairs over numpy vectors, for the vectorised kernels ----


def np_sigmoid(p: np.ndarray) -> np.ndarray:
    return np.where(p >= 0, 1 / (1 + np.exp(-np.abs(p))), np.exp(-np.abs(p)) / (1 + np.exp(-np.abs(p))))


def np_softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def np_gradient(c: Params, p: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """g and h; for classes, matrices of rows by classes."""
    o = c.objective
    if c.custom_objective is not None:
        g, h = c.custom_objective(p, y, w)
        return np.asarray(g, float), np.asarray(h, float)
    if c.classes > 1:
        q = np_softmax(p)
        g, h = q - (np.arange(c.classes)[None, :] == y[:, None].astype(int)), np.maximum(q * (1 - q), TINY)
    elif o == "reg:squarederror":
        g, h = p - y, np.ones_like(p)
    elif o in ("reg:logistic", "binary:logistic", "binary:logitraw"):
        s = np_sigmoid(p)
        k = np.where(y > 0, c.scale_pos_weight, 1.0)
        g, h = (s - y) * k, np.maximum(s * (1 - s), TINY) * k
    elif o == "count:poisson":
        g, h = np.exp(p) - y, np.exp(p)
    elif o == "reg:gamma":
        r = y * np.exp(-p)
        g, h = 1 - r, r * np.exp(-p) if c.compat else r
    elif o == "reg:tweedie":
        rho = c.tweedie_variance_power
        a, b = y * np.exp((1 - rho) * p), np.exp((2 - rho) * p)
        g, h = b - a, (2 - rho) * b - (1 - rho) * a
    elif o == "reg:squaredlogerror":
        q = np.maximum(p, -1 + 1e-9)
        d = np.log1p(q) - np.log1p(y)
        g, h = np.where(p > -1, d / (1 + q), 0.0), np.where(p > -1, np.maximum((1 - d) / (1 + q) ** 2, 1e-6), 1e-6)
    elif o == "reg:absoluteerror":
        d = p - y
        near = np.abs(d) < 1e-8
        g, h = np.where(near, 0.0, np.sign(d)), np.where(near, 1.0, 1 / np.maximum(np.abs(d), 1e-8))
    elif o == "reg:pseudohubererror":
        d, k = p - y, c.huber_slope
        root = np.sqrt(k * k + d * d)
        g, h = k * d / root, k * k / root**3 * (1.0 if c.compat else k)
    elif o == "reg:quantileerror":
        a = c.quantile_alpha if not c.compat else 1 - c.quantile_alpha
        g, h = np.where(p >= y, 1 - a, -a), np.ones_like(p)
    elif o == "binary:hinge":
        z = 2 * y - 1
        g, h = np.where(z * p < 1, -z, 0.0), np.ones_like(p)
    elif o == "survival:aft":
        g, h = _np_aft(c, p, y)
    elif o == "survival:cox":
        g, h = _np_cox(p, y)
    else:
        g, h = _np_pairs(c, p, y, group if group is not None else np.zeros(len(p), int))
    if w is not None:
        g, h = (g * w[:, None], h * w[:, None]) if g.ndim == 2 else (g * w, h * w)
    return g, h


def _np_aft(c: Params, p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, event = c.aft_scale, y >= 0
    z = (np.log(np.maximum(np.abs(y), 1e-6)) - p) / k
    if c.aft_distribution == "normal":
        tail = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z])
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-12)
        g, h, gc, hc = -z / k, np.full_like(z, 1 / (k * k)), -hazard / k, hazard * (hazard - z) / (k * k)
    elif c.aft_distribution == "logistic":
        s = np_sigmoid(z)
        g, h, gc, hc = (1 - 2 * s) / k, 2 * s * (1 - s) / (k * k), -s / k, s * (1 - s) / (k * k)
    else:
        e = np.exp(np.minimum(z, 30))
        g, h, gc, hc = (1 - e) / k, e / (k * k), -e / k, e / (k * k)
    return np.where(event, g, gc), np.maximum(np.where(event, h, hc), TINY)


def _np_cox(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, e, event = np.abs(y), np.exp(p), (y > 0).astype(float)
    times, at = np.unique(t, return_inverse=True)
    risk = np.cumsum(np.bincount(at, e)[::-1])[::-1]
    d = np.bincount(at, event)
    r1, r2 = np.cumsum(d / risk)[at], np.cumsum(d / risk**2)[at]
    return e * r1 - event, np.maximum(e * r1 - e * e * r2, TINY)


#: Pairs of one group that are looked at at once.
_PAIRS = 1 << 18


def rows_by_group(group: np.ndarray) -> list[np.ndarray]:
    """The places of each group's rows, in their order; one sort, whatever the number of groups."""
    order = np.argsort(group, kind="stable")
    return np.split(order, np.unique(group[order], return_index=True)[1][1:])


def _np_pairs(c: Params, p: np.ndarray, y: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g, h = np.zeros(len(p)), np.zeros(len(p))
    for at in rows_by_group(group):
        if not len(at) or group[at[0]] != group[at[0]]:  # rows without a group meet no others, as in a join
            continue
        m, lab, n = p[at], y[at], len(at)
        rank = np.empty(n)
        rank[np.argsort(-m, kind="stable")] = np.arange(1, n + 1)
        if c.objective == "rank:ndcg":
            worth = 2.0**lab - 1 if c.ndcg_exp_gain else lab
            ideal = (np.sort(worth)[::-1] / np.log2(np.arange(2, n + 2))).sum()
        elif c.objective == "rank:map":
            order = np.argsort(rank)
            hit = (lab[order] > 0).astype(float)
            hits, pre = np.empty(n), np.empty(n)
            hits[order], pre[order] = np.cumsum(hit), np.cumsum(hit / np.arange(1, n + 1))
        step = max(1, _PAIRS // n)
        for i in range(0, n, step):
            a, b = np.nonzero(lab[i : i + step, None] > lab[None, :])
            a += i
            if c.objective == "rank:ndcg":
                wt = np.abs((worth[a] - worth[b]) * (1 / np.log2(rank[a] + 1) - 1 / np.log2(rank[b] + 1))) / ideal if ideal > 0 else np.zeros(len(a))
            elif c.objective == "rank:map":
                down = hits[a] / rank[a] - hits[b] / rank[b] + pre[b] - pre[a]
                up = (hits[b] + 1) / rank[b] - hits[a] / rank[a] + (pre[a] - 1 / rank[a]) - pre[b]
                wt = np.where((lab[a] > 0) & (lab[b] <= 0), np.abs(np.where(rank[a] < rank[b], down, up)), 0.0) / max(1.0, hit.sum())
            else:
                wt = np.ones(len(a))
            rho = np_sigmoid(m[b] - m[a])
            lam, hess = rho * wt, np.maximum(rho * (1 - rho), TINY) * wt
            g[at] += np.bincount(b, lam, minlength=n) - np.bincount(a, lam, minlength=n)
            h[at] += np.bincount(a, hess, minlength=n) + np.bincount(b, hess, minlength=n)
    return g, h


def np_link(c: Params, m: np.ndarray) -> np.ndarray:
    if c.objective in ("reg:logistic", "binary:logistic"):
        return np_sigmoid(m)
    if c.objective in ("count:poisson", "reg:gamma", "reg:tweedie", "survival:cox", "survival:aft"):
        return np.exp(m)
    if c.objective == "binary:hinge":
        return (m > 0).astype(float)
    if c.objective == "multi:softprob":
        return np_softmax(m)
    if c.objective == "multi:softmax":
        return m.argmax(1).astype(float)
    return m
