"""Scalar expressions that the operators share, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Cell = Column | float


def _c(x: Cell) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def sigmoid(x: Column) -> Column:
    """In two branches, so that neither overflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softmax(x: Column) -> Column:
    """Of an array of doubles, shifted by its largest."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def log1p_safe(x: Column) -> Column:
    """log(1 + x), minus infinity from -1 down."""
    return F.when(x <= -1, F.lit(-math.inf)).otherwise(F.log1p(x))


def clamp(x: Column, low: Cell, high: Cell) -> Column:
    return F.greatest(F.least(x, _c(high)), _c(low))


def logit(p: float) -> float:
    return math.log(p / (1 - p)) if 0 < p < 1 else 0.0


def soft_threshold(w: Column, alpha: Cell) -> Column:
    return F.signum(w) * F.greatest(F.abs(w) - _c(alpha), F.lit(0.0))


def gain(gl: Column, hl: Column, gr: Column, hr: Column, gp: Column, hp: Column, lambda_: float = 1.0, alpha: float = 0.0) -> Column:
    """Loss reduction of a split, without the factor a half; 0 for an empty denominator."""

    def part(g: Column, h: Column) -> Column:
        t = soft_threshold(g, alpha) if alpha else g
        return F.when(h + lambda_ > 0, t * t / (h + lambda_)).otherwise(0.0)

    return part(gl, hl) + part(gr, hr) - part(gp, hp)


def leaf_weight(g: Column, h: Column, lambda_: float = 1.0, alpha: float = 0.0, max_delta_step: float = 0.0) -> Column:
    w = F.when(h + lambda_ > 0, -g / F.when(h + lambda_ > 0, h + lambda_)).otherwise(0.0)
    if alpha:
        w = F.when(h + lambda_ > 0, soft_threshold(w, F.lit(float(alpha)) / F.when(h + lambda_ > 0, h + lambda_))).otherwise(0.0)
    return clamp(w, -max_delta_step, max_delta_step) if max_delta_step else w


def missing(x: Column) -> Column:
    """NaN and null are missing; the check comes before any comparison."""
    return x.isNull() | F.isnan(x)


def nan_to_null(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def bin_of(value: Column, cuts: list[float]) -> Column:
    """Number of cuts at or below the value; null for a missing one."""
    table = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.when(missing(value), F.lit(None)).otherwise(F.size(F.filter(table, lambda c: c <= value)))


def clamped_bin_of(value: Column, cuts: list[float]) -> Column:
    """As :func:`bin_of` over float32 values, at most the last bin."""
    return F.least(bin_of(value.cast("float").cast("double"), cuts), F.lit(max(0, len(cuts) - 1)))


def threshold_of(bin_: Column, cuts: list[float]) -> Column:
    table = F.array(*[F.lit(float(c)) for c in cuts])
    return F.element_at(table, clamp(bin_, 0, len(cuts) - 1).cast("int") + 1)
