"""The linear booster: one aggregate job a round, closed-form steps on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.objectives import gradient, link
from ..plans.params import Params
from .frame import Frame


class LinearBooster:
    """Weights of the features and a bias; missing values count as 0."""

    def __init__(self, params: Params, features: tuple[str, ...], weights: np.ndarray, bias: float):
        self.params, self.features, self.weights, self.bias = params, features, weights, bias

    def margin(self) -> Column:
        total = F.lit(float(self.bias))
        for f, w in zip(self.features, self.weights, strict=True):
            total = total + F.nanvl(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0)) * float(w)
        return total

    @staticmethod
    def sums(df: DataFrame, features: tuple[str, ...], g: Column, h: Column) -> DataFrame:
        """One row: bias_g, bias_h and for each feature the sums of g*x and h*x*x."""
        cols = [F.sum(g).alias("bias_g"), F.sum(h).alias("bias_h")]
        for i, f in enumerate(features):
            x = F.nanvl(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0))
            cols += [F.sum(g * x).alias(f"g{i}"), F.sum(h * x * x).alias(f"h{i}")]
        return df.agg(*cols)

    def round(self, s: dict) -> LinearBooster:
        """The model after one round, from the sums: the bias, then all features at once."""
        c = self.params
        db = -s["bias_g"] / s["bias_h"] if s["bias_h"] > 0 else 0.0
        new = self.weights.copy()
        for i, w in enumerate(self.weights):
            g, h = s[f"g{i}"] + c.lambda_ * w, s[f"h{i}"] + c.lambda_
            if h <= 1e-12:
                continue
            step = -g / h
            if c.alpha:  # the soft threshold is on the weight that the step leads to
                to = w + step
                to = np.sign(to) * max(abs(to) - c.alpha / h, 0.0)
                step = to - w
            new[i] = w + c.eta * step
        return LinearBooster(c, self.features, new, self.bias + c.eta * db)

    @classmethod
    def fit(cls, frame: Frame, c: Params) -> LinearBooster:
        df = frame.selected().persist()
        y, w = F.col(f"`{frame.label}`").cast("double"), F.col(f"`{frame.weight}`").cast("double") if frame.weight else None
        mean = df.agg(F.avg(y)).first()[0] or 0.0
        model = cls(c, frame.features, np.zeros(len(frame.features)), mean if c.objective == "reg:squarederror" and c.boost_from_average else 0.0)
        for _ in range(c.num_trees):
            g, h = gradient(c, model.margin(), y, w)
            model = model.round(cls.sums(df, frame.features, g, h).first().asDict())
        df.unpersist()
        return model

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, link(self.params, self.margin()))


def fit_linear_local(x: np.ndarray, y: np.ndarray, c: Params) -> tuple[np.ndarray, float]:
    """The same rounds over numpy arrays, squared error."""
    x = np.nan_to_num(x)
    w, b = np.zeros(x.shape[1]), float(y.mean()) if c.boost_from_average else 0.0
    for _ in range(c.num_trees):
        g = x @ w + b - y
        s = {"bias_g": g.sum(), "bias_h": float(len(y))} | {f"g{i}": (g * x[:, i]).sum() for i in range(len(w))} | {f"h{i}": (x[:, i] ** 2).sum() for i in range(len(w))}
        m = LinearBooster(c, tuple(map(str, range(len(w)))), w, b).round(s)
        w, b = m.weights, m.bias
    return w, b
