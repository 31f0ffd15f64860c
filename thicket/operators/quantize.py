"""Weighted quantile cuts and bins.

Distinct float32 values with their weights are a grouped sum in Spark; the prune
and the choice of cuts run once for each feature over distinct values only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import missing
from ..plans.params import Params

#: Distinct values of a feature beyond which they are merged to quantile groups
#: before the exact prune, so that no task gets an unbounded feature.
MAX_DISTINCT = 1 << 20


def summarize(df: DataFrame, features: list[str], weight: Column | None = None) -> DataFrame:
    """(feature, value, w, rmin, rmax): weighted distinct float32 values with ranks.

    One pass over the rows: the features are unpivoted and summed on the map side.
    """
    w = F.lit(1.0) if weight is None else weight
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.when(missing(F.col(f"`{c}`").cast("double")), None).otherwise(F.col(f"`{c}`").cast("float")).alias("value")) for i, c in enumerate(features)])
    values = df.select(F.explode(cells).alias("x"), w.alias("w")).select("x.*", "w").where("value is not null and w > 0")
    distinct = values.groupBy("feature", "value").agg(F.sum("w").alias("w"))
    before = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return distinct.withColumn("rmax", F.sum("w").over(before)).withColumn("rmin", F.col("rmax") - F.col("w")).select("feature", F.col("value").cast("double").alias("value"), "w", "rmin", "rmax")


def prune(value: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """Positions of the at most ``size`` summary entries that keep evenly spaced ranks.

    For each of the equally spaced target ranks, the entry whose rank interval is
    closest is kept, and the first and the last always.
    """
    n = len(value)
    if n <= size:
        return np.arange(n)
    high = np.cumsum(w)
    low = high - w
    targets = 2 * (np.arange(1, size - 1) * (low[-1] - low[0]) / (size - 1) + low[0])
    at = np.maximum(np.searchsorted(low + high, targets, side="right") - 1, 1)
    at = at[: np.searchsorted(at, n - 1)]  # ranks that reach the last entry end the scan
    targets = targets[: len(at)]
    kept = np.where(targets < high[at] + low[at + 1], at, at + 1)
    out = np.concatenate(([0], kept, [n - 1]))
    return out[np.concatenate(([True], np.diff(out) > 0))]


def cuts_of(value: np.ndarray, w: np.ndarray, max_bin: int) -> np.ndarray:
    """Cut values of one feature from its sorted distinct float32 values.

    The smallest value is no cut; a last cut stands above all values.
    """
    if not len(value):
        return np.zeros(0)
    kept = value[prune(value, w, max_bin + 1)].astype(np.float32)
    step = max(1, len(kept) // max_bin)
    inner = np.unique(kept[1 : max(1, len(kept) - step + 1) : step])
    top = np.float32(value[-1])
    last = np.float32(top + np.float32(abs(top) + np.float32(1e-5)))
    return np.concatenate((inner, [last])).astype(np.float64)


def cut_table(df: DataFrame, features: list[str], max_bin: int, weight: Column | None = None) -> list[np.ndarray]:
    """Cuts of every feature: at most ``max_bin`` + 1 values each reach the driver."""
    summary = summarize(df, features, weight)
    per = Window.partitionBy("feature")
    # A feature of very many distinct values is thinned to equal-rank groups first.
    grain = F.max("rmax").over(per) / F.lit(float(MAX_DISTINCT))
    thinned = summary.withColumn("many", F.count(F.lit(1)).over(per) > MAX_DISTINCT).withColumn("slot", F.when(F.col("many"), F.floor(F.col("rmin") / grain).cast("double")).otherwise(F.col("value")))
    small = thinned.groupBy("feature", "slot").agg(F.max("value").alias("value"), F.sum("w").alias("w"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("value")
        return pd.DataFrame({"feature": [key[0]], "cuts": [cuts_of(rows["value"].to_numpy(), rows["w"].to_numpy(), max_bin).tolist()]})

    out = [np.zeros(0)] * len(features)
    for r in small.groupBy("feature").applyInPandas(one, "feature int, cuts array<double>").collect():
        out[r["feature"]] = np.array(r["cuts"])
    return out


def order_statistic_cuts(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(cut): distinct order statistics at positions i * n / bins of the sorted values."""
    order = Window.partitionBy(F.lit(0)).orderBy(column)
    ranked = df.where(~missing(F.col(column))).select(F.col(column).alias("cut"), (F.row_number().over(order) - 1).alias("r"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    at = F.floor(F.lit(1) * F.ceil(F.col("r") * bins / F.col("n")) * F.col("n") / bins)
    return ranked.where((F.col("r") > 0) & (at == F.col("r"))).select("cut").distinct()


def bin_matrix(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of a float matrix, clamped to the last bin; -1 for missing."""
    out = np.empty(x.shape, np.int32)
    for f, c in enumerate(cuts):
        b = np.searchsorted(c, x[:, f], side="right")
        out[:, f] = np.where(np.isnan(x[:, f]), -1, np.minimum(b, max(0, len(c) - 1)))
    return out


def with_bins(df: DataFrame, features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """Adds bins, an array<int> with -1 for missing, by binary search in Arrow batches."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    import pyarrow as pa

    names = [f.name for f in df.schema if f.name != "bins"]
    schema = StructType([*[f for f in df.schema if f.name != "bins"], StructField("bins", ArrayType(IntegerType()))])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(names.index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], 1)
            flat = bin_matrix(x, cuts).ravel()
            bins = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(features), dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], bins], names=schema.names)

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(mapped, schema)


def binned(df: DataFrame, made: DataFrame, features: list[str], c: Params, weight: Column) -> tuple[DataFrame, list[np.ndarray]]:
    """``df`` with bins, and cuts from ``made``, the same rows with their gradients.

    A categorical feature's cuts are its distinct values, which models list, and its
    bins their places. For exact growth bins holds the values themselves (null for
    missing), so that distinct values needn't come to the driver.
    """
    exact = c.tree_method == "exact"
    plain = [] if exact else [i for i in range(len(features)) if i not in c.categorical]
    cuts = [np.zeros(0)] * len(features)
    for i, own in zip(plain, cut_table(made, [features[i] for i in plain], c.max_bin, weight) if plain else [], strict=True):
        cuts[i] = own
    for i in c.categorical:
        x = F.col(f"`{features[i]}`").cast("double").alias("x")
        cuts[i] = np.unique(df.select(x).where(~missing(F.col("x"))).distinct().toArrow()["x"].to_numpy())
    if exact:
        cells = [F.when(~missing(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")) for f in features]
        return df.withColumn("bins", F.array(*cells)), cuts
    return with_bins(df, features, [np.append(k[1:], np.inf) if i in c.categorical and len(k) else k for i, k in enumerate(cuts)]), cuts


class QuantileSketch:
    """A mergeable weighted summary for streams of values.

    Values are buffered and pruned to ``size`` entries; two sketches merge by
    joining their entries and pruning again.
    """

    def __init__(self, size: int = 256):
        self.size, self.value, self.w, self.buffer = size, np.zeros(0), np.zeros(0), []

    def push(self, value: float, weight: float = 1.0) -> None:
        if weight > 0 and value == value:
            self.buffer.append((value, weight))
            if len(self.buffer) >= 8 * self.size:
                self.compress()

    def compress(self) -> None:
        v = np.concatenate((self.value, [x for x, _ in self.buffer]))
        w = np.concatenate((self.w, [y for _, y in self.buffer]))
        self.buffer = []
        self.value, at = np.unique(v, return_inverse=True)
        self.w = np.bincount(at, w, minlength=len(self.value))
        if len(self.value) > 8 * self.size:
            kept = prune(self.value, self.w, 4 * self.size)
            self.w = np.diff(np.concatenate(([0.0], np.cumsum(self.w)[kept])))
            self.value = self.value[kept]

    def merge(self, other: QuantileSketch) -> None:
        other.compress()
        self.buffer += list(zip(other.value.tolist(), other.w.tolist(), strict=True))
        self.compress()

    @property
    def total(self) -> float:
        return float(self.w.sum() + sum(y for _, y in self.buffer))

    def query(self, q: float) -> float:
        self.compress()
        if not len(self.value):
            return float("nan")
        return float(self.value[min(len(self.value) - 1, np.searchsorted(np.cumsum(self.w), q * self.w.sum(), side="left"))])
