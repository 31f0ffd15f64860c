"""Row and column sampling.

Column draws come from a Mersenne twister on the driver. Row draws hash the row id,
so they need no order, and numpy and Spark draw the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = (1 << 64) - 1


def draws(seed: int, n: int) -> np.ndarray:
    """n uniform doubles in [0, 1): 32-bit outputs of MT19937 divided by 2**32."""
    return np.random.RandomState(seed & 0xFFFFFFFF).randint(0, 1 << 32, size=n, dtype=np.uint32) / 2.0**32


def derive_seed(seed: int, iteration: int, kind: int) -> int:
    """A 32-bit seed for one use in one iteration (an LCG step and a splitmix finish)."""
    x = (seed + iteration * 6364136223846793005 + kind * 1442695040888963407) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return (x ^ (x >> 31)) & 0xFFFFFFFF


def sample_rows(n: int, share: float, seed: int) -> np.ndarray:
    return np.arange(n) if share >= 1 else np.flatnonzero(draws(seed, n) < share)


def sample_by_gradient(g: np.ndarray, share: float, seed: int) -> np.ndarray:
    """int(n * share) rows with replacement, in proportion to |g|; an array of counts."""
    n, p = len(g), np.abs(g)
    if p.sum() <= 0:
        return np.bincount(sample_rows(n, share, seed), minlength=n)
    picked = np.searchsorted(np.cumsum(p), draws(seed, int(n * share)) * p.sum(), side="right")
    return np.bincount(np.minimum(picked, n - 1), minlength=n)


def in_row_order(df: DataFrame, row: str) -> DataFrame:
    """The rows in the order of their ids, over all partitions; __part counts those."""
    return df.repartitionByRange(row).sortWithinPartitions(row).withColumn("__part", F.spark_partition_id())


#: Draws that are made at once.
_CHUNK = 1 << 20


def _draws_within(seed: int, n: int, keep: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Of the n numbers of :func:`draws`, what ``keep`` takes of each chunk and its start."""
    r, out = np.random.RandomState(seed & 0xFFFFFFFF), [np.zeros(0)]
    for i in range(0, n, _CHUNK):
        out.append(keep(r.randint(0, 1 << 32, size=min(_CHUNK, n - i), dtype=np.uint32) / 2.0**32, i))
    return np.concatenate(out)


def drawn_by_gradient(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """:func:`sample_by_gradient` of rows (g, h, n, __part, ...) in row order; g, h and n count a row's draws.

    Each task makes all draws, a chunk at a time, and keeps those that fall on its
    stretch of the summed |g|. Only a count and a sum of each part reach the driver.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            part, g = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k in np.unique(part):
                own = total.setdefault(int(k), [0, 0.0])
                own[0] += int((part == k).sum())
                own[1] += float(np.abs(g[part == k]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1] for x in total.values()], pa.float64())], names=["part", "n", "s"])

    parts = rows.select("__part", "g").mapInArrow(summed, "part int, n long, s double").orderBy("part").collect()
    place = {r["part"]: i for i, r in enumerate(parts)}
    size = [r["n"] for r in parts]
    rows_before, before = np.concatenate(([0], np.cumsum(size))).astype(np.int64), np.concatenate(([0.0], np.cumsum([r["s"] for r in parts])))
    count, whole = int(rows_before[-1]), float(before[-1])

    def own_draws(at: int) -> np.ndarray:
        if whole <= 0:  # no gradients: each row with the given share
            low, high = rows_before[at], rows_before[at + 1]
            return _draws_within(seed, count, lambda u, i: u[max(0, low - i) : max(0, high - i)])
        low, high = before[at], before[at + 1] if at + 1 < len(size) else np.inf
        return np.sort(_draws_within(seed, int(count * share), lambda u, i: u[(u * whole >= low) & (u * whole < high)] * whole))

    names = [c for c in rows.columns if c != "__part"]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list] = {}
        for batch in batches:
            part, g = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("__part", "g"))
            copies = np.zeros(len(part))
            for k in np.unique(part):
                at, here = place[int(k)], part == k
                if int(k) not in state:
                    state[int(k)] = [own_draws(at), 0, before[at], 0]  # draws, those used, |g| and rows so far
                mine = state[int(k)]
                end = mine[3] + int(here.sum())
                if whole <= 0:
                    copies[here] = (mine[0][mine[3] : end] < share) if share < 1 else 1
                else:
                    upto = mine[2] + np.cumsum(np.abs(g[here]))
                    used = np.searchsorted(mine[0], upto, side="left")
                    if end == size[at]:
                        used[-1] = len(mine[0])
                    copies[here] = np.diff(used, prepend=mine[1])
                    mine[1], mine[2] = int(used[-1]), float(upto[-1])
                mine[3] = end
            kept = pa.array(copies > 0)
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            for c in ("g", "h", "n"):
                out[c] = pa.array(out[c].to_numpy(zero_copy_only=False) * copies)
            yield pa.RecordBatch.from_arrays([out[c].filter(kept) for c in names], names=names)

    return rows.mapInArrow(drawn, T.StructType([rows.schema[c] for c in names]))


def bootstrap(n: int, seed: int) -> np.ndarray:
    """How often each of n rows is drawn in n draws with replacement."""
    return np.bincount((draws(seed, n) * n).astype(np.int64), minlength=n)


def sample_columns(columns: list[int], share: float, seed: int, weights: tuple[float, ...] = ()) -> list[int]:
    """At least one column; with weights, the likelier a column the larger its weight."""
    if share >= 1 or not columns:
        return list(columns)
    u = draws(seed, len(columns))
    if weights:
        keep = max(1, round(share * len(columns)))
        w = np.array([weights[c] for c in columns])
        order = np.argsort(np.where(w > 0, -np.log(np.maximum(u, 1e-12)) / np.maximum(w, 1e-300), np.inf))
        return sorted(columns[k] for k in order[:keep])
    out = [c for c, x in zip(columns, u, strict=True) if x < share]
    return out or [columns[int(u.argmin())]]


#: Primes of XXH64 (fixed values).
_PRIMES = tuple(np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hash_long(value: np.ndarray | int, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of one 8-byte integer, as Spark's xxhash64 takes a long (unsigned)."""
    p1, p2, p3, p4, p5 = _PRIMES
    value, seed = np.broadcast_arrays(np.atleast_1d(np.asarray(value, np.int64)).view(np.uint64), np.atleast_1d(np.asarray(seed, np.uint64)))
    h = seed + p5 + np.uint64(8)
    h = _turned(h ^ (_turned(value * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def row_key(row: Column) -> Column:
    """What row draws are made from: a hash of the row's id, whatever its type."""
    return F.xxhash64(row)


def hashed_uniform(row: Column, seed: int) -> Column:
    """A uniform double in [0, 1) from a row's id, the same under any partitioning."""
    return F.pmod(F.xxhash64(row, F.lit(seed).cast("long")), F.lit(1 << 30)) / float(1 << 30)


def uniforms(key: np.ndarray, seed: int) -> np.ndarray:
    """:func:`hashed_uniform` in numpy, from the rows' :func:`row_key`."""
    return (hash_long(seed, np.asarray(key, np.int64).view(np.uint64)) & np.uint64((1 << 30) - 1)) / float(1 << 30)


def sample_rows_by_hash(df: DataFrame, share: float, seed: int, row: str = "row_id") -> DataFrame:
    return df if share >= 1 else df.where(hashed_uniform(F.col(row), seed) < share)


#: P(copies <= k) of a Poisson(1) count; eight copies are the most.
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(8)])


def copies_of(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts for uniform draws."""
    return np.searchsorted(_POISSON, u, side="right")


def with_multiplicity(df: DataFrame, seed: int, row: str = "row_id") -> DataFrame:
    """Adds copies: a Poisson(1) count by the row's hash, the large-scale bootstrap."""
    u = hashed_uniform(F.col(row), seed)
    copies = F.lit(len(_POISSON))
    for k in range(len(_POISSON) - 1, -1, -1):
        copies = F.when(u < float(_POISSON[k]), k).otherwise(copies)
    return df.withColumn("copies", copies)


def folds(df: DataFrame, k: int, row: str = "row_id", label: str | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """Adds fold: contiguous blocks in row order (hashed order if shuffled), in each label if given.

    The first ``n mod k`` folds have one row more.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    keys = [F.col(label)] if label else [F.lit(0)]
    order = F.col(row) if shuffle_seed is None else F.xxhash64(F.col(row), F.lit(shuffle_seed))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, F.col(row))) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    base, more = F.floor(n / k), n % k
    edge = more * (base + 1)
    fold = F.when(place < edge, F.floor(place / (base + 1))).otherwise(more + F.floor((place - edge) / F.greatest(base, F.lit(1))))
    return df.withColumn("fold", F.least(fold, F.lit(k - 1)).cast("int"))


#: Values of a label up to which folds of each label are dealt by edges.
_LABELS = 100


def folds_by_edges(df: DataFrame, k: int, row: str = "row_id", label: str | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """:func:`folds` of large data: no task sorts all rows, and rows stay in their partitions.

    The rows that begin a fold are found by the sizes of ranges of row ids; only
    these sizes and k - 1 ids for each label reach the driver. A label of more than
    ``_LABELS`` values has windows that are spread by it.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    if label and df.select(label).distinct().limit(_LABELS + 1).count() > _LABELS:
        return folds(df, k, row, label, shuffle_seed)
    order = F.col(row) if shuffle_seed is None else F.xxhash64(F.col(row), F.lit(shuffle_seed))
    keys = df.select(order.alias("o"), F.col(row).alias("r"), (F.col(label) if label else F.lit(0)).alias("l"))
    keys = keys.repartitionByRange("o", "r").withColumn("part", F.spark_partition_id()).persist()
    sizes: dict = {}
    for x in keys.groupBy("l", "part").count().orderBy("part").collect():
        sizes.setdefault(x["l"], []).append((x["part"], x["count"]))
    wanted = []
    for own, parts in sizes.items():
        n = sum(size for _, size in parts)
        for first in {i * (n // k) + min(i, n % k) for i in range(1, k)} - {n}:
            for part, size in parts:
                if 0 <= first < size:
                    wanted.append((own, part, first + 1))
                first -= size
    fold = F.lit(0)
    if wanted:
        at = df.sparkSession.createDataFrame(wanted, T.StructType([T.StructField("own", keys.schema["l"].dataType), T.StructField("at", T.IntegerType()), T.StructField("nth", T.IntegerType())]))
        placed = keys.where(F.col("part").isin(sorted({x[1] for x in wanted}))).withColumn("place", F.row_number().over(Window.partitionBy("l", "part").orderBy("o", "r")))
        found = placed.join(F.broadcast(at), F.col("l").eqNullSafe(F.col("own")) & (F.col("part") == F.col("at")) & (F.col("place") == F.col("nth")))
        for x in found.collect():  # k - 1 rows for each label at most
            past = (order > x["o"]) | (order == x["o"]) & (F.col(row) >= x["r"])
            past &= F.col(label).eqNullSafe(F.lit(x["l"])) if label else F.lit(True)
            fold += F.coalesce(past, F.lit(False)).cast("int")
    keys.unpersist()
    return df.withColumn("fold", fold.cast("int"))
