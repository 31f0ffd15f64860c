"""Connected components over a table of links, without leaving the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


#: A vertex's links are dealt over this many keys, so that the hub of a large
#: component is work for many tasks.
DEAL = 64
#: Links that a task holds at once for its forest.
FOREST_LINKS = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (vertex, smallest vertex of its component) that join what u-v joins."""
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y, root = at[: len(u)], at[len(u) :], np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _forests(links: DataFrame) -> DataFrame:
    """Links (u, v) that join what ``links`` joins: stars, of FOREST_LINKS of a task at a time."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sent() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(2))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= FOREST_LINKS:
                yield sent()
        if held:
            yield sent()

    return links.select("u", "v").mapInArrow(mapped, "u long, v long")


def _lowest(links: DataFrame) -> DataFrame:
    """Each link (u, v) with m, the smallest neighbour of u.

    The minimum is taken for each (u, share of u's links) first, and one exchange
    serves it and the join. Only shares that have links get a copy of the result, so
    no copy is made in vain.
    """
    dealt = links.withColumn("deal", F.pmod(F.xxhash64("v"), F.lit(DEAL)).cast("int")).repartition("u", "deal")
    parts = dealt.groupBy("u", "deal").agg(F.min("v").alias("m"))
    low = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("deal").alias("deals"))
    low = low.select(F.col("u").alias("k"), "m", F.explode("deals").alias("share"))
    return dealt.join(low.hint("merge"), (F.col("u") == F.col("k")) & (F.col("deal") == F.col("share"))).select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))  # repeats go in the small star


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _lowest(down)
    # A link to the smallest neighbour stays; the other neighbours link to it.
    return moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v): every vertex but the smallest of its component, and that smallest.

    ``links`` has long columns u and v; direction, repeats and loops don't matter.
    First each task replaces its links by stars, which leaves fewer links and shorter
    paths. Then large-star and small-star steps alternate until nothing changes; every
    round is written to the shared folder, so the lineage stays short.
    """
    spark = links.sparkSession
    down = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(_forests(down.distinct()), "links")
    state = _state(now)
    while state[0]:
        after = materialize(_small_star(_large_star(now)), "star")
        new = _state(after)
        drop_table(spark, now)
        now = after
        if new == state:
            break
        state = new
    return now
