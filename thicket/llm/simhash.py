"""SimHash near-dedup by a binary-trie self-join.

Every text gets a 64-bit fingerprint; equal fingerprints are one entry. The
distinct fingerprints form a binary trie, cut into leaf nodes of bounded size at
a depth that follows the number of entries (and deeper where a node is too full).
Pairs of nodes are made only if their prefixes differ in at most the error budget;
a task then walks two subtrees together, bit by bit, adds up differing bits and
prunes a pair of nodes once the budget is exceeded. Links become components by
large-star / small-star rounds.

Defined cases: a null or empty text, or one of white space only, has fingerprint
zero and links like any other; a null id keeps its row and is never a component's
id unless all its ids are null; repeated rows share a component; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, map_texts, materialize
from .components import components, forest

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Entries of a trie node that is one block of work.
NODE_ENTRIES = 4096


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included."""
    words = text.lower().split()  # A-Z only, and ASCII white space only
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; as a signed long."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``keep`` columns and fp (long)."""

    def make() -> Callable:
        return lambda texts: [[fingerprint(shingle_hashes(t, size)) for t in texts]]

    return map_texts(docs, keep, text, [T.StructField("fp", T.LongType())], make)


def pairs_within(a: np.ndarray, b: np.ndarray, budget: int, same: bool, head: int = 0, head_budget: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sorted arrays at ``budget`` or fewer differing bits.

    The arrays are tries in disguise: a node is a range of entries that share
    their leading bits. A frontier of node pairs goes down one bit at a time.
    Pairs with over ``head_budget`` differences in the first ``head`` bits may be
    left out. With ``same``, each pair of one array comes once.
    """
    alo, ahi = np.array([0]), np.array([len(a)])
    blo, bhi = np.array([0]), np.array([len(b)])
    err, left, right = np.array([0]), [], []
    for bit in range(63, -1, -1):
        if not len(alo):
            break
        small = (ahi - alo) * (bhi - blo) <= 16
        if small.any():  # few entries: compare them at once
            la, lb = (ahi - alo)[small], (bhi - blo)[small]
            n = la * lb
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(lb, n)
            i, j = np.repeat(alo[small], n) + off // width, np.repeat(blo[small], n) + off % width
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            left.append(i[near])
            right.append(j[near])
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                break
        one = np.uint64(1 << bit)
        ones_a = np.concatenate(([0], np.cumsum((a & one) != 0)))
        ones_b = np.concatenate(([0], np.cumsum((b & one) != 0)))
        amid, bmid = ahi - (ones_a[ahi] - ones_a[alo]), bhi - (ones_b[bhi] - ones_b[blo])
        parts, most = [], head_budget if 64 - bit <= head else budget
        for lo1, hi1, lo2, hi2, e in ((alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), (amid, ahi, blo, bmid, err + 1)):
            ok = (lo1 < hi1) & (lo2 < hi2) & (e <= most)
            if same:  # a pair of nodes of one trie is met from both sides
                ok &= lo1 <= lo2
            parts.append([x[ok] for x in (lo1, hi1, lo2, hi2, e)])
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(alo):  # equal values on both sides
        n = (ahi - alo) * (bhi - blo)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(bhi - blo, n)
        left.append(np.repeat(alo, n) + off // width)
        right.append(np.repeat(blo, n) + off % width)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _flips(bits: int, budget: int, head: int, head_budget: int) -> list[int]:
    """Masks over the first ``bits`` bits that the budgets allow."""
    out = []
    for n in range(budget + 1):
        for places in itertools.combinations(range(bits), n):  # place 0 is the first bit
            if sum(x < head for x in places) <= head_budget:
                mask = sum(1 << (bits - 1 - x) for x in places)
                out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def trie_nodes(entries: DataFrame, node_entries: int = NODE_ENTRIES) -> DataFrame:
    """(t, depth, prefix, entries): leaf nodes of the tries t over ``entries`` (t, fp).

    A node at the first depth with at most ``node_entries`` entries is a leaf; the
    last depth is 64, where a node has one entry.
    """
    total, tries = entries.agg(F.count(F.lit(1)), F.count_distinct("t")).first()
    depth = max(1, min(60, int(total / max(1, tries) / node_entries).bit_length()))
    rest, leaves = entries.select("t", "fp"), None
    while True:
        at = rest.withColumn("prefix", F.shiftrightunsigned("fp", 64 - depth))
        full = at.groupBy("t", "prefix").count().where(F.col("count") > node_entries).select("t", "prefix")
        done = depth == 64 or full.isEmpty()
        if not done:
            full = materialize(full, "full")
        own = (at if done else at.join(full, ["t", "prefix"], "left_anti")).withColumn("depth", F.lit(depth))
        leaves = own if leaves is None else leaves.unionByName(own)
        if done:
            break
        rest = materialize(at.join(full, ["t", "prefix"], "left_semi").select("t", "fp"), "rest")
        depth = min(64, depth + 6)
    return materialize(leaves.groupBy("t", "depth", "prefix").agg(F.collect_list("fp").alias("entries")), "nodes")


def node_pairs(nodes: DataFrame, budget: int, head: int, head_budget: int) -> DataFrame | None:
    """Pairs of leaf nodes of one trie whose prefixes the budgets allow."""
    ids = nodes.select("t", "depth", "prefix")
    depths = sorted(r[0] for r in ids.select("depth").distinct().collect())  # at most 11
    out = None
    for low in depths:
        own = ids.where(F.col("depth") == low).select(F.col("t").alias("ot"), F.col("depth").alias("d1"), F.col("prefix").alias("p1"))
        masks = _flips(low, budget, head, head_budget)
        for high in (d for d in depths if d >= low):
            other = ids.where(F.col("depth") == high).select("t", F.col("depth").alias("d2"), F.col("prefix").alias("p2"))
            cut = F.shiftrightunsigned("p2", high - low) if high > low else F.col("p2")
            reach = other.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).select("t", "d2", "p2", cut.bitwiseXOR(F.col("mask")).alias("to"))
            pairs = reach.join(own, (F.col("t") == F.col("ot")) & (F.col("to") == F.col("p1")))
            if high == low:
                pairs = pairs.where("p1 <= p2")
            pairs = pairs.select("t", "d1", "p1", "d2", "p2")
            out = pairs if out is None else out.unionByName(pairs)
    return out


def links(entries: DataFrame, budget: int = BUDGET, node_entries: int = NODE_ENTRIES) -> DataFrame:
    """(u, v): links that connect exactly what fingerprint pairs in reach connect.

    ``entries`` has distinct fingerprints in column fp. There are two tries, over
    the bits as they are and with their halves exchanged: of up to ``budget``
    differing bits, one half holds at most half. So each walk prunes early. Each
    pair of nodes sends a spanning forest of the pairs it finds, so a dense group
    can't flood the result.
    """
    both = entries.select(F.explode(F.array(F.struct(F.lit(0).alias("t"), "fp"), F.struct(F.lit(1).alias("t"), F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)").alias("fp")))).alias("x")).select("x.*")
    nodes = trie_nodes(both, node_entries)
    head, head_budget = 32, budget // 2
    pairs = node_pairs(nodes, budget, head, head_budget)
    if pairs is None:
        return entries.sparkSession.createDataFrame([], "u long, v long")
    # A node goes once to each pair that it is part of, by one exchange; its two
    # halves then lie next to each other.
    same = (F.col("d1") == F.col("d2")) & (F.col("p1") == F.col("p2"))
    pair = F.struct(F.xxhash64("t", "d1", "p1", "d2", "p2").alias("g"), "d1", "p1", "d2", "p2", same.alias("own"))
    first = pairs.select("t", F.col("d1").alias("depth"), F.col("p1").alias("prefix"), pair.alias("pair"), F.lit(0).alias("side"))
    second = pairs.where(~same).select("t", F.col("d2").alias("depth"), F.col("p2").alias("prefix"), pair.alias("pair"), F.lit(1).alias("side"))
    reach = first.unionByName(second).select(F.col("t").alias("rt"), F.col("depth").alias("rd"), F.col("prefix").alias("rp"), "pair", "side")
    met = (F.col("t") == F.col("rt")) & (F.col("depth") == F.col("rd")) & (F.col("prefix") == F.col("rp"))
    halves = nodes.join(reach.hint("merge"), met).select("t", "pair.*", "side", "entries")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, held, key = np.uint64(32), None, None
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            names = list(zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True))
            for name, own, side, entries in zip(names, batch.column(6).to_pylist(), batch.column(7).to_pylist(), batch.column(8), strict=True):
                x = np.sort(np.asarray(entries.values).view(np.uint64))
                if side == 0:
                    held, key = x, name
                    if not own:
                        continue
                if key != name:
                    raise ValueError("half of a pair of nodes is missing")
                a, b = held, x
                i, j = pairs_within(a, b, budget, own, head, head_budget)
                ok = a[i] != b[j]
                if ok.any():
                    x, y = a[i[ok]], b[j[ok]]
                    if name[0]:
                        x, y = (x << half) | (x >> half), (y << half) | (y >> half)
                    u, v = forest(x.view(np.int64), y.view(np.int64))
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    work = halves.select("t", "g", "d1", "p1", "d2", "p2", "own", "side", "entries").repartition("g").sortWithinPartitions("g", "t", "d1", "p1", "d2", "p2", "side")
    return work.mapInArrow(walk, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The id, fp (long) and component_id: the smallest id in reach, itself included."""
    own = materialize(fingerprints(docs, [id_col], text, size), "fp")
    entries = materialize(own.groupBy("fp").agg(F.min(f"`{id_col}`").alias("low"), F.count(F.lit(1)).alias("n")), "entries")
    roots = components(links(entries, budget))
    placed = entries.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    table = placed.select("fp", "root", "n").join(lowest, "root").select(F.col("fp").alias("__fp"), "component_id", F.col("n").alias("__n"))
    return join_hot(own, materialize(table, "placed"), ["fp"], ["__fp"], "__n").drop("__fp")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
