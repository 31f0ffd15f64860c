"""One document of each group of near copies, by banded SimHash tries.

For texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more, a 64-bit fingerprint at two bits is too narrow: such pairs differ in about
a seventh of their bits. So the stage takes 256 bits, eight bands of 32, and asks
for a band with at most three differing bits. In each band one of four quarters
is then equal, so a trie (one for each quarter, that quarter first) is walked only
below nodes that share their first 8 bits. Pairs found are weighed by all 256
bits; a task sends a minimum spanning forest of them. Texts with equal sets are
one entry; every link between different sets is checked by exact Jaccard. Where a
link fails, the entries of that group outside its largest part walk the tries again
with all of the group, and the pairs found between its parts are checked on the spot:
only links that hold and join two parts are sent, never the pairs.

Defined cases: texts without words are one group; a null id is kept only if its
group has no other; repeated rows are copies of each other; an empty table gives
an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, map_texts, materialize, text_bytes
from .components import components
from .simhash import fingerprint, pairs_within, shingle_hashes

SHINGLE, SIMILAR = 5, 0.8
LANES, BAND_BUDGET = 4, 3
#: Of 256 bits, pairs of Jaccard 0.8 differ in about 38 (deviation 6): up to CLOSE
#: bits a link is checked.
CLOSE = 50
#: Entries of a trie node that meet in one task.
NODE_ENTRIES = 8192
#: Shingle sets that meet in a task for checks: of small components together, and
#: of each side of a part of a large one.
SMALL_SETS, PART_SETS = 2048, 64
#: Entries, and bytes of their sets, of each side of a task that joins parts again.
SIDE_ENTRIES, SIDE_BYTES = 1024, 32 << 20


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(shingle_hashes(text, size))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """Four SimHash lanes of 64 bits from one hash of each distinct shingle."""
    out = []
    for lane in range(LANES):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (lane + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(fingerprint(x ^ (x >> np.uint64(29))))
    return np.array(out, "<i8").tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def spanning_forest(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Positions of the pairs that make a minimum spanning forest (Boruvka's rounds)."""
    label, chosen, alive = np.arange(n), [], np.lexsort((j, i, d))
    while True:
        alive = alive[label[i[alive]] != label[j[alive]]]
        if not len(alive):
            break
        ends = np.concatenate((label[i[alive]], label[j[alive]]))
        order = np.concatenate((np.arange(len(alive)), np.arange(len(alive))))
        first = np.full(n, len(alive))
        np.minimum.at(first, ends, order)
        picked = alive[np.unique(first[first < len(alive)])]
        chosen.append(picked)
        x, y = i[picked], j[picked]
        while True:
            low = label.copy()
            np.minimum.at(low, label[x], label[y])
            np.minimum.at(low, label[y], label[x])
            low = low[low[label]]
            if (low == label).all():
                break
            label = low
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _first_trie(x: np.ndarray) -> np.ndarray:
    """The first trie in which a pair is found; ``x`` holds its differing bits by band."""
    first = np.full(len(x), -1)
    for band in range(2 * LANES - 1, -1, -1):
        for quarter in range(3, -1, -1):
            own = (np.bitwise_count(x[:, band]) <= BAND_BUDGET) & ((x[:, band] >> np.uint32(24 - 8 * quarter)) & np.uint32(255) == 0)
            first[own] = band * 4 + quarter
    return first


def _turned(band: np.ndarray, quarter: int) -> np.ndarray:
    """Bands of 32 bits with that quarter first."""
    return (band << np.uint32(8 * quarter)) | (band >> np.uint32(32 - 8 * quarter)) if quarter else band


def _tries(entries: DataFrame) -> DataFrame:
    """(t, p, fp, v, wide): each entry once for every band and quarter."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, 2 * LANES)
            for t in range(8 * LANES):
                x = _turned(wide[:, t // 4], t % 4)
                columns = [pa.array(np.full(len(x), t, np.int32)), pa.array((x >> np.uint32(24)).astype(np.int32)), pa.array(x.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *batch.columns], names=["t", "p", "fp", "v", "wide"])

    return entries.select("v", "wide").mapInArrow(mapped, "t int, p int, fp long, v long, wide binary")


def near_links(entries: DataFrame, node_entries: int = NODE_ENTRIES) -> DataFrame:
    """(u, v, d): spanning forests of the pairs in reach; d of 256 bits differ.

    A node with over ``node_entries`` entries is dealt into parts, and each pair
    of parts meets in a task of its own.
    """
    tries = _tries(entries)
    nodes = tries.groupBy("t", "p").count()
    full = materialize(nodes.where(F.col("count") > node_entries).select(F.col("t").alias("ft"), F.col("p").alias("fp_"), F.ceil(F.col("count") / node_entries).cast("int").alias("m")), "full")
    many = full.agg(F.coalesce(F.max("m"), F.lit(1))).first()[0]
    if many == 1:
        dealt = tries.withColumns({"c": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    else:  # at most 8192 nodes are in this table
        parts = tries.join(F.broadcast(full), (F.col("t") == F.col("ft")) & (F.col("p") == F.col("fp_")), "left").withColumn("m", F.coalesce("m", F.lit(1)))
        parts = parts.withColumn("c", F.pmod(F.xxhash64("v"), F.col("m")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        dealt = parts.withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o")})

    def walk(table: pa.Table) -> pa.Table:
        fp, c = table.column("fp").to_numpy().astype(np.uint64) << np.uint64(32), table.column("c").to_numpy()
        v, wide = table.column("v").to_numpy(), np.frombuffer(b"".join(table.column("wide").to_pylist()), "<u8").reshape(-1, LANES)
        split = len(c) and c.min() != c.max()
        order = np.argsort(fp, kind="stable")
        a = order[c[order] == c.min()] if split else order
        b = order[c[order] != c.min()] if split else order
        i, j = pairs_within(fp[a], fp[b], BAND_BUDGET, not split, 8, 0)
        i, j = a[i], b[j]
        kept = [np.zeros((3, 0), np.int64)]
        for k in range(0, len(i), 1 << 20):
            x, y = i[k : k + (1 << 20)], j[k : k + (1 << 20)]
            d = np.bitwise_count(wide[x] ^ wide[y]).sum(1, dtype=np.int64)
            near = (d <= CLOSE) & (x != y)
            kept.append(np.stack((x[near], y[near], d[near])))
        i, j, d = np.concatenate(kept, 1)
        rank = np.empty(len(v), np.int64)
        rank[np.argsort(v)] = np.arange(len(v))  # ties go by v, so that nodes send the same pairs
        keep = spanning_forest(np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j]), d, len(v))
        return pa.table({"u": v[i[keep]], "v": v[j[keep]], "d": d[keep].astype(np.int32)}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64()), ("d", pa.int32())]))

    found = dealt.select("t", "p", "i", "j", "c", "fp", "v", "wide").groupBy("t", "p", "i", "j").applyInArrow(walk, "u long, v long, d int")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "d").distinct()


def _thinned(links: DataFrame) -> DataFrame:
    """Links (u, v, d, part) that still join what all of them join, cheapest first."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sent() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                u, v, d = (t.column(c).to_numpy() for c in ("u", "v", "d"))
                names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
                yield from t.take(pa.array(np.sort(spanning_forest(at[: len(u)], at[len(u) :], d, len(names))))).to_batches()
                held.clear()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > 1 << 20:
                yield from sent()
        yield from sent()

    return links.repartition("part").sortWithinPartitions("part").mapInArrow(mapped, links.schema)


def _sets(docs: DataFrame, entries: DataFrame, links: DataFrame, text: str, size: int) -> DataFrame:
    """(k, own): the shingle sets of the links' entries."""
    ends = links.select(F.explode(F.array("u", "v")).alias("e")).distinct()
    rows = entries.join(ends, F.col("v") == F.col("e"), "left_semi").select("v", F.col("best.r1").alias("b1"), F.col("best.r2").alias("b2"))
    texts = docs.select(F.col(f"`{text}`").alias("__t"), "__r1", "__r2").join(rows.hint("merge"), (F.col("__r1") == F.col("b1")) & (F.col("__r2") == F.col("b2")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t, size).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["k", "own"])

    return materialize(texts.select("v", F.col("__t").cast("string")).mapInArrow(sets, "k long, own binary").dropDuplicates(["k"]), "sets")


def _verified(links: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """(u, v): those of the links (u, v, part) whose shingle sets are similar enough.

    ``part`` is the candidate component. A task gets each set once: of many small
    components, or of two parts of a large one.
    """
    ends = links.select("part", F.explode(F.array("u", "v")).alias("k")).distinct()
    sizes = materialize(ends.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / PART_SETS).cast("int").alias("m")), "sizes")
    groups = 1 + sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] * PART_SETS // SMALL_SETS
    pairs = links.join(sizes, "part").withColumns({"cu": F.pmod(F.xxhash64("u"), F.col("m")), "cv": F.pmod(F.xxhash64("v"), F.col("m"))})
    small = F.col("m") == 1
    pairs = pairs.select("u", "v", F.when(small, F.pmod(F.xxhash64("part"), F.lit(groups))).otherwise(F.col("part")).alias("g"), F.when(small, F.lit(-1)).otherwise(F.least("cu", "cv")).alias("i"), F.when(small, F.lit(-1)).otherwise(F.greatest("cu", "cv")).alias("j"))
    pairs = materialize(pairs, "pairs")
    members = pairs.select("g", "i", "j", F.explode(F.array("u", "v")).alias("k")).distinct().join(own.hint("merge"), "k").select(F.col("g").alias("mg"), F.col("i").alias("mi"), F.col("j").alias("mj"), "k", "own")

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {k: np.frombuffer(x, np.uint64) for k, x in zip(right.column("k").to_pylist(), right.column("own").to_pylist(), strict=True)}
        ok = [jaccard(sets[u], sets[v]) >= least for u, v in zip(left.column("u").to_pylist(), left.column("v").to_pylist(), strict=True)]
        return left.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.groupBy("g", "i", "j").cogroup(members.groupBy("mg", "mi", "mj")).applyInArrow(alike, "u long, v long")


def _rejoined(entries: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """(u, v): links that join the roots of entries (v, wide, part, root) of one part.

    Entries outside their part's largest root (strays) meet all entries of the part.
    Both are dealt over shares, so that a task holds at most about SIDE_ENTRIES of
    each; small parts share tasks. Pairs in reach between different roots are checked
    by exact Jaccard, nearest first, unless links of the task join their roots already.
    """
    sized = materialize(entries.join(own.select("k", F.length("own").alias("bytes")), F.col("v") == F.col("k")).drop("k"), "sized")
    roots = sized.groupBy("part", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    parts = roots.groupBy(F.col("part").alias("p")).agg(F.max(F.struct("n", "root", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    full = F.greatest(F.col("n") / SIDE_ENTRIES, F.col("bytes") / SIDE_BYTES)
    strays = F.greatest((F.col("n") - F.col("top.n")) / SIDE_ENTRIES, (F.col("bytes") - F.col("top.bytes")) / SIDE_BYTES, F.lit(1))
    shares = parts.select("p", "n", F.col("top.root").alias("main"), full.alias("full"), F.ceil(full).cast("int").alias("m"), F.ceil(strays).cast("int").alias("s"))
    shares = materialize(shares, "shares")
    groups = 1 + int(shares.where("m = 1").agg(F.coalesce(F.sum("full"), F.lit(0.0))).first()[0])
    dealt = join_hot(sized, shares.drop("full"), ["part"], ["p"], "n")
    group = F.when(F.col("m") == 1, F.pmod(F.xxhash64("part"), F.lit(groups))).otherwise(F.col("part")).alias("g")

    def share(of: str) -> Column:
        return F.pmod(F.xxhash64("v"), F.col(of)).cast("int")

    def each(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    rest = ["v", "wide", "part", "root", (F.col("root") == F.col("main")).alias("inside")]
    left = dealt.where("root <> main").select(group, share("s").alias("i"), each("m").alias("j"), F.lit(0).alias("side"), *rest)
    right = dealt.select(group, each("s").alias("i"), share("m").alias("j"), F.lit(1).alias("side"), *rest)
    members = left.unionByName(right).join(own.hint("merge"), F.col("v") == F.col("k")).drop("k")

    def joined(table: pa.Table) -> pa.Table:
        v, part, root, side = (table.column(c).to_numpy() for c in ("v", "part", "root", "side"))
        inside = table.column("inside").to_numpy()
        wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), "<u8").reshape(-1, LANES)
        bands, kept = wide.view("<u4"), [np.zeros((3, 0), np.int64)]
        for t in range(8 * LANES):
            fp = _turned(bands[:, t // 4], t % 4).astype(np.uint64) << np.uint64(32)
            a, b = (np.flatnonzero(side == k) for k in range(2))
            a, b = a[np.argsort(fp[a], kind="stable")], b[np.argsort(fp[b], kind="stable")]
            i, j = pairs_within(fp[a], fp[b], BAND_BUDGET, False, 8, 0)
            i, j = a[i], b[j]
            apart = (part[i] == part[j]) & (root[i] != root[j]) & (inside[j] | (v[i] < v[j]))
            i, j = i[apart], j[apart]
            bits = wide[i] ^ wide[j]
            d = np.bitwise_count(bits).sum(1, dtype=np.int64)
            near = (d <= CLOSE) & (_first_trie(bits.view("<u4")) == t)
            kept.append(np.stack((i[near], j[near], d[near])))
        i, j, d = np.concatenate(kept, 1)
        sets, at = table.column("own"), np.unique(root, return_inverse=True)[1].tolist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in sets.chunks for x in chunk]
        label, links = list(range(len(v))), []

        def top(x: int) -> int:
            while label[x] != x:
                label[x] = x = label[label[x]]
            return x

        for k in np.lexsort((v[j], v[i], d)).tolist():
            x, y = int(i[k]), int(j[k])
            small, large = sorted((len(sets[x]), len(sets[y])))
            p, q = top(at[x]), top(at[y])
            if p != q and small >= least * large and jaccard(sets[x], sets[y]) >= least:
                label[p] = q
                links.append((v[x], v[y]))
        u, w = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"u": u, "v": w}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return members.groupBy("g", "i", "j").applyInArrow(joined, "u long, v long")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """The row with the smallest id of each group; all columns of ``docs``."""
    key = F.col(f"`{id_col}`").cast("string"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.withColumns({"__r1": F.xxhash64(*key), "__r2": F.xxhash64(key[1], F.lit("row"), key[0])})

    def make() -> Callable:
        def work(texts: list[bytes]) -> list[list]:
            sets = [shingle_set(t, size) for t in texts]
            return [[xxhash.xxh3_128_digest(h.tobytes()) for h in sets], [wide_fingerprint(h) for h in sets]]

        return work

    fields = [T.StructField("same", T.BinaryType()), T.StructField("wide", T.BinaryType())]
    own = materialize(map_texts(keyed.withColumn("__t", key[1]), [id_col, "__r1", "__r2"], "__t", fields, make), "wide")
    rank = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col("__r1").alias("r1"), F.col("__r2").alias("r2"))
    entries = materialize(own.groupBy("same").agg(F.min(rank).alias("best"), F.min("wide").alias("wide")).withColumn("v", F.xxhash64("same")), "entries")
    found = materialize(near_links(entries), "near")
    place = components(found.select("u", "v")).select(F.col("u").alias("k"), F.col("v").alias("part"))
    found = found.join(place, F.col("u") == F.col("k"), "left").select("u", "v", "d", F.coalesce("part", "u").alias("part"))
    tree = materialize(_thinned(found).select("u", "v", "part"), "tree")
    sets = _sets(keyed, entries, tree, text, size)
    passed = materialize(_verified(tree, sets, least), "passed")
    roots = components(passed)
    # A pair that no forest sent is settled unless a link on its forest path failed: walk such groups again.
    root = roots.select(F.col("u").alias("rk"), F.col("v").alias("root"))
    failed = tree.join(passed, ["u", "v"], "left_anti").select("part").distinct()
    members = place.select("k", "part").unionByName(place.select(F.col("part").alias("k"), "part").distinct()).join(failed, "part", "left_semi")
    again = materialize(entries.join(members, F.col("v") == F.col("k")).join(root, F.col("v") == F.col("rk"), "left").select("v", "wide", "part", F.coalesce("root", "v").alias("root")), "again")
    if not again.isEmpty():
        roots = components(passed.unionByName(_rejoined(again, sets, least)))
    placed = entries.join(roots.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left").withColumn("root", F.coalesce("root", "v"))
    keepers = materialize(placed.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.r1").alias("k1"), F.col("best.r2").alias("k2")), "keepers")
    kept = keyed.join(keepers.hint("merge"), (F.col("__r1") == F.col("k1")) & (F.col("__r2") == F.col("k2")), "left_semi")
    if not own.groupBy("__r1", "__r2").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__r1", "__r2"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
