"""Suffix-array dedup: bytes covered by long strings that start anywhere else.

A string of LENGTH bytes is dropped if it starts at two places of the corpus. The
places are compared through sampled suffixes: every window of LENGTH bytes picks
the anchor with the smallest rolling hash of ANCHOR bytes inside it, so equal
windows pick equal anchors at equal offsets. Consecutive windows with one anchor
form a stretch; a stretch is the unit of the index (anchor, hash of its bytes).

The index is a logarithmic family: documents come in batches, each batch's
sampled suffixes are sorted by anchor into a level of their own, merge-scanned
against the levels that exist for anchors met before, and levels of equal size
merge, so that a batch is rewritten a logarithmic number of times. Stretches whose
bytes recur whole need no more work. Where an anchor recurs but a stretch does not
(the edges of a repeat), suffix arrays over the stretches that share the anchor
find the windows that are equal: in sorted order, equal windows are neighbours.

Defined cases: a null or empty text has no bytes; texts under LENGTH bytes lose
nothing; repeated rows repeat each other and lose all bytes that lie in a long
string; runs of one byte or period repeat themselves; a null id keeps its row; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_codec import rolling
from .common import drop_table, materialize, text_bytes

LENGTH, ANCHOR, BATCHES = 400, 64, 4
#: Stretches of one anchor that one task compares (larger groups are spread over
#: tasks), and of these the number that one suffix array holds.
GROUP, IN_ARRAY = 2048, 256


def _keyed(docs: DataFrame, id_col: str, text: str, keep: list[str]) -> DataFrame:
    """``keep``, the text (__t) and two hashes of id and text; equal rows share them."""
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").cast("string").alias("__i"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    return out.withColumns({"r1": F.xxhash64("__i", "__t"), "r2": F.xxhash64("__t", F.lit("row"), "__i")}).drop("__i")


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size, cur = 1, h
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = width - size
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def stretches(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each stretch of a text.

    The anchor is the leftmost place of the smallest hash, so no two windows of one
    stretch are equal.
    """
    if len(text) < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    h = rolling(np.frombuffer(text, np.uint8), anchor)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    bits = np.uint64(len(h).bit_length())  # the low bits give way to the place
    low = _sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
    at = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    place = (low[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return h[place], at, np.concatenate((at[1:], [len(low)])) - at


_STRETCH = T.StructType([T.StructField("r1", T.LongType()), T.StructField("r2", T.LongType()), T.StructField("a", T.LongType()), T.StructField("s", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("seen", T.IntegerType())])


def stretch_table(docs: DataFrame, id_col: str, text: str, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Each stretch of each text: row hashes, anchor, hash of its bytes, windows.

    A stretch that a text holds several times is one row with ``seen`` 2; all
    windows of such stretches follow as rows without an anchor, neighbours merged,
    since a text of short periods would else have a row every few bytes.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for r1, r2, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                a, at, n = stretches(t, length, anchor)
                if not len(a):
                    continue
                s = np.array([xxhash.xxh3_64_intdigest(t[x : x + k - 1 + length]) for x, k in zip(at.tolist(), n.tolist(), strict=True)], np.uint64)
                _, first, back, count = np.unique(s, return_index=True, return_inverse=True, return_counts=True)
                twice = np.flatnonzero(count[back] > 1)
                local_at, local_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(twice):
                    lo, hi = at[twice], at[twice] + n[twice]
                    start = np.flatnonzero(np.concatenate(([True], lo[1:] != hi[:-1])))
                    local_at, local_n = lo[start], np.append(hi[start[1:] - 1], hi[-1]) - lo[start]
                rows, more = len(first), len(local_at)
                cols[0] += [r1] * (rows + more)
                cols[1] += [r2] * (rows + more)
                cols[2] += a[first].view(np.int64).tolist() + [None] * more
                cols[3] += s[first].view(np.int64).tolist() + [None] * more
                cols[4] += at[first].tolist() + local_at.tolist()
                cols[5] += n[first].tolist() + local_n.tolist()
                cols[6] += np.minimum(count, 2).tolist() + [2] * more
                if len(cols[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_STRETCH.names)
                    cols = [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_STRETCH.names)

    return _keyed(docs, id_col, text, []).select("r1", "r2", "__t").mapInArrow(mapped, _STRETCH)


class SuffixIndexFamily:
    """Levels of sampled suffixes: (a, s, seen, place of one), sorted by anchor.

    ``seen`` says how often the bytes of a stretch were met (2: twice or more).
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # rank and table

    @staticmethod
    def _sorted(entries: DataFrame) -> DataFrame:
        merged = entries.groupBy("a", "s").agg(F.least(F.sum("seen"), F.lit(2)).cast("int").alias("seen"), F.min("place").alias("place"))
        return merged.sortWithinPartitions("a", "s")

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of stretches; returns (a): its anchors that the batch or a level has again."""
        own = batch.select("a", "s", "seen", F.struct("r1", "r2", "at", "n").alias("place"))
        level = materialize(self._sorted(own), "level")
        scan = level.select("a", F.lit(True).alias("new"), "seen")
        for _, old in self.levels:
            scan = scan.unionByName(old.select("a", F.lit(False).alias("new"), "seen"))
        met = materialize(scan.groupBy("a").agg(F.max("new").alias("new"), F.sum("seen").alias("n")).where("new and n > 1").select("a"), "met")
        rank = 0
        while (same := next((x for x in self.levels if x[0] == rank), None)) is not None:
            merged = materialize(self._sorted(level.unionByName(same[1])), "level")
            self.levels.remove(same)
            drop_table(batch.sparkSession, level)
            drop_table(batch.sparkSession, same[1])
            level, rank = merged, rank + 1
        self.levels.append((rank, level))
        return met

    def entries(self) -> DataFrame:
        """All levels as one (a, s, seen, place)."""
        tables = [t for _, t in self.levels]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return self._sorted(out) if len(tables) > 1 else out


def equal_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part a mask over its windows: does an equal one start elsewhere?

    A suffix array (cut at ``length`` bytes) over the parts; equal neighbours match.
    Over IN_ARRAY parts, 64-bit digests of the windows are compared in its place,
    which needs 8 bytes a window and not its text.
    """
    if len(parts) > IN_ARRAY:
        each = [window_digests(p, length) for p in parts]
        _, back, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        return np.split(count[back] > 1, np.cumsum([len(x) for x in each])[:-1])
    order = sorted((p[i : i + length], k, i) for k, p in enumerate(parts) for i in range(len(p) - length + 1))
    out = [np.zeros(max(0, len(p) - length + 1), bool) for p in parts]
    for (x, k, i), (y, m, j) in zip(order, order[1:]):
        if x == y:
            out[k][i] = out[m][j] = True
    return out


def window_digests(part: bytes, length: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(part[i : i + length]) for i in range(len(part) - length + 1)], np.uint64)


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def removal_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """(r1, r2, spans): first and last-plus-one byte of what each row loses, not merged."""
    table = materialize(stretch_table(docs, id_col, text, length, anchor), "stretches")
    family, met = SuffixIndexFamily(), None
    sampled = table.where("a is not null")
    for k in range(batches):
        new = family.add(sampled.where(F.pmod(F.col("r1"), F.lit(batches)) == k))
        met = new if met is None else met.unionByName(new)
    met = materialize(met.distinct().withColumnRenamed("a", "ma"), "met")
    entries = materialize(family.entries().join(met.hint("merge"), F.col("a") == F.col("ma")).drop("ma"), "entries")
    # Anchors with a stretch that stands alone, although the anchor recurs.
    open_ = materialize(entries.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.min("seen").alias("least")).where("kinds > 1 and least = 1").select(F.col("a").alias("oa"), "kinds"), "open")
    edges = entries.join(open_.hint("merge"), F.col("a") == F.col("oa")).select("a", "s", "kinds", "place.*")
    wanted = edges.groupBy(F.col("r1").alias("w1"), F.col("r2").alias("w2")).agg(F.collect_list(F.struct("a", "s", "kinds", "at", "n")).alias("want"))
    found = _edge_windows(_fetch(docs, id_col, text, wanted, length), length)
    whole = entries.where("seen > 1").select("a", "s", F.array(F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("end"))).alias("spans"))
    status = materialize(whole.unionByName(found).groupBy("a", "s").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumnsRenamed({"a": "sa", "s": "ss"}), "status")
    hit = sampled.join(status.hint("merge"), (F.col("a") == F.col("sa")) & (F.col("s") == F.col("ss")))
    whole_span = f"struct(at as first, at + n - 1 + {length} as end)"
    span = F.expr(f"explode(transform(spans, x -> if(x.first < 0, {whole_span}, struct(at + x.first as first, at + x.end - 1 + {length} as end))))")
    local = table.where("a is null").select("r1", "r2", F.expr(whole_span).alias("x"))
    return hit.select("r1", "r2", span.alias("x")).unionByName(local).groupBy("r1", "r2").agg(F.collect_set("x").alias("spans"))


_PART = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.LongType()), T.StructField("kinds", T.LongType()), T.StructField("part", T.BinaryType())])
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _fetch(docs: DataFrame, id_col: str, text: str, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted stretches, one row each."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for t, want in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for w in want:
                    for c, x in zip(cols, (w["a"], w["s"], w["kinds"], t[w["at"] : w["at"] + w["n"] - 1 + length]), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_PART.names)

    texts = _keyed(docs, id_col, text, []).join(wanted.hint("merge"), (F.col("r1") == F.col("w1")) & (F.col("r2") == F.col("w2")))
    return texts.select("__t", "want").mapInArrow(mapped, _PART)


def _edge_windows(parts: DataFrame, length: int) -> DataFrame:
    """(a, s, spans): windows of edge stretches that start elsewhere too."""
    schema = T.StructType([*_PART.fields[:2], T.StructField("spans", _SPANS)])
    arrow_spans = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    parts = materialize(parts, "parts").dropDuplicates(["a", "s"])  # equal rows fetch equal bytes

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, group = None, []

        def made() -> pa.RecordBatch:
            rows = [(held_a, s, [{"first": x, "end": y} for x, y in _spans(m)]) for (s, _), m in zip(group, equal_windows([p for _, p in group], length), strict=True) if m.any()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], arrow_spans)], names=schema.names)

        for batch in batches:
            for a, s, part in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if a != held_a:
                    if group:
                        yield made()
                    held_a, group = a, []
                group.append((s, part))
        if group:
            yield made()

    small = parts.where(F.col("kinds") <= GROUP).select("a", "s", "part")
    one = small.repartition("a").sortWithinPartitions("a", "s").mapInArrow(grouped, schema)

    # Larger groups: every window's digest is counted over all tasks.
    window = T.StructType([*_PART.fields[:2], T.StructField("i", T.IntegerType()), T.StructField("w", T.LongType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, s, part in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                w = window_digests(part, length).view(np.int64)
                n = len(w)
                yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([s] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(w)], names=window.names)

    large = parts.where(F.col("kinds") > GROUP).select("a", "s", "part").mapInArrow(spread, window)
    large = materialize(large, "windows")
    often = materialize(large.groupBy("a", "w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("a").alias("oa"), F.col("w").alias("ow")), "often")
    places = large.join(often.hint("merge"), (F.col("a") == F.col("oa")) & (F.col("w") == F.col("ow"))).groupBy("a", "s").agg(F.collect_list("i").alias("i"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(2).to_pylist():
                mask = np.zeros(max(own) + 1, bool)
                mask[own] = True
                out.append([{"first": x, "end": y} for x, y in _spans(mask)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, arrow_spans)], names=schema.names)

    return one.unionByName(places.select("a", "s", "i").mapInArrow(merged, schema))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES, shared: DataFrame | None = None) -> DataFrame:
    """id, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans and spans.

    ``shared`` (r1, r2, n_shared), if given, adds its last column, 0 for other rows.
    """
    spans = removal_spans(docs, id_col, text, length, anchor, batches)
    also = [] if shared is None else ["n_shared"]
    if shared is not None:
        spans = spans.join(shared.hint("merge"), ["r1", "r2"], "full")
    spans = spans.withColumnsRenamed({"r1": "s1", "r2": "s2"})
    joined = _keyed(docs, id_col, text, [id_col]).join(spans.hint("merge"), (F.col("r1") == F.col("s1")) & (F.col("r2") == F.col("s2")), "left").select(F.col(f"`{id_col}`"), "__t", "spans", *[F.coalesce(c, F.lit(0)).alias(c) for c in also])
    schema = T.StructType([docs.schema[id_col], T.StructField("kept", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("spans", _SPANS), *[T.StructField(c, T.LongType()) for c in also]])
    arrow_spans = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def mapped(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            kept, numbers, out = [], [], []
            for t, spans in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((x["first"], x["end"]) for x in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                at, rest = 0, []
                for a, b in merged:
                    rest.append(t[at:a])
                    at = b
                rest.append(t[at:])
                kept.append(b"".join(rest))
                numbers.append((len(t), len(t) - len(kept[-1]), len(merged)))
                out.append([{"first": a, "end": b} for a, b in merged])
            arrays = [pa.array([x[k] for x in numbers], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *arrays, pa.array(out, arrow_spans), *batch.columns[3:]], names=schema.names)

    return joined.mapInArrow(mapped, schema)
