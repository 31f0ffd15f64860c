"""Benchmark decontamination with an FM-index for each shard of the corpus.

The benchmark's words get small numbers. A shard is a run of documents reduced to
its stretches of benchmark words that are long enough to hold a window; all other
words can't be part of an occurrence. Over that sequence a suffix array, its
Burrows-Wheeler transform and a wavelet matrix are built; all windows are searched
backward at once through its ranks; occurrences are located by walking to the
next sampled suffix position; the word spans found are merged for each document.

Defined cases: null texts and texts without words have no words, no hits and no
items; an item without words is never found; equal items each count; an item with
a null id marks words and documents like any other but is not named in items;
repeated rows are handled row by row; empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import runs, text_bytes

WINDOW = 13
#: The benchmark travels to the workers in parts of about this many UTF-8 bytes (a
#: longer item is a part of its own); each further part is a pass over the texts.
PART_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
SAMPLE_EVERY = 8

_LETTER = re.compile(rb"[0-9a-z\x80-\xff]+")
_TO_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.lower().translate(_TO_SPACE).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s`` by prefix doubling; a shorter suffix comes first."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < n and n > 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        step = np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


class FMIndex:
    """Backward search and location over a sequence of small non-negative integers.

    Symbol 0 is kept for the end of the sequence and must not occur in it.
    """

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE_EVERY):
        s = np.concatenate((seq.astype(np.int64), [0]))
        n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.n, self.bits = n, max(1, int(s.max()).bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=1 << self.bits))))
        self.levels, self.zeros, cur = [], [], bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))
        self.base = self._walk(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))
        self.sampled = sa % sample == 0
        self.sampled_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = sa[self.sampled]

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, ones, z in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros, strict=True):
            r = ones[i].astype(np.int64)
            i = np.where((c >> b) & 1, z + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before each position i of the transform."""
        return self._walk(c, i) - self.base[c]

    def symbol_at(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for ones, z in zip(self.levels, self.zeros, strict=True):
            r = ones[i].astype(np.int64)
            bit = ones[i + 1] - r
            c = c * 2 + bit
            i = np.where(bit, z + r, i - r)
        return c

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges [lo, hi) of the rows of ``patterns``."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            inside = c < 1 << self.bits
            c = np.where(inside, c, 0)
            a = self.first[c] + self.rank(c, lo[live])
            b = np.where(inside, self.first[c] + self.rank(c, hi[live]), a)
            lo[live], hi[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffix-array rows."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.samples[self.sampled_rank[at[done]]] + steps
            live, at = live[~done], at[~done]
            c = self.symbol_at(at)
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out


class Phrases:
    """Windows of the benchmark, by length, over numbered words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        by: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for k, (_, text) in enumerate(items):
            seq = tuple(self.ids.setdefault(w, len(self.ids) + 2) for w in words_of(text))  # 1 separates, 0 ends
            n = min(window, len(seq))
            for i in range(len(seq) - n + 1 if n else 0):
                own = by.setdefault(n, {}).setdefault(seq[i : i + n], [])
                if not own or own[-1] != k:
                    own.append(k)
        self.groups = [(n, np.array(list(d), np.int64).reshape(len(d), n), list(d.values())) for n, d in sorted(by.items())]
        self.shortest = self.groups[0][0] if self.groups else 0

    def hits(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[str]] | None]:
        """For each document its merged word spans and the items found, or None."""
        out: list = [None] * len(docs)
        if not self.groups:
            return out
        get, flat, owner_at = self.ids.get, [], np.cumsum([0] + [len(d) + 1 for d in docs])
        for d in docs:
            flat += [get(w, 1) for w in d]
            flat.append(1)
        seq = np.array(flat, np.int64)
        inside = seq > 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        start, end = edge[::2], edge[1::2]
        long = end - start >= self.shortest
        if not long.any():
            return out
        mark = np.zeros(len(seq) + 1, np.int64)
        mark[start[long]] += 1
        mark[end[long] + 1] -= 1  # with one separator; every document ends in one
        where = np.flatnonzero(np.cumsum(mark)[:-1])
        index = FMIndex(seq[where])
        spans: list[np.ndarray] = []
        found: dict[int, set[int]] = {}
        for n, patterns, owners in self.groups:
            lo, hi = index.search(patterns)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            counts = hi[some] - lo[some]
            which = np.repeat(some, counts)
            rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + lo[which]
            first = where[index.locate(rows)]
            doc = np.searchsorted(owner_at, first, side="right") - 1
            spans.append(np.stack((doc, first - owner_at[doc], first - owner_at[doc] + n), 1))
            for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
                found.setdefault(d, set()).update(owners[w])
        if not spans:
            return out
        every = np.concatenate(spans)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))].tolist()
        merged: dict[int, list[tuple[int, int]]] = {}
        for d, a, b in every:
            own = merged.setdefault(d, [])
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(b, own[-1][1]))
            else:
                own.append((a, b))
        for d, own in merged.items():
            out[d] = own, sorted(self.names[k] for k in found[d] if self.names[k] is not None)
        return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Adds to the ``keep`` columns of ``docs`` (all by default) what was found.

    n_words and n_hit (long), spans (array of first and last-plus-one byte of the
    merged passages), items (sorted ids as strings) and contaminated (n_hit is
    over 0 and at least a twentieth of n_words). Columns of ``docs`` with these
    names are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = size // part_bytes + 1
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", span),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType()),
    ]
    new = {f.name for f in fields}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    # Texts, word spans and items go from pass to pass under names of their own.
    own = [T.StructField("__text", T.StringType()), T.StructField("__places", span), T.StructField("__items", T.ArrayType(T.StringType()))]
    between, schema = T.StructType([docs.schema[c] for c in names] + own), T.StructType([docs.schema[c] for c in names] + fields)
    kind, text_list = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"), F.lit(None).cast(span).alias("__places"), F.lit(None).cast("array<string>").alias("__items"))
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        sent = spark.sparkContext.broadcast(sorted(((r["i"], r["t"].encode()) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1])))
        out = out.mapInArrow(_pass(sent, len(names), window, kind, text_list, (schema if k == parts - 1 else between).names, k == parts - 1), schema if k == parts - 1 else between)
    return out


def _pass(sent, kept: int, window: int, kind: pa.DataType, text_list: pa.DataType, names: list[str], last: bool):
    """Adds what one part of the benchmark finds; the last pass makes the result."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = None
        for batch in batches:
            phrases = phrases or Phrases(sent.value, window)
            texts = text_bytes(batch.column(kept))
            for i, j in runs(map(len, texts), SHARD_BYTES):
                words = [words_of(t) for t in texts[i:j]]
                before = zip(*[batch.column(kept + k).slice(i, j - i).to_pylist() for k in (1, 2)], strict=True)
                places, found = [], []
                for old, now in zip(before, phrases.hits(words), strict=True):
                    now = now or ([], [])
                    places.append(_union([(x["first"], x["end"]) for x in old[0] or ()] + now[0]))
                    found.append(sorted((old[1] or []) + now[1]))
                columns = [batch.column(k).slice(i, j - i) for k in range(kept)]
                if last:
                    n_words, n_hit = [len(w) for w in words], [sum(b - a for a, b in own) for own in places]
                    spans = []
                    for t, own in zip(texts[i:j], places, strict=True):
                        at = [m.span() for m in _LETTER.finditer(t.lower())] if own else []
                        spans.append([{"first": at[a][0], "end": at[b - 1][1]} for a, b in own])
                    bad = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)]
                    columns += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, kind), pa.array(found, text_list), pa.array(bad, pa.bool_())]
                else:
                    columns += [batch.column(kept).slice(i, j - i), pa.array([[{"first": a, "end": b} for a, b in own] for own in places], kind), pa.array(found, text_list)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given byte ranges."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
