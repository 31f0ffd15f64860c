"""Passages of many words that another document holds too.

The bytes of a passage may be fewer than the string length of
:mod:`thicket.llm.repeats`, so this index counts words. Every window of WORDS words
picks the anchor with the smallest rolling hash of GRAM words inside it; equal
windows pick equal anchors. Anchors that occur once settle their windows with a
grouped count of hashes. The others meet with a byte for each of the words
around them, and all windows over one anchor are compared by a digest of these.

Defined cases: a null text and one of fewer than WORDS words shares nothing; a
document doesn't share with itself, nor do rows with equal id and text; texts of
short periods have each anchor once; words are split at ASCII white space and
compared as they are written; a word next to an anchor is known by one of 255
values, so a passage one word too short is taken in one case of 255; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import rolling
from .common import ASCII_SPACE, materialize, runs, text_bytes
from .repeats import _keyed, _sliding_min

WORDS, GRAM = 51, 8
#: Places of one anchor that one task compares; more are spread over tasks.
GROUP = 1 << 16
_MULTIPLIER = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(ASCII_SPACE)] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class WordHashes:
    """64-bit hashes of a text's words; keeps the powers that the longest text needed."""

    def __init__(self) -> None:
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def of(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        inside = ~_IS_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        if len(self.power) <= len(data):
            n = 2 * len(data) + 1
            self.power, self.inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
            self.power[1:] = np.cumprod(np.full(n - 1, _MULTIPLIER, np.uint64))
            self.inverse[1:] = np.cumprod(np.full(n - 1, pow(_MULTIPLIER, -1, 1 << 64), np.uint64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)])))
        return _mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def anchors(words: np.ndarray, length: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each anchor."""
    if len(words) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = _mixed(rolling(words, gram))
    bits = np.uint64(len(h).bit_length())  # the low bits give way to the place
    low = _sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    place = np.unique((low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    return h[place], place


def around(words: np.ndarray, place: np.ndarray, length: int, gram: int) -> np.ndarray:
    """A byte (0 beyond the text) of each of the words beside an anchor, a row each."""
    side = length - gram
    byte = np.zeros(len(words) + 2 * side, np.uint8)
    byte[side : side + len(words)] = (words >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    wide = np.lib.stride_tricks.sliding_window_view(byte, 2 * side + gram)[place]
    return np.concatenate((wide[:, :side], wide[:, side + gram :]), axis=1)


def window_digests(anchor: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """A digest of each window over an anchor (rows x windows); 0 if it leaves the text."""
    side = beside.shape[1] // 2
    out, data = np.zeros((len(beside), side + 1), np.uint64), beside.astype(np.uint64)
    top = np.uint64(pow(_MULTIPLIER, side - 1, 1 << 64))
    h, gaps = np.zeros(len(beside), np.uint64), np.cumsum(np.concatenate((np.zeros((len(beside), 1), np.int64), beside == 0), axis=1), axis=1)
    for k in range(side):
        h = h * np.uint64(_MULTIPLIER) + data[:, k]
    salt = np.arange(side + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(side + 1):
        whole = gaps[:, k + side] == gaps[:, k]
        out[:, k] = np.where(whole, _mixed(h ^ (anchor + salt[k])) | np.uint64(1), np.uint64(0))
        if k < side:
            h = (h - data[:, k] * top) * np.uint64(_MULTIPLIER) + data[:, k + side]
    return out


def _shared(anchor: np.ndarray, beside: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which anchors stand in a window that another row has too."""
    digest = window_digests(anchor, beside)
    at, _ = np.nonzero(digest)
    flat = digest[digest != 0]
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], row[at[order]]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    out = np.zeros(len(row), bool)
    if len(first):
        many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        out[at[order[np.repeat(many, np.diff(np.append(first, len(flat))))]]] = True
    return out


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(r1, r2, n_shared): how many anchors of a row stand in passages shared with others.

    ``r1`` and ``r2`` name rows as in :mod:`thicket.llm.repeats`; rows that share
    nothing are left out.
    """
    rows = _keyed(docs, id_col, text, []).select("r1", "r2", "__t")

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for i, j in runs(map(len, texts)):
                found = [np.unique(anchors(hashes.of(t), length, gram)[0]) for t in texts[i:j]]
                name, n = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], names=["g", "n"])

    counts = rows.select("__t").mapInArrow(only, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")
    counts = materialize(counts.withColumnRenamed("g", "known"), "anchors")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for i, j in runs(map(len, texts)):
                at, name, beside = [], [np.zeros(0, np.uint64)], []
                for k, t in enumerate(texts[i:j], i):
                    words = hashes.of(t)
                    g, place = anchors(words, length, gram)
                    if len(g):
                        near = around(words, place, length, gram)
                        both = np.concatenate((g.view(np.uint8).reshape(-1, 8), near), axis=1)
                        _, one = np.unique(both.view(f"V{both.shape[1]}").ravel(), return_index=True)
                        at += [k] * len(one)
                        name.append(g[one])
                        beside.append(near[one].tobytes())
                where = pa.array(at, pa.int64())
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * (length - gram)), len(at), [None, pa.py_buffer(b"".join(beside))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(np.concatenate(name).view(np.int64)), fixed.cast(pa.binary())], names=["r1", "r2", "g", "beside"])

    def entries(known: DataFrame) -> DataFrame:
        found = rows.mapInArrow(placed, "r1 long, r2 long, g long, beside binary")
        return found.join(known.hint("merge"), F.col("g") == F.col("known")).drop("known", "n")

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * (length - gram))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sent(upto: int) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            held.extend(t.slice(upto).to_batches())
            r1, r2, g, beside = (t.slice(0, upto).column(k).combine_chunks() for k in range(4))
            if upto:
                some = _shared(g.to_numpy().view(np.uint64), matrix(beside), r1.to_numpy())
                yield pa.RecordBatch.from_arrays([r1.filter(pa.array(some)), r2.filter(pa.array(some))], names=["r1", "r2"])

        for batch in batches:
            held.append(batch)
            n = sum(map(len, held))
            if n >= 1 << 14:  # whole groups, in the order of the anchors
                g = np.concatenate([b.column(2).to_numpy() for b in held])
                yield from sent(int(np.searchsorted(g, g[-1])))
        if held:
            yield from sent(sum(map(len, held)))

    few = entries(counts.where(F.col("n") <= GROUP)).repartition("g").sortWithinPartitions("g").mapInArrow(grouped, "r1 long, r2 long")
    per_row = lambda found: found.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n_shared"))
    large = counts.where(F.col("n") > GROUP)
    if large.isEmpty():
        return per_row(few)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                digest = window_digests(part.column(2).to_numpy().view(np.uint64), matrix(part.column(3)))
                at, _ = np.nonzero(digest)
                w, where = digest[digest != 0].view(np.int64), pa.array(at)
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(where) for k in (0, 1, 4)], pa.array(w)], names=["r1", "r2", "k", "w"])

    windows = entries(large).select("r1", "r2", "g", "beside", F.xxhash64("g", "beside").alias("k"))
    windows = materialize(windows.mapInArrow(spread, "r1 long, r2 long, k long, w long"), "spread")
    often = windows.groupBy("w").agg(F.min("r1").alias("lo"), F.max("r1").alias("hi")).where("lo < hi").select(F.col("w").alias("often"))
    many = windows.join(materialize(often, "often").hint("merge"), F.col("w") == F.col("often")).select("r1", "r2", "k").distinct().select("r1", "r2")
    return per_row(few.unionByName(many))
