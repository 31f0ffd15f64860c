"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it into chunks, so texts that share
passages share chunks. A worker encodes a chunk once: the part between its first
and last white space is kept as ids and decoded pieces. Where two chunks join, the
open ends are put together and encoded again; the window of that repair grows over
whole chunks until white space closes it on both sides, where the tokenizer's
result for the parts agrees exactly with its result for the whole text: no
pre-token, special string or normalisation of this vocabulary reaches across ASCII
white space.

A counting pass over all texts (hashes only) finds the chunks that recur; these
stay in the workers' caches, others are kept only as long as there is room.

Defined cases: a null or empty text has no ids and decodes to an empty text;
repeated rows are encoded row by row from the cache; an empty table gives an empty
result.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import heaviest, map_texts, materialize, text_bytes
from .token_counts import open_tokenizer

HASH_BYTES, MASK, SHORTEST, LONGEST = 32, 0x3FF, 256, 8192
#: Bound of the broadcast list of recurring chunks (8 bytes each), and of a worker's cache of others (bytes of texts, ids and pieces).
PINNED, CACHE_BYTES = 65_536, 64 << 20
#: White-space separated words whose ids a worker keeps, for the chunks it has not met.
WORDS = 400_000
#: Words that the tokenizer gets at once: its results take about a hundred times their ids.
WORD_RUN = 8192

_SPACE = re.compile(rb"[\t\n\r ]")
_MULTIPLIER = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all ``width`` bytes (a power of two)."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < width:
        h = h[:-size] * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + h[size:]
        size *= 2
    return h


def chunks(text: bytes) -> list[bytes]:
    """Cut where the rolling hash of the bytes before has zeros, between code points."""
    if len(text) < 2 * SHORTEST:
        return [text] if text else []
    h = rolling(np.frombuffer(text, np.uint8), HASH_BYTES)
    spots = np.flatnonzero(((h ^ (h >> np.uint64(31))) & np.uint64(MASK)) == 0) + HASH_BYTES
    out, start = [], 0

    def cut(at: int) -> int:
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        out.append(text[start:at])
        return at

    for s in [*spots.tolist(), len(text)]:
        while s - start > LONGEST:
            start = cut(start + LONGEST)
        if s - start >= SHORTEST or s == len(text) and s > start:
            start = cut(s)
    return out


def chunk_key(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def recurring_chunks(docs: DataFrame, text: str = "text", most: int = PINNED) -> DataFrame:
    """(key, n): chunks that occur at least twice, the most frequent ``most`` of them."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([chunk_key(c) for t in text_bytes(batch.column(0)) for c in chunks(t)], np.int64)
            own, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["key", "n"])

    found = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(mapped, "key long, n long")
    return heaviest(materialize(found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "chunks"), "n", most)


class Codec:
    """Encodes and decodes texts on one worker, chunk by chunk."""

    def __init__(self, path: str, pinned: set[int]):
        gc.set_threshold(200_000, 50, 50)  # the caches hold many objects and no cycles
        self.tokenizer, self.pinned = open_tokenizer(path), pinned
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.kept: dict[bytes, tuple[bytes, bytes, bytes, bytes] | None] = {}
        self.loose: dict[bytes, tuple[bytes, bytes, bytes, bytes] | None] = {}
        self.held = 0
        self.words: dict[bytes, tuple[bytes, bytes]] = {}

    def _encode(self, parts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """ids (little-endian unsigned 32 bit) and their pieces, joined by a blank."""
        split = [p.split() for p in parts]  # at ASCII white space, which no token crosses
        known = self.words
        met: set[bytes] = set()
        for own in split:
            met.update(own)
        new = [w for w in met if w not in known]
        if len(known) + len(new) > WORDS:
            known.clear()
            new = list(met)
        token = self.token
        for k in range(0, len(new), WORD_RUN):
            some = new[k : k + WORD_RUN]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                x = e.ids
                known[w] = struct.pack(f"<{len(x)}I", *x), b" ".join([token[i] for i in x])
        out = []
        for own in split:
            made = list(map(known.__getitem__, own))
            out.append((b"".join([x for x, _ in made]), b" ".join([y for _, y in made if y])))
        return out

    def _learn(self, new: list[bytes]) -> None:
        bodies, ends = [], []
        for c in new:
            first = _SPACE.search(c)
            last = max(c.rfind(x) for x in (b" ", b"\n", b"\t", b"\r")) if first else -1
            ends.append((first.start(), last) if first else None)
            bodies.append(c[first.start() : last] if first else b"")
        if self.held > CACHE_BYTES:
            self.loose.clear()
            self.held = 0
        for c, e, made in zip(new, ends, self._encode(bodies), strict=True):
            entry = None if e is None else (c[: e[0]], *made, c[e[1] + 1 :])
            if self.pinned and chunk_key(c) in self.pinned:
                self.kept[c] = entry
            else:
                self.loose[c] = entry
                self.held += len(c) + sum(map(len, entry or ()))

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each text its ids and its decoded form."""
        split = [chunks(t) for t in texts]
        new = list(dict.fromkeys(c for parts in split for c in parts if c not in self.kept and c not in self.loose))
        known = self.kept, self.loose
        if self.held > CACHE_BYTES:
            new = list(dict.fromkeys(c for parts in split for c in parts if c not in self.kept))
        self._learn(new)
        plans, joins = [], {}
        for parts in split:
            plan, open_end = [], b""
            for c in parts:
                entry = known[0][c] if c in known[0] else known[1][c]
                if entry is None:
                    open_end += c
                    continue
                if window := open_end + entry[0]:
                    plan.append(window)
                    joins[window] = None
                plan.append(entry)
                open_end = entry[3]
            if open_end:
                plan.append(open_end)
                joins[open_end] = None
            plans.append(plan)
        windows = list(joins)
        joins = dict(zip(windows, self._encode(windows), strict=True))
        out = []
        for plan in plans:
            made = [joins[x] if isinstance(x, bytes) else x[1:3] for x in plan]
            out.append((b"".join([a for a, _ in made]), b" ".join([b for a, b in made if a])))
        return out


def encode(docs: DataFrame, tokenizer: str, id_col: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """The id column(s), ids (binary, little-endian unsigned 32 bit), n_tokens and decoded."""
    keep = [id_col] if isinstance(id_col, str) else id_col
    codec = _shared_codec(docs, tokenizer, text)

    def make():
        own = codec()

        def work(texts: list[bytes]) -> list:
            made = own.encode(texts)
            return [[a for a, _ in made], [len(a) // 4 for a, _ in made], [b.decode() for _, b in made]]

        return work

    return map_texts(docs, keep, text, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())], make)


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """The id column(s), n_tokens, ids_sha256 and decoded_sha256."""
    keep = [id_col] if isinstance(id_col, str) else id_col
    codec = _shared_codec(docs, tokenizer, text)

    def make():
        own = codec()

        def work(texts: list[bytes]) -> list:
            made = own.encode(texts)
            return [[len(a) // 4 for a, _ in made], [hashlib.sha256(a).hexdigest() for a, _ in made], [hashlib.sha256(b).hexdigest() for _, b in made]]

        return work

    return map_texts(docs, keep, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], make)


def _shared_codec(docs: DataFrame, tokenizer: str, text: str):
    keys = np.array([r[0] for r in recurring_chunks(docs, text).collect()], np.int64)  # at most PINNED
    sent = docs.sparkSession.sparkContext.broadcast(keys.tobytes())
    return lambda: Codec(tokenizer, set(np.frombuffer(sent.value, np.int64).tolist()))
