"""Media columns: lossless PNG payloads and cosine-transform hashes.

A payload of bytes becomes an 8-bit grey image 64 samples wide. The writer makes
the signature and the IHDR, IDAT and IEND chunks; the reader walks the chunks,
tests every checksum, inflates and undoes the row filters with numpy.

Defined cases: a null or empty text is one row of 64 zero samples; equal texts
give equal bytes; repeated rows are handled row by row; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


def payload_of(data: bytes) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of WIDTH."""
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes, level: int = 3) -> bytes:
    """Grey PNG of ``payload``; its length is a positive multiple of WIDTH.

    Every row is stored as it is or as the difference to the left (whichever has
    the smaller sum of absolute values), the usual heuristic.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    cost = lambda x: np.abs(x.view(np.int8).astype(np.int16)).sum(1)
    use = cost(left) < cost(rows.copy())
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = use
    lines[:, 1:] = np.where(use[:, None], left, rows)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples (height x width) of an 8-bit grey PNG.

    Raises ValueError for a wrong signature, checksum, length or form.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part, check = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(part) != n or len(check) != 4 or struct.unpack(">I", check)[0] != zlib.crc32(kind + part):
            raise ValueError(f"bad checksum or length in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("no whole 8-bit grey image")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(lines) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfilter(lines.reshape(height, width + 1))


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo PNG's five row filters (bytes a sample: 1)."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    alone = kinds == 1  # these rows don't need the row above
    out[alone] = np.cumsum(out[alone], axis=1, dtype=np.uint8)
    for y in np.flatnonzero(kinds > 1):
        row, up = out[y], out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
        if kinds[y] == 2:
            row += up
            continue
        a = c = 0
        for x in range(len(row)):
            b = int(up[x])
            if kinds[y] == 3:
                guess = (a + b) // 2
            else:
                pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
            a, c = (int(row[x]) + guess) & 255, b
            row[x] = a
    return out


_ANGLE = np.pi / 64 * (2 * np.arange(32) + 1)
_BASIS = np.cos(np.outer(np.arange(8), _ANGLE))  # the 8 lowest frequencies over 32 samples


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: signs of the 8 x 8 lowest cosine coefficients against their median.

    The image is first averaged onto a grid of 32 x 32 cells.
    """
    height, width = samples.shape
    down = np.arange(33) * height // 32
    rows = np.add.reduceat(np.vstack([samples, samples[-1:]]).astype(np.float64), np.minimum(down[:-1], height - 1), axis=0) if height >= 32 else samples[np.arange(32) * height // 32].astype(np.float64)
    if height >= 32:
        rows = rows[:32]
        rows[-1] -= samples[-1]
        rows /= np.maximum(1, np.diff(down))[:, None]
    grid = rows.reshape(32, 32, width // 32).mean(2)
    low = (_BASIS @ grid @ _BASIS.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id column, n_bytes (before padding) and media, a binary column of PNGs."""

    def make():
        return lambda texts: [[len(t) for t in texts], [write_png(payload_of(t)) for t in texts]]

    return map_texts(docs, [id_col], text, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], make)


def load(stored: DataFrame, media: str = "media") -> DataFrame:
    """Adds payload (binary, read back from the PNG) and feature (hash, hex)."""
    schema = T.StructType([f for f in stored.schema if f.name not in ("payload", "feature")] + [T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())])
    keep = [f.name for f in stored.schema if f.name not in ("payload", "feature")]

    def mapped(batches):
        for batch in batches:
            step = 256
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                images = [None if m is None else read_png(m) for m in part.column(keep.index(media)).to_pylist()]
                made = [pa.array([None if x is None else x.tobytes() for x in images], pa.binary()), pa.array([None if x is None else cosine_hash(x).hex() for x in images], pa.string())]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], *made], names=schema.names)

    return stored.select(*keep).mapInArrow(mapped, schema)


def digest(loaded: DataFrame) -> DataFrame:
    """Lengths and checksums of payload and media in place of the bytes."""
    tail = F.expr("substring(payload, -64, 64)")
    return loaded.select(
        *[c for c in loaded.columns if c not in ("media", "payload", "feature")],
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
