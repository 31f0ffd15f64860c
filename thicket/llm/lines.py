"""Line dedup: drop lines that recur in many documents.

Texts are exploded to normalised lines; a line's key is hashed to 128 bits, each
document sends each hash once, and a grouped count with map-side partial sums
finds the documents that hold it and the largest id among them. Only hashes over
the threshold come back to the texts, one list for each document.

Defined cases: a null or empty text is one empty line; a null id is a document of
its own, smaller than any other; rows that share an id are one document; repeated
lines in one document count once; an empty table gives an empty result. Columns
other than the text (and, where asked for, its length) pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, join_hot, materialize, text_bytes

MIN_CHARS, MIN_DOCS = 40, 5


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the line's key; None if the key is too short to count."""
    key = line.strip(ASCII_SPACE).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(id, h): every hash of a document once."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(text_bytes(batch.column(1))):
                if len(t) >= min_chars:
                    own = {line_hash(x, min_chars) for x in t.split(b"\n") if len(x) >= min_chars} - {None}
                    at += [i] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], names=["id", "h"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("h", T.BinaryType())])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(mapped, schema)


def dropped_hashes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, drop): for each document the hashes whose lines it loses."""
    pairs = materialize(line_hashes(docs, id_col, text, min_chars), "lines")
    # Rows that share an id would count twice: only then, count distinct ids.
    common = materialize(
        pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs), "common"
    )
    held = join_hot(pairs, common.select(F.col("h").alias("ch"), "keeper", "n"), ["h"], ["ch"], "n")
    shared_ids = docs.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if not shared_ids.isEmpty():
        sure = materialize(held.select("id", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select(F.col("h").alias("sh")), "sure")
        held = held.join(sure, F.col("h") == F.col("sh"), "left_semi")
    return held.where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id").agg(F.collect_set("h").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, length_col: str | None = None) -> DataFrame:
    """``docs`` with repeated lines gone, and n_lines and n_dropped added.

    A key of at least ``min_chars`` code points held by at least ``min_docs``
    documents stays in the document with the largest id only. Other lines keep
    their order. ``length_col``, if given, is set to the new text's length.
    """
    drops = dropped_hashes(docs, id_col, text, min_chars, min_docs).select(F.col("id").alias("__id"), F.col("drop").alias("__drop"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*[F.col(f"`{c}`") for c in names]).join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left").drop("__id")
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in joined.schema if f.name != "__drop"] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(names.index(text)), batch.column(len(names)).to_pylist()
            kept, lines, lost = [], [], []
            for t, own in zip(text_bytes(texts), drops, strict=True):
                parts = t.split(b"\n")
                lines.append(len(parts))
                if own:
                    own = set(own)
                    parts = [x for x in parts if len(x) < min_chars or line_hash(x, min_chars) not in own]
                    t = b"\n".join(parts)
                lost.append(lines[-1] - len(parts))
                kept.append(t)
            arrays = {n: batch.column(k) for k, n in enumerate(names)}
            arrays[text] = pa.array(kept, pa.binary()).cast(pa.string())
            if length_col in arrays:
                arrays[length_col] = pa.array([len(t.decode()) for t in kept], arrays[length_col].type)
            yield pa.RecordBatch.from_arrays([*arrays.values(), pa.array(lines, pa.int64()), pa.array(lost, pa.int64())], names=schema.names)

    return joined.mapInArrow(mapped, schema)
