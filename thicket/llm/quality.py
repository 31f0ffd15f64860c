"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A rating is a grade 0..K-1. One weight vector over hashed text features is shared
by all grades; ordered thresholds turn its score s into P(grade >= k) =
sigmoid(s - t_k). Expected grade and tail probability come out for selection.

The model is fitted on the driver from a bounded sample of rated rows (the
parameter ``max_rated``, taken in the order of a hash of the id); every row is
scored, on its whole text.

Defined cases: a null or empty text has only the shape features of an empty text;
ratings without a document, or with a null grade, are left out; without any
rating every row gets the highest grade; repeated ratings count as often as they
stand; repeated rows are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, text_bytes

BUCKETS, MAX_RATED, MIN_ROWS = 1 << 18, 12_000, 4
#: Besides whole words, their first bytes count, so that forms of one stem share a weight.
PREFIXES = 4, 5, 6
#: Words whose buckets a worker keeps.
KNOWN_WORDS = 300_000
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]+")
_EDGES = b".,;:!?'\"()[]{}<>|*#$%&-_/\\"


def _bucket(kind: bytes, data: bytes) -> int:
    return zlib.crc32(data, zlib.crc32(kind)) & (BUCKETS - 1)


class Features:
    """Distinct feature buckets of a text; a worker keeps those of the words it met."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _word(self, w: bytes) -> tuple[int, ...]:
        shape = _LETTERS.sub(b"a", _CAPITALS.sub(b"A", w))[:12]
        plain = w.strip(_EDGES).lower()
        made = (_bucket(b"w", plain), _bucket(b"s", shape), *(_bucket(b"p", plain[:n]) for n in PREFIXES if len(plain) > n))
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        self.known[w] = made
        return made

    def of(self, text: bytes) -> list[int]:
        words = text.split()
        own = set(words)
        known, out = self.known, set()
        for w in own:
            out.update(known[w] if w in known else self._word(w))
        n = max(1, len(words))
        twice = sum(map(bytes.__eq__, words, words[1:]))
        lines = text.count(b"\n") + 1
        out.add(_bucket(b"twice", b"%d" % min(9, 20 * twice // n)))
        out.add(_bucket(b"own", b"%d %d" % (10 * len(own) // n, min(8, n.bit_length()))))
        out.add(_bucket(b"line", b"%d" % min(9, (n // lines).bit_length())))
        return list(out)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l2: float = 8.0, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch gradient descent with momentum (Adam).

    ``rows`` holds the distinct feature buckets of each rated text. A feature that
    fewer than MIN_ROWS texts have, or whose texts' mean grade is within a few (by
    the number of rows) standard errors of the overall mean, keeps weight 0.
    """
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    seen = np.bincount(flat, minlength=BUCKETS)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    off = grades - grades.mean()
    z = np.bincount(flat, off[owner], minlength=BUCKETS) / (np.sqrt(np.maximum(seen, 1)) * (off.std() + 1e-9))
    least = 1 + math.sqrt(math.log(max(2, len(rows))))  # the more rows, the more chance features
    use = np.flatnonzero((seen >= MIN_ROWS) & (np.abs(z) >= least))
    slot = np.full(BUCKETS, -1, np.int32)
    slot[use] = np.arange(len(use))
    cols = slot[flat]
    owner, cols = owner[cols >= 0], cols[cols >= 0]
    above = (grades[:, None] >= np.arange(1, n_grades)[None, :]).astype(float)  # is the grade k or more
    # Each threshold's two sides weigh the same, so that rare grades count.
    share = above.mean(0).clip(1e-3, 1 - 1e-3)
    weight = np.where(above > 0, 0.5 / share, 0.5 / (1 - share)).clip(0, 5)
    w, t = np.zeros(len(use)), np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else np.zeros(1)
    theta = np.concatenate((w, t))
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), max(1, len(rows))
    for step in range(1, steps + 1):
        w, t = theta[: len(use)], theta[len(use) :]
        s = np.bincount(owner, w[cols], minlength=len(rows))
        r = weight * (1 / (1 + np.exp(-np.clip(s[:, None] - t, -40, 40))) - above) / n
        grad = np.concatenate((np.bincount(cols, r.sum(1)[owner], minlength=len(use)) + l2 * w / n, -r.sum(0)))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[len(use) :] = np.maximum.accumulate(theta[len(use) :])  # thresholds stay ordered
    weights = np.zeros(BUCKETS, np.float32)
    weights[use] = theta[: len(use)]
    return weights, theta[len(use) :]


def rated_sample(docs: DataFrame, ratings: DataFrame, id_col: str, text: str, grade: Column, max_rated: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature buckets and grades of at most ``max_rated`` rated rows."""
    some = (
        ratings.select(F.col(f"`{id_col}`").alias("__id"), grade.cast("int").alias("grade"))
        .where("__id is not null and grade is not null")
        .orderBy(F.xxhash64("__id"), "__id", "grade").limit(max_rated)
    )

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [sorted(features.of(t)) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["id", "grade", "x"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("grade", T.IntegerType()), T.StructField("x", T.ArrayType(T.IntegerType()))])
    joined = docs.select(F.col(f"`{id_col}`").alias("__doc"), F.col(f"`{text}`").cast("string").alias("t")).join(F.broadcast(some), F.col("__doc") == F.col("__id"))  # max_rated rows
    # Copies of a document may share an id: the sample stays bounded all the same.
    rows = joined.select("__doc", "t", "grade").mapInArrow(mapped, schema).orderBy("id", "grade").limit(2 * max_rated).toArrow()
    grades = rows.column("grade").to_numpy().astype(np.int64)
    return [part for chunk in rows.column("x").chunks for part in np.split(chunk.flatten().to_numpy(), chunk.value_lengths().to_numpy().cumsum()[:-1])] if rows.num_rows else [], grades


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text: str = "text", grade: Column | None = None, n_grades: int = 3, max_rated: int = MAX_RATED) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. The grade is quality + (1 - toxic) by default: 0, 1 or 2."""
    if grade is None:
        grade = F.col("quality") + (1 - F.col("toxic"))
    rows, grades = rated_sample(docs, ratings, id_col, text, grade, max_rated)
    return fit(rows, grades.clip(0, n_grades - 1), n_grades) if len(rows) else (np.zeros(BUCKETS, np.float32), np.full(n_grades - 1, -40.0))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, expected_grade and top_probability (of the highest grade)."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def make() -> Callable:
        features, (weights, thresholds) = Features(), sent.value

        def work(texts: list[bytes]) -> list:
            s = np.array([float(weights[features.of(t)].sum(dtype=np.float64)) for t in texts])
            tail = 1 / (1 + np.exp(-np.clip(s[:, None] - thresholds, -40, 40)))
            return [pa.array(tail.sum(1).round(6)), pa.array(tail[:, -1].round(6))]

        return work

    return map_texts(docs, keep, text, [T.StructField("expected_grade", T.DoubleType()), T.StructField("top_probability", T.DoubleType())], make)


def select(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds selected: the highest grade is at least this probable."""
    return scored.withColumn("selected", F.col("top_probability") >= least)


