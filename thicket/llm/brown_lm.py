"""LM scoring with a Brown class-based bigram model.

Classes come from exchange clustering in two steps. The OWN most frequent words are
exchanged between classes on their bigram counts, so that the mutual information
of neighbouring classes is high. Then every other training word is offered each
class once, on the counts of the classes that stand before and after it in the
whole training part (words x classes counts, which grow with the vocabulary), and
takes the one that gains most. A text's probability is the product of
class-transition and word-emission probabilities, both smoothed; transitions are
counted over all training tokens, all words classed.

All counts cover every training text. Only bounded tables reach the driver or the
workers: TABLE_WORDS words with count and class, OWN squared bigrams, CLASSES
squared transitions. Words beyond the table are joined to the texts that hold them.

Defined cases: a null or empty text is its end token alone; a null id counts as
an empty string for the fold and keeps its row; repeated rows count and are scored
row by row; a word that no training text has belongs to the class with the most
different words; with no training text every token is unknown; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RUN_BYTES, heaviest, materialize, release, runs, text_bytes

END = b""  # no word is empty
#: Words of the broadcast table, words that are exchanged among themselves, classes.
TABLE_WORDS, OWN, CLASSES = 131_072, 1000, 64
#: The symbol of all words that aren't OWN, and what stands for their class as a neighbour.
SYMBOLS, OTHER = OWN + 1, CLASSES
LONGEST = 40
ADD = 0.1


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words; one of over LONGEST bytes goes by its 128-bit hash."""
    return [w if len(w) <= LONGEST else b" " + xxhash.xxh3_128_digest(w) for w in text.lower().split()]


def text_runs(column: pa.Array) -> Iterator[list[bytes]]:
    """UTF-8 of the texts of a batch, a run of them at a time."""
    for i, j in runs(pc.fill_null(pc.binary_length(column), 0).to_pylist(), RUN_BYTES):
        yield text_bytes(column.slice(i, j - i))


def released(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``make`` with its worker's freed memory given back at the end of a task.

    Up to four workers of an executor wait for their next task with all they ever took.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        release()

    return mapped


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(training: DataFrame, text: str) -> DataFrame:
    """(word, c) over all training texts, the end token included."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for t in chain.from_iterable(text_runs(batch.column(0))):
                seen.update(words_of(t))
                if len(seen) > 500_000:
                    yield sent()
                    seen.clear()
            seen[END] += batch.num_rows
        if seen:
            yield sent()

    return training.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(released(mapped), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bigrams(training: DataFrame, text: str, own: dict[bytes, int]) -> DataFrame:
    """(code, n): counts of neighbouring symbols, code = first * SYMBOLS + second.

    A text starts and ends at the end token.
    """
    sent = training.sparkSession.sparkContext.broadcast(own)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total = sent.value.get, np.zeros(SYMBOLS * SYMBOLS, np.int64)
        end = get(END, OWN)
        for batch in batches:
            for texts in text_runs(batch.column(0)):
                seq = [end]
                for t in texts:
                    seq += [get(w, OWN) for w in t.lower().split()]
                    seq.append(end)
                s = np.array(seq, np.int64)
                total += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=len(total))
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], names=["code", "n"])

    return training.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(released(mapped), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


#: A task sends the neighbours of a word as bytes (class before, class after), or
#: beyond this many bytes as a histogram behind a mark that is no class.
RAW_BYTES, MARK = 512, b"\xff"


def _packed(pairs: bytes) -> bytes:
    if len(pairs) <= RAW_BYTES:
        return pairs
    x = np.frombuffer(pairs, np.uint8)
    both = np.concatenate((np.bincount(x[::2], minlength=CLASSES + 1), np.bincount(x[1::2], minlength=CLASSES + 1)))
    return MARK + both.astype("<u4").tobytes()


def neighbours(training: DataFrame, text: str, own_class: dict[bytes, int]) -> DataFrame:
    """(word, near): the classes around each word that has no class yet, a row a task."""
    sent = training.sparkSession.sparkContext.broadcast(own_class)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, end = sent.value.get, sent.value.get(END, OTHER)
        seen: dict[bytes, bytes] = {}
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([_packed(x) for x in seen.values()], pa.binary())], names=["word", "near"])

        for batch in batches:
            for t in chain.from_iterable(text_runs(batch.column(0))):
                tokens = words_of(t)
                c = np.array([end, *[get(w, OTHER) for w in tokens], end], np.uint8)
                at = np.flatnonzero(c == OTHER)
                pairs = np.stack((c[at - 1], c[at + 1]), 1).tobytes()
                size += len(pairs)
                for k, p in enumerate((at - 1).tolist()):
                    w = tokens[p]
                    seen[w] = seen.get(w, b"") + pairs[2 * k : 2 * k + 2]
                if len(seen) > 300_000 or size > 16 << 20:
                    yield made()
                    seen.clear()
                    size = 0
        if seen:
            yield made()

    return training.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(released(mapped), "word binary, near binary")


def context_counts(near: list[list[bytes]]) -> np.ndarray:
    """For each word how often each class (and OTHER) is before it and after it."""
    width = 2 * (CLASSES + 1)
    out = np.zeros((len(near), width))
    raw, owner = [], []
    for i, parts in enumerate(near):
        for x in parts:
            if x[:1] == MARK:
                out[i] += np.frombuffer(x[1:], "<u4")
            else:
                raw.append(x)
                owner.append(i)
    x = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    who = np.repeat(np.array(owner, np.int64), [len(r) // 2 for r in raw])
    cells = np.concatenate((who * width + x[::2], who * width + CLASSES + 1 + x[1::2]))
    return out + np.bincount(cells, minlength=out.size).reshape(out.shape)


def joining_gain(cells: np.ndarray) -> np.ndarray:
    """What a neighbour's count adds for each class (2 * (CLASSES + 1) x CLASSES).

    The change of the classes' bigram likelihood to first order: a word joins a
    class whose counts are far above its own. ``cells`` holds the classes' bigram
    counts, OTHER included as the last.
    """
    smooth = cells + 0.1
    rows, cols = np.log(smooth.sum(1)), np.log(smooth.sum(0))
    before = np.log(smooth)[:, :CLASSES] - cols[None, :CLASSES]
    after = np.log(smooth).T[:, :CLASSES] - rows[None, :CLASSES]
    return np.concatenate((before, after))


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = 4) -> np.ndarray:
    """Class of each symbol: greedy moves that raise the classes' bigram likelihood.

    ``counts[u, v]`` says how often v follows u. Symbols start in classes by
    frequency rank; each sweep offers every symbol the class that gains most.
    """
    n = len(counts)
    classes = max(1, min(classes, n))
    order = np.argsort(-(counts.sum(0) + counts.sum(1)), kind="stable")
    label = np.empty(n, np.int64)
    label[order] = np.arange(n) % classes
    one = np.zeros((n, classes))
    one[np.arange(n), label] = 1
    out = counts @ one  # to classes, by first symbol
    into = counts.T @ one  # from classes, by second symbol
    table = one.T @ out

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, self_n = label[w], counts[w, w]
            r, l = out[w].copy(), into[w].copy()  # noqa: E741
            if not r.sum() and not l.sum():
                continue
            r[a] -= self_n
            l[a] -= self_n
            table[a, :] -= r
            table[:, a] -= l
            table[a, a] -= self_n
            rows, cols = table.sum(1), table.sum(0)
            # Adding w to class b changes row b, column b and the cell where they meet.
            gain = (f(table + r) - f(table)).sum(1) + (f(table.T + l) - f(table.T)).sum(1)
            cell = np.diag(table)
            gain += f(cell + r + l + self_n) - f(cell + r) - f(cell + l) + f(cell)
            rw, lw = r.sum() + self_n, l.sum() + self_n
            gain -= f(rows + rw) - f(rows) + f(cols + lw) - f(cols)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b, :] += r
            table[:, b] += l
            table[b, b] += self_n
            if b != a:
                moved += 1
                label[w] = b
                row, col = counts[w], counts[:, w]
                into[:, a] -= row
                into[:, b] += row
                out[:, a] -= col
                out[:, b] += col
        if not moved:
            break
    return label


class Model:
    """What the workers need: bounded tables only."""

    def __init__(self, table: list[tuple[bytes, int, int]], total: int, distinct: int):
        self.table, self.total, self.distinct = table, total, distinct  # word, count, class
        self.mass, self.kinds, self.cells = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros((CLASSES, CLASSES))

    def packed(self) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The table as flat arrays, which a worker holds as long as it lives: words, their lengths, counts, classes."""
        words, counts, classes = zip(*self.table, strict=True) if self.table else ((), (), ())
        return b"".join(words), np.array([len(w) for w in words], np.uint8), np.array(counts, np.int64), np.array(classes, np.uint8)

    @property
    def unknown(self) -> int:
        """The class of words without a class of their own."""
        return int(np.argmax(self.kinds))

    @property
    def step(self) -> np.ndarray:
        """log10 of the probability of a class after a class."""
        apart = (self.mass + 1) / (self.mass.sum() + CLASSES)
        return np.log10((self.cells + 5 * apart[None, :]) / (self.cells.sum(1, keepdims=True) + 5))

    @property
    def below(self) -> np.ndarray:
        """log10 of what a word's count is divided by in its class."""
        return np.log10(self.mass + ADD * (self.kinds + 1))


def unpacked(words: bytes, sizes: np.ndarray) -> dict[bytes, int]:
    """The place of each word of :meth:`Model.packed`."""
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return {words[e - n : e]: i for i, (e, n) in enumerate(zip(ends, sizes.tolist(), strict=True))}


def word_classes(training: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """(word, c, k): count and class of every training word."""
    spark = training.sparkSession
    top = heaviest(counts, "c", 16 * OWN).toArrow()
    top = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    ends = training.count()  # one end token each
    own = ([(ends, END)] if ends else []) + [x for x in top if x[1] != END][: OWN - 1]
    place = {w: i for i, (_, w) in enumerate(own)}
    pairs = bigrams(training, text, place).toArrow()  # at most SYMBOLS squared
    matrix = np.zeros(SYMBOLS * SYMBOLS)
    matrix[pairs.column("code").to_numpy()] = pairs.column("n").to_numpy()
    matrix = matrix.reshape(SYMBOLS, SYMBOLS)
    label = np.append(exchange(matrix[:OWN, :OWN]), OTHER)
    one = np.zeros((SYMBOLS, CLASSES + 1))
    one[np.arange(SYMBOLS), label] = 1
    gain = joining_gain(one.T @ matrix @ one)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                n = context_counts(part.column(1).to_pylist())
                k = np.argmax(n @ gain, 1).astype(np.int16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n[:, : CLASSES + 1].sum(1).astype(np.int64)), pa.array(k)], names=["word", "c", "k"])

    near = neighbours(training, text, {w: int(label[i]) for w, i in place.items()})
    others = near.groupBy("word").agg(F.collect_list("near").alias("near")).mapInArrow(released(classed), "word binary, c long, k short")
    frequent = spark.createDataFrame([(bytearray(w), c, int(label[place[w]])) for c, w in own], "word binary, c long, k short")
    return materialize(others.unionByName(frequent), "classes")


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table (word, c, k) of all training words."""
    model, words, _ = _trained(docs, id_col, text, False)
    return model, words


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`score` of all rows by a model of the rows that aren't held out."""
    model, _, coded = _trained(docs, id_col, text, True)
    return _scored(coded, model, id_col)


def _trained(docs: DataFrame, id_col: str, text: str, code_all: bool) -> tuple[Model, DataFrame, DataFrame]:
    training = docs.where(~held_out(F.col(f"`{id_col}`")))
    counts = materialize(word_counts(training, text), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words = word_classes(training, text, counts)
    table = heaviest(words, "c", TABLE_WORDS).collect()
    model = Model([(bytes(r["word"]), r["c"], r["k"]) for r in table], total, distinct)
    for k, c, n in words.groupBy("k").agg(F.sum("c"), F.count(F.lit(1))).collect():  # CLASSES rows
        model.mass[k], model.kinds[k] = c, n
    coded = code(docs if code_all else training, model, words, id_col, text)
    for a, n in _transitions(coded.where(~held_out(F.col(f"`{id_col}`"))), model).collect():  # CLASSES squared
        model.cells[a // CLASSES, a % CLASSES] = n
    return model, words, coded


def code(docs: DataFrame, model: Model, words: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, n_tokens, n_known, n_once, counted and seq: the class of each token, a byte each.

    ``counted`` is the sum of log10(c + ADD).
    """
    sent = docs.sparkSession.sparkContext.broadcast((*model.packed(), model.unknown))
    rare_kind = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("at", T.BinaryType())]))
    numbers = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "n_once")]
    schema = T.StructType([docs.schema[id_col], *numbers, T.StructField("counted", T.DoubleType()), T.StructField("seq", T.BinaryType()), T.StructField("rare", rare_kind)])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed_words, sizes, counts, classes, unknown = sent.value
        get = unpacked(packed_words, sizes).get
        c = np.append(counts, 0)
        logs = np.log10(c + ADD)
        logs[-1] = 0  # what is not in the table is counted after the join
        label = np.append(classes, np.uint8(unknown))
        for batch in batches:
            i = j = 0
            for texts in text_runs(batch.column(1)):
                i, j = j, j + len(texts)
                made, names, places, ends = [], [], [], [0]
                for t in texts:
                    tokens = words_of(t)
                    tokens.append(END)
                    at = np.array([get(w, -1) for w in tokens], np.int64)
                    rare: dict[bytes, bytes] = {}
                    lost = np.flatnonzero(at < 0)
                    spots = lost.astype("<u4").tobytes()
                    for x, p in enumerate(lost.tolist()):
                        w = tokens[p]
                        rare[w] = rare.get(w, b"") + spots[4 * x : 4 * x + 4]
                    names += rare.keys()
                    places += rare.values()
                    ends.append(len(names))
                    seen = c[at]
                    made.append((len(tokens), int((seen > 0).sum()), int((seen == 1).sum()), math.fsum(logs[at].tolist()), label[at].tobytes()))
                arrays = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True)]
                pairs = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(places, pa.binary())], names=["word", "at"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=schema.names)

    first = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("__t")).mapInArrow(released(mapped), schema)
    first = materialize(first.withColumn("__row", F.monotonically_increasing_id()), "first")
    rare = first.select("__row", F.explode("rare").alias("r")).select("__row", "r.word", "r.at")
    n, known = F.octet_length("at") / 4, F.coalesce("c", F.lit(0))
    sums = (
        rare.join(words.select(F.col("word").alias("cw"), "c", "k"), F.col("word") == F.col("cw"), "left")
        .groupBy(F.col("__row").alias("__r")).agg(
            F.sum(F.when(known > 0, n).otherwise(0)).cast("long").alias("more_known"), F.sum(F.when(known == 1, n).otherwise(0)).cast("long").alias("more_once"),
            F.sum(n * F.log10(known + F.lit(ADD))).alias("more_counted"),
            F.collect_list(F.when(F.col("k").isNotNull(), F.struct("at", "k"))).alias("places"),
        )
    )
    more = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_known", "more_known"), ("n_once", "more_once"), ("counted", "more_counted"))]
    out = first.drop("rare").join(sums, F.col("__row") == F.col("__r"), "left").select(F.col(f"`{id_col}`"), "n_tokens", *more, "seq", "places")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in runs(pc.binary_length(batch.column(5)).to_pylist(), 1 << 20):
                part = batch.slice(i, j - i)
                seqs = part.column(5).to_pylist()
                start = np.concatenate(([0], np.cumsum([len(x) for x in seqs])))
                whole = np.frombuffer(b"".join(seqs), np.uint8).copy()
                found = part.column(6)
                owner = np.repeat(np.arange(j - i), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
                flat = found.flatten()
                spots, label = flat.field("at").to_pylist(), flat.field("k").to_numpy(zero_copy_only=False)
                n = np.array([len(x) // 4 for x in spots], np.int64)
                whole[np.repeat(start[owner], n) + np.frombuffer(b"".join(spots), "<u4")] = np.repeat(label, n)
                data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([*part.columns[:5], data], names=schema.names[:6])

    return materialize(out.mapInArrow(released(filled), T.StructType(schema.fields[:6])), "coded")


def _transitions(coded: DataFrame, model: Model) -> DataFrame:
    """(code, n): counts of neighbouring classes, code = first * CLASSES + second."""
    end = next((k for w, _, k in model.table if w == END), model.unknown)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            # Every sequence ends in the end token, so one follows from another.
            s = np.frombuffer(bytes([end]) + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(s[:-1] * CLASSES + s[1:], minlength=len(total))
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], names=["code", "n"])

    return coded.select("seq").mapInArrow(released(mapped), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, model: Model, words: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, n_once.

    ``n_once`` counts the tokens that training texts have once.
    """
    return _scored(code(docs, model, words, id_col, text), model, id_col)


def _scored(coded: DataFrame, model: Model, id_col: str) -> DataFrame:
    end = next((k for w, _, k in model.table if w == END), model.unknown)
    step, below = model.step, model.below
    kept = [c for c in coded.columns if c != "seq"]
    schema = T.StructType([*[coded.schema[c] for c in kept], T.StructField("steps", T.DoubleType())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for seq in batch.column(len(kept)).to_pylist():
                c = np.frombuffer(bytes([end]) + seq, np.uint8)
                made.append(float(step[c[:-1], c[1:]].sum() - below[c[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(made, pa.float64())], names=schema.names)

    base = math.log10(model.total + ADD * (model.distinct + 1))
    out = coded.select(*[F.col(f"`{c}`") for c in kept], "seq").mapInArrow(released(mapped), schema)
    counted, tokens, total = F.col("counted"), F.col("n_tokens"), F.col("counted") + F.col("steps")
    return out.select(
        F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), tokens, "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), (counted - tokens * base).alias("base_score"), total.alias("score"),
        F.pow(F.lit(10.0), -total / tokens).alias("perplexity"), "n_once",
    )
