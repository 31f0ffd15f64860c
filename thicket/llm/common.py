"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` sees it.
#: ``bytes.split()`` splits on exactly these six bytes.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

#: Texts are handled in runs of about this many bytes inside an Arrow batch, so
#: a worker's memory does not follow the row count of a batch.
RUN_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session decides; where it is unset, a session
    on one machine (a test) takes a temporary folder and a cluster raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="thicket-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/thicket-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote."""
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/thicket-" in f:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def heaviest(df: DataFrame, n: str, most: int) -> DataFrame:
    """At most ``most`` rows with the largest counts in column ``n``, at least 1 each.

    Rows are counted by the order of magnitude of ``n`` (16 steps an octave, so about
    a thousand numbers reach the driver), and whole steps are taken from the top. A
    sort with a limit would send ``most`` rows from every partition instead. If the
    top step alone has too many rows, shares of it by a hash are taken.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")
    sizes = dict(df.groupBy(step.alias("step")).count().collect())
    least, taken = None, 0
    for k in sorted(sizes, reverse=True):
        taken += sizes[k]
        if taken > most:
            break
        least = k
    if least is not None or not sizes:
        return df.where(F.lit(False)) if least is None else df.where(step >= least)
    top, share = df.where(step == max(sizes)), F.pmod(F.xxhash64(*df.columns), F.lit(4096))
    taken, shares = 0, []
    for k, size in sorted(top.groupBy(share.alias("share")).count().collect()):  # at most 4096
        if taken + size <= most:
            taken += size
            shares.append(k)
    return top.where(share.isin(shares))


#: Keys with over one HOT-th of all rows are hot: there are fewer than HOT of them.
HOT = 1000


def join_hot(rows: DataFrame, table: DataFrame, left: list[str], right: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, whose keys ``right`` are distinct.

    Column ``n`` of ``table`` says how many of ``rows`` a key has; it is dropped.
    A hot key's rows stay where they are: fewer than HOT rows of ``table`` are
    broadcast for them. Only the others are shuffled.
    """
    least = (table.agg(F.sum(n)).first()[0] or 0) / HOT
    names = [c for c in table.columns if c != n]
    met = reduce(Column.__and__, [F.col(f"`{x}`") == F.col(f"`{y}`") for x, y in zip(left, right, strict=True)])
    hot, rest = table.where(F.col(n) > least).select(*names), table.where(F.col(n) <= least).select(*names)
    cold = rows.join(F.broadcast(hot.select(*right)), met, "left_anti")
    return rows.join(F.broadcast(hot), met).unionByName(cold.join(rest.hint("merge"), met))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of every value; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def runs(sizes: Iterable[int], limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Slices [i, j) of rows whose sizes add up to about ``limit``."""
    start = total = at = 0
    for at, n in enumerate(sizes, 1):
        total += n
        if total >= limit:
            yield start, at
            start, total = at, 0
    if at > start:
        yield start, at


def release() -> None:
    """Give back a worker's freed memory: an idle worker counts to its executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_texts(df: DataFrame, keep: list[str], text: str, fields: list[T.StructField], make: Callable[[], Callable[[list[bytes]], list[list]]]) -> DataFrame:
    """``keep`` columns of ``df`` followed by computed ``fields``.

    ``make()`` runs once in each task and returns a function from a run of texts
    (UTF-8, null as empty) to one list for each field. Other columns of ``df``
    are not read, so their names can't clash; a kept column with the name of a
    field gives way to it.
    """
    keep = [c for c in keep if c not in {f.name for f in fields}]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    arrow = _arrow_types(fields)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            texts = text_bytes(batch.column(len(keep)))
            for i, j in runs(map(len, texts)):
                made = work(texts[i:j])
                arrays = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        if work is not None:
            work = batch = texts = made = arrays = None
            release()

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(mapped, schema)


def _arrow_types(fields: list[T.StructField]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in fields]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
