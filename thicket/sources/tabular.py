"""Readers of feature tables: dense, sparse triples, CSV and LibSVM text, many files.

Every reader gives a DataFrame with ``row_id``, ``f0..fn`` and ``label``; null is a
missing value. Text is parsed by Spark functions, line by line in the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import FrameError


def dense(spark: SparkSession, data: Sequence[Sequence[float]], labels: Sequence[float]) -> DataFrame:
    """From lists; raises for empty, ragged or unlabelled data."""
    if not data or not data[0]:
        raise FrameError("there are no data")
    if len(labels) != len(data):
        raise FrameError("labels and rows differ in number")
    if any(len(r) != len(data[0]) for r in data):
        raise FrameError("rows differ in length")
    names = ", ".join(f"f{i} double" for i in range(len(data[0])))
    rows = [(i, *[None if v != v else float(v) for v in r], float(y)) for i, (r, y) in enumerate(zip(data, labels, strict=True))]
    return spark.createDataFrame(rows, f"row_id long, {names}, label double")


def from_triples(triples: DataFrame, labels: DataFrame, width: int, row: str = "row_id", col: str = "col_idx", value: str = "value") -> DataFrame:
    """From (row, column, value); an absent cell is 0.0, a NaN is missing.

    The columns are known, so the pivot is one grouped aggregate without a scan for
    the distinct columns.
    """
    cells = triples.groupBy(row).agg(*[F.max(F.when(F.col(col) == i, F.struct(F.nanvl(F.col(value), F.lit(None)).alias("v")))).alias(f"c{i}") for i in range(width)])
    out = labels.join(cells, row, "left")
    return out.select(row, *[F.when(F.col(f"c{i}").isNull(), 0.0).otherwise(F.col(f"c{i}.v")).alias(f"f{i}") for i in range(width)], "label")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, line) of text files; line_no orders lines within a file."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("line"))
    return lines.where("line <> ''")


def _numbered(df: DataFrame) -> DataFrame:
    """row_id from the reading order, unique but with gaps."""
    return df.withColumnRenamed("line_no", "row_id")


def csv(spark: SparkSession, paths: str | list[str], features: int, label_last: bool = True) -> DataFrame:
    """Header-less CSV, the label last. Lines of under two fields are skipped.

    Blank or bad feature cells are missing; a bad label raises when it is read.
    """
    parts = _lines(spark, paths).withColumn("p", F.split("line", ",")).where(F.size("p") >= 2)
    cells = [F.expr(f"nanvl(try_cast(trim(try_element_at(p, {i + 1})) as double), null)").alias(f"f{i}") for i in range(features)]
    at = "size(p) - 1" if label_last else str(features)
    label = F.expr(f"cast(trim(p[{at}]) as double)").alias("label")
    return _numbered(parts.select("line_no", *cells, label))


def libsvm(spark: SparkSession, paths: str | list[str], width: int | None = None, first_index: int = 0) -> DataFrame:
    """``label index:value ...``; indices as given (from ``first_index``), absent is 0.0.

    Rows with a label only are kept. The width is the largest index if not given.
    """
    parts = _lines(spark, paths).withColumn("p", F.filter(F.split("line", r"\s+"), lambda x: x != ""))
    pairs = F.expr("filter(transform(slice(p, 2, greatest(size(p) - 1, 0)), x -> struct(try_cast(split_part(x, ':', 1) as int) as i, try_cast(split_part(x, ':', 2) as double) as v)), x -> x.i is not null)")
    cells = parts.select("line_no", F.expr("cast(p[0] as double)").alias("label"), pairs.alias("pairs"))
    if width is None:
        found = cells.agg(F.max(F.expr("array_max(transform(pairs, x -> x.i))"))).first()[0]
        width = 0 if found is None else found - first_index + 1
    by = F.map_from_entries(F.expr("transform(array_distinct(transform(pairs, x -> x.i)), i -> struct(i as key, element_at(filter(pairs, x -> x.i = i), -1).v as value))"))
    with_map = cells.withColumn("m", by)
    out = [F.when(F.map_contains_key("m", F.lit(i + first_index)), F.nanvl(F.col("m")[i + first_index], F.lit(None))).otherwise(0.0).alias(f"f{i}") for i in range(width)]
    return _numbered(with_map.select("line_no", *out, "label"))


class ChunkedSource:
    """Several files as one table, or one file of them at a time."""

    def __init__(self, spark: SparkSession, paths: list[str], kind: str, features: int):
        if not paths:
            raise FrameError("there are no files")
        if kind not in ("csv", "libsvm"):
            raise FrameError(f"unknown format {kind!r}")
        self.spark, self.paths, self.kind, self.features = spark, list(paths), kind, features

    def __len__(self) -> int:
        return len(self.paths)

    def chunk(self, i: int) -> DataFrame | None:
        return self._read([self.paths[i]]) if i < len(self.paths) else None

    def all(self) -> DataFrame:
        return self._read(self.paths)

    def _read(self, paths: list[str]) -> DataFrame:
        return csv(self.spark, paths, self.features) if self.kind == "csv" else libsvm(self.spark, paths, self.features)


def count_rows(spark: SparkSession, paths: str | list[str]) -> int:
    """Lines that aren't blank."""
    return spark.read.text(paths).where(F.trim("value") != "").count()


def detect_categories(df: DataFrame, features: list[str], most: int = 64) -> dict[str, list[float]]:
    """Sorted values of the features that look categorical: whole numbers, 2 to ``most`` of them.

    Counts first (bounded state), then collects the values of those found.
    """
    x = {f: F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None)) for f in features}
    r = df.agg(*[F.struct(F.approx_count_distinct(x[f], 0.02).alias("n"), F.coalesce(F.bool_and(x[f] == F.floor(x[f])), F.lit(False)).alias("whole")).alias(f) for f in features]).first()
    likely = [f for f in features if r[f]["whole"] and r[f]["n"] <= 2 * most]
    out = {}
    for f in likely:
        values = [v[0] for v in df.select(x[f].alias("v")).where("v is not null").distinct().limit(most + 1).collect()]
        if 2 <= len(values) <= most:
            out[f] = sorted(values)
    return out


def one_hot(df: DataFrame, categories: dict[str, list[float]]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Replaces each feature by indicators of all but its first value; unknown and missing are all 0."""
    names, cols = {}, []
    for c in df.columns:
        if c in categories:
            made = [f"{c}_{i}" for i in range(1, len(categories[c]))]
            names[c] = made
            cols += [F.coalesce((F.col(f"`{c}`") == v).cast("double"), F.lit(0.0)).alias(n) for n, v in zip(made, categories[c][1:], strict=True)]
        else:
            cols.append(F.col(f"`{c}`"))
    return df.select(*cols), names
