"""A corpus pipeline: five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.

Defined cases, for all stages: a null text counts as empty; a null id keeps its row
(of a group of near copies only if no other id is in it); repeated rows are handled
row by row, and near copies keep one of them; an empty table gives an empty table;
other columns pass through unchanged whatever their names are, since a stage sees
them under names of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import bpe_codec, decontam, lines, near_copies, quality
from thicket.llm.common import documents, materialize, tokenizer_path


USED = ("doc_id", "text", "n_chars")


def _aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with unused columns under private names, and the columns that undo it."""
    names = {c: c if c in USED else f"__c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(v).alias(c) for c, v in names.items()]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, back = _aside(docs)
    scored = quality.select(quality.score(docs, quality.train(docs, labels), docs.columns))
    return scored.where("selected").select(*back)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur in many of them."""
    docs, back = _aside(docs)
    return lines.dedup_lines(docs, length_col="n_chars").select(*back)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    docs, back = _aside(docs)
    return near_copies.one_of_each_group(docs).select(*back)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages don't contaminate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, back = _aside(docs)
    return decontam.overlaps(docs, benchmark).where("not contaminated").select(*back)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text that is left, and what they decode to."""
    return bpe_codec.encode(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage), ("lines", line_stage), ("near_copies", near_stage),
    ("decontamination", decontamination_stage), ("encoding", encoding_stage),
]

#: Three of the stages can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


