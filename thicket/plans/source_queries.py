"""Queries for sources, model files, seeds and whole fits, registered with the others."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import logit
from ..operators import explain, quantize, sampling, select
from ..operators.booster import Booster
from ..operators.frame import Frame
from ..sources import model_io, tabular
from .params import params
from .queries import _ID, _MARGIN, _NODES, _ROOT, _SIDE, BASE, FEATURES, KEY, PAIRS_SQL, RANKED_SQL, ROWS_SQL, hand_model, pairs, query, ranked, rows

_TEXT = "CAST(l_quantity AS DOUBLE) AS f0, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(l_tax AS DOUBLE) END AS f1, CAST(l_linenumber AS DOUBLE) AS f2, CAST(l_extendedprice AS DOUBLE) AS label"
_SPARSE = "CAST(l_discount AS DOUBLE) AS f0, CAST(l_tax AS DOUBLE) AS f1, CAST(l_linenumber AS DOUBLE) AS f2, CAST(l_extendedprice AS DOUBLE) AS label"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="thicket-")
    return f"{found.rstrip('/')}/thicket-{name}-{uuid.uuid4().hex}"


def _csv_files(spark: SparkSession, d: str) -> str:
    """Order lines as CSV lines with blank cells; the label last."""
    path = shared_path(spark, "csv")
    cells = ["f0", "f2", "f3", (F.col("label") / 100)]
    text = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cells]
    rows(spark, d).select(F.concat_ws(",", *text).alias("value")).write.text(path)
    return path


def _libsvm_files(spark: SparkSession, d: str) -> str:
    path = shared_path(spark, "libsvm")
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    parts = [F.when(F.col(c) != 0, F.concat(F.lit(f"{i}:"), F.col(c).cast("double").cast("string"))) for i, c in enumerate(("l_discount", "l_tax", "l_linenumber"))]
    t.select(F.concat_ws(" ", F.col("l_extendedprice").cast("double").cast("string"), *parts).alias("value")).write.text(path)
    return path


@query("read_csv", f"SELECT {_TEXT} FROM lineitem")
def read_csv(spark: SparkSession, d: str) -> DataFrame:
    return tabular.csv(spark, _csv_files(spark, d), 3).select("f0", "f1", "f2", "label")


@query("read_libsvm", f"SELECT {_SPARSE} FROM lineitem")
def read_libsvm(spark: SparkSession, d: str) -> DataFrame:
    return tabular.libsvm(spark, _libsvm_files(spark, d)).select("f0", "f1", "f2", "label")


@query("read_chunks", "SELECT CAST(4 AS INTEGER) AS chunks, 2 * count(*) AS n, round(sum(CAST(l_quantity AS DOUBLE)) * 2, 2) AS total FROM lineitem")
def read_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Four chunks (two of CSV, two of LibSVM), one at a time, against all of them at once."""
    a, b = _csv_files(spark, d), _libsvm_files(spark, d)
    csv, svm = tabular.ChunkedSource(spark, [a, a], "csv", 3), tabular.ChunkedSource(spark, [b], "libsvm", 3)
    chunks = [csv.chunk(0), csv.chunk(1), svm.chunk(0), csv.chunk(2)]
    each = chunks[0].select("f0").unionByName(chunks[1].select("f0"))
    sizes = len(csv) + len(svm) + (chunks[3] is None)
    return each.agg(F.lit(sizes).alias("chunks"), F.count(F.lit(1)).alias("n"), F.round(F.sum("f0"), 2).alias("total"))


@query("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(tabular.count_rows(spark, _csv_files(spark, d)),)], "n long")


@query("read_dense", "SELECT CAST(n_nationkey AS BIGINT) AS row_id, CAST(n_nationkey AS DOUBLE) AS f0, CASE WHEN n_regionkey = 2 THEN NULL ELSE CAST(n_regionkey AS DOUBLE) END AS f1, CAST(n_nationkey % 3 AS DOUBLE) AS label FROM nation")
def read_dense(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    data = [[float(r["n_nationkey"]), math.nan if r["n_regionkey"] == 2 else float(r["n_regionkey"])] for r in own]
    return tabular.dense(spark, data, [float(r["n_nationkey"] % 3) for r in own])


@query("model_json", f"WITH {ROWS_SQL} SELECT {_ID}, round(CAST({_MARGIN} AS DOUBLE), 6) AS margin FROM r")
def model_json(spark: SparkSession, d: str) -> DataFrame:
    """The hand-made model through the text of its JSON document."""
    model = model_io.from_document(json.loads(json.dumps(model_io.to_document(hand_model()))))
    return model.predict(rows(spark, d), margin=True).select(*KEY, "label", F.round("prediction", 6).alias("margin"))


@query("model_older", f"WITH {ROWS_SQL} SELECT k1, k2, k3, k4, label, CAST(CASE WHEN f0 <= 20 THEN 3 ELSE 5 END AS DOUBLE) AS margin FROM r")
def model_older(spark: SparkSession, d: str) -> DataFrame:
    """A document of the older form, whose thresholds are inclusive."""
    leaf = lambda k, v: {"id": k, "left": -1, "right": -1, "leaf_value": v}
    doc = {"objective": "reg:squarederror", "learning_rate": 0.5, "base_score": 1.0, "trees": [{"nodes": [{"id": 0, "feature": 0, "threshold": 20.0, "left": 1, "right": 2}, leaf(1, 4.0), leaf(2, 8.0)]}]}
    model = model_io.from_document(doc)
    model.features = FEATURES
    return model.predict(rows(spark, d), margin=True).select(*KEY, "label", F.col("prediction").alias("margin"))


@query("model_nodes", f"WITH {ROWS_SQL} SELECT {_ID}, round(CAST({_MARGIN} AS DOUBLE), 6) AS margin FROM r")
def model_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The hand-made model through its table of nodes."""
    own = hand_model()
    model = Booster.from_nodes(own.nodes(spark), own.params, own.features, own.base)
    return model.predict(rows(spark, d), margin=True).select(*KEY, "label", F.round("prediction", 6).alias("margin"))


@query("model_dot")
def model_dot(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(model_io.dump_dot(hand_model(), FEATURES).splitlines())), "n int, line string")


@query("importance_top", f"SELECT * FROM (SELECT feature, CAST(gain AS DOUBLE) AS score, row_number() OVER (ORDER BY gain DESC, feature) AS rank FROM {_NODES}) WHERE rank <= 2")
def importance_top(spark: SparkSession, d: str) -> DataFrame:
    """The two features with the largest gain."""
    return explain.importance_ranking(hand_model(), spark).select("feature", "score", F.col("rank").cast("long").alias("rank")).where("rank <= 2")


@query("initial_mean", f"WITH {PAIRS_SQL} SELECT round(avg(y), 6) AS base FROM d")
def initial_mean(spark: SparkSession, d: str) -> DataFrame:
    """The base margin of a regression: the labels' mean."""
    base = Booster(params(objective="reg:squarederror"))._base(pairs(spark, d).withColumnRenamed("y", "__y"))
    return spark.createDataFrame([(round(float(base), 6),)], "base double")


@query("initial_logit", f"WITH {PAIRS_SQL} SELECT round(ln(avg(b) / (1 - avg(b))), 6) AS base FROM d")
def initial_logit(spark: SparkSession, d: str) -> DataFrame:
    """The base margin of a classification; labels over 0 count as 1."""
    df = pairs(spark, d).select((F.col("b") * 3).alias("raw")).withColumn("__y", (F.col("raw") > 0).cast("double"))
    c = params(objective="binary:logistic")
    base = Booster(c)._base(df) if c.boost_from_average else logit(df.agg(F.avg("__y")).first()[0])
    return spark.createDataFrame([(round(float(base), 6),)], "base double")


@query("uniform_draws", "SELECT i, round(v / 4294967296, 9) AS u FROM (VALUES (0, CAST(1608637542 AS DOUBLE)), (1, 3421126067), (2, 4083286876), (3, 787846414), (4, 3143890026), (5, 3348747335), (6, 2571218620), (7, 2563451924), (8, 670094950), (9, 1914837113)) AS t(i, v)")
def uniform_draws(spark: SparkSession, d: str) -> DataFrame:
    """The first draws of the Mersenne twister for seed 42; the SQL has its published outputs."""
    return spark.createDataFrame([(i, round(float(u), 9)) for i, u in enumerate(sampling.draws(42, 10))], "i int, u double")


_M64 = "18446744073709551616::UHUGEINT"


def _mixed_sql(x: str, shift: int, factor: str) -> str:
    return f"((xor({x}::UBIGINT, {x}::UBIGINT >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_M64})"


@query("derived_seeds", f"""WITH s AS (SELECT CAST(i AS INTEGER) AS iteration, CAST(k AS INTEGER) AS kind, (7::UHUGEINT + i::UHUGEINT * 6364136223846793005::UHUGEINT + k::UHUGEINT * 1442695040888963407::UHUGEINT) % {_M64} AS x
    FROM range(0, 50) AS a(i), range(0, 4) AS b(k)), t AS (SELECT iteration, kind, {_mixed_sql('x', 30, '13787848793156543929')} AS x FROM s), u AS (SELECT iteration, kind, {_mixed_sql('x', 27, '10723151780598845931')} AS x FROM t)
    SELECT iteration, kind, CAST(xor(x::UBIGINT, x::UBIGINT >> 31) % 4294967296 AS BIGINT) AS seed FROM u""")
def derived_seeds(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, k, sampling.derive_seed(7, i, k)) for i in range(50) for k in range(4)], "iteration int, kind int, seed long")


@query("parameter_apply", "SELECT * FROM (VALUES ('eta', '0.5'), ('lambda_', '2.0'), ('max_depth', '4'), ('num_trees', '7')) AS t(name, value)")
def parameter_apply(spark: SparkSession, d: str) -> DataFrame:
    c = params(max_depth=3, num_trees=7).with_(max_depth=4, eta=0.5, lambda_=2.0)
    return spark.createDataFrame([(k, str(getattr(c, k))) for k in ("eta", "lambda_", "max_depth", "num_trees")], "name string, value string")


@query("random_combinations", "SELECT CAST(6 AS BIGINT) AS n, CAST(0 AS BIGINT) AS outside")
def random_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Random search draws as many combinations as asked for, from the space only."""
    space = {"max_depth": [1, 2, 3], "eta": [0.1, 0.3]}
    drawn = select.random_combinations(space, 6, 3)
    outside = sum(c["max_depth"] not in space["max_depth"] or c["eta"] not in space["eta"] for c in drawn)
    return spark.createDataFrame([(len(drawn), outside)], "n long, outside long")


@query("sketch_merge", f"WITH {PAIRS_SQL} SELECT count(*) AS n, round(sum(w), 4) AS weight FROM d")
def sketch_merge(spark: SparkSession, d: str) -> DataFrame:
    """Weighted summaries of the partitions, merged: a count and a weight that no pruning changes."""

    def one(batches):
        import pandas as pd

        sketch, n = quantize.QuantileSketch(128), 0
        for t in batches:
            n += len(t)
            for v, w in zip(t["p"].tolist(), t["w"].tolist(), strict=True):
                sketch.push(v, w)
        sketch.compress()
        yield pd.DataFrame({"n": [n], "value": [sketch.value.tolist()], "w": [sketch.w.tolist()]})

    whole, n = quantize.QuantileSketch(128), 0
    for r in pairs(spark, d).select("p", "w").mapInPandas(one, "n long, value array<double>, w array<double>").collect():  # a summary for each partition
        part = quantize.QuantileSketch(128)
        part.value, part.w = np.array(r["value"]), np.array(r["w"])
        whole.merge(part)
        n += r["n"]
    return spark.createDataFrame([(n, round(whole.total, 4))], "n long, weight double")


@query("margin_start", f"WITH {PAIRS_SQL} SELECT row_id, round(p, 6) AS start, round(p - y, 6) AS g FROM d")
def margin_start(spark: SparkSession, d: str) -> DataFrame:
    """Gradients of a regression that starts from the rows' own margins."""
    df = pairs(spark, d).select("row_id", F.col("y").alias("__y"), F.lit(1.0).alias("__w"), F.array("p").alias("__m"))
    made = Booster(params(objective="reg:squarederror"))._gradients(df, None, params(objective="reg:squarederror"))[0]
    return made.select("row_id", F.round(F.col("__m")[0], 6).alias("start"), F.round(F.col("__g")[0], 6).alias("g"))


# ---- whole fits: one tree of two leaves, by each strategy, against the SQL of a split search ----

_STUMP = f"WITH {_ROOT}, a AS (SELECT b.*, {_SIDE} AS go_left, gl, hl, gp, hp FROM b, root), z AS (SELECT label, {BASE:.1f}::DOUBLE + CASE WHEN go_left THEN -gl / (hl + 1) ELSE -(gp - gl) / (hp - hl + 1) END AS p FROM a) SELECT round(sqrt(avg((p - label) * (p - label))), 2) AS rmse, count(*) AS n FROM z"


def _stump(strategy: str, **more):
    def run(spark: SparkSession, d: str) -> DataFrame:
        frame = Frame(rows(spark, d).withColumn("row_id", F.xxhash64(*KEY, "label")), FEATURES)
        c = params(**({"num_trees": 1, "max_depth": 1, "eta": 1.0, "base_score": BASE, "boost_from_average": False} | more))
        model = Booster.fit(frame, c, strategy=strategy)
        error = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("label"), 2)))
        return model.predict(frame.df).agg(F.round(error, 2).alias("rmse"), F.count(F.lit(1)).alias("n"))

    return run


query("stump_fit", _STUMP)(_stump("spark"))
query("stump_fit_catalyst", _STUMP)(_stump("catalyst"))
query("stump_fit_local", _STUMP)(_stump("local"))
query("stump_fit_lossguide", _STUMP)(_stump("spark", max_leaves=2, max_depth=0))


@query("stump_leaves", f"""WITH {RANKED_SQL}, s AS (SELECT group_id % 2 = 0 AS even, sum(0.5 - (margin + 10 * (group_id % 2))) AS g, count(*) AS h FROM e GROUP BY 1)
    SELECT even, round(-g / (h + 1), 6) AS leaf FROM s""")
def stump_leaves(spark: SparkSession, d: str) -> DataFrame:
    """A stump on one indicator: its two leaves are the shrunk means of the residuals."""
    x = (F.col("group_id") % 2).cast("double")
    df = ranked(spark, d).select("row_id", (F.col("margin") + 10 * x).alias("label"), x.alias("x"))
    model = Booster.fit(Frame(df, ("x",)), params(num_trees=1, max_depth=1, eta=1.0, base_score=0.5, boost_from_average=False), strategy="spark")
    each = df.select("x").distinct()
    return model.predict(each, margin=True).select((F.col("x") == 0).alias("even"), F.round(F.col("prediction") - 0.5, 6).alias("leaf"))
