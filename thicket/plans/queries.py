"""Queries over the shared test tables, one for each operator, and SQL for most.

Three small views carry the examples: ``rows`` (order lines with four features,
one of them with missing values, and a label in whole cents, so that sums are
exact in any order), ``pairs`` (orders with a margin, labels and a weight) and
``ranked`` (events with scores and grades in groups of a user).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import metrics as M
from ..functions import objectives as O
from ..operators import explain, linear, local, multi, quantize, sampling, select, spark_grow
from ..operators.booster import Booster
from ..operators.frame import Frame
from ..operators.tree import Node, Tree
from ..sources import tabular
from .params import Params, params

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FEATURES = ("f0", "f1", "f2", "f3")
KEY = ("k1", "k2", "k3", "k4")
BASE = 3_800_000.0  # a fixed base margin in cents

#: The views in SQL; each oracle starts with those it needs.
ROWS_SQL = """r AS (SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_quantity AS f0, l_discount AS f1,
    CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_tax END AS f2, CAST(l_linenumber AS DOUBLE) AS f3, round(l_extendedprice * 100) AS label, l_returnflag AS flag FROM lineitem)"""
PAIRS_SQL = """d AS (SELECT o_orderkey AS row_id, ((o_orderkey % 97) - 48) / CAST(24 AS DOUBLE) AS p, o_totalprice / CAST(99991 AS DOUBLE) AS y,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS b, 1 + (o_orderkey % 4) / CAST(4 AS DOUBLE) AS w FROM orders)"""
RANKED_SQL = """e AS (SELECT event_id AS row_id, user_id AS group_id, value / CAST(100 AS DOUBLE) AS margin,
    CAST(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS DOUBLE) AS label FROM events)"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"), F.col("l_quantity").alias("f0"), F.col("l_discount").alias("f1"),
        F.when(F.col("l_orderkey") % 10 != 0, F.col("l_tax")).alias("f2"), F.col("l_linenumber").cast("double").alias("f3"), F.round(F.col("l_extendedprice") * 100).alias("label"), F.col("l_returnflag").alias("flag"),
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("row_id"), ((k % 97 - 48) / 24.0).alias("p"), (F.col("o_totalprice") / 99991.0).alias("y"), F.when(k % 3 == 0, 1.0).otherwise(0.0).alias("b"), (1 + (k % 4) / 4.0).alias("w"))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    grade = F.when(kind == "purchase", 3.0).when(kind == "signup", 2.0).when(kind == "click", 1.0).otherwise(0.0)
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("group_id"), (F.col("value") / 100.0).alias("margin"), grade.alias("label"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


# ---- data ----


@query("ingest_features", f"WITH {ROWS_SQL} SELECT k1, k2, k3, k4, label, f0, f1, f2, f3 FROM r")
def ingest_features(spark: SparkSession, d: str) -> DataFrame:
    df = rows(spark, d).withColumn("row_id", F.xxhash64(*KEY, "label"))
    return Frame(df, FEATURES, "label", "row_id").selected().join(df.select("row_id", *KEY), "row_id").select(*KEY, "label", *FEATURES)


@query("missing_profile", f"WITH {ROWS_SQL} SELECT 'f0' AS feature, bool_or(f0 IS NULL) AS missing FROM r UNION ALL SELECT 'f1', bool_or(f1 IS NULL) FROM r UNION ALL SELECT 'f2', bool_or(f2 IS NULL) FROM r UNION ALL SELECT 'f3', bool_or(f3 IS NULL) FROM r")
def missing_profile(spark: SparkSession, d: str) -> DataFrame:
    found = Frame(rows(spark, d).withColumn("row_id", F.col("k1")), FEATURES).has_missing()
    return spark.createDataFrame(list(found.items()), "feature string, missing boolean")


@query("csr_densify", """SELECT event_id AS row_id, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS f0, CASE WHEN event_type = 'error' THEN value ELSE 0 END AS f1,
    CASE WHEN event_type = 'view' THEN value ELSE 0 END AS f2, CAST(user_id AS DOUBLE) AS label FROM events""")
def csr_densify(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet")
    col = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2)
    triples = t.select(F.col("event_id").alias("row_id"), col.alias("col_idx"), "value").where("col_idx is not null")
    return tabular.from_triples(triples, t.select(F.col("event_id").alias("row_id"), F.col("user_id").cast("double").alias("label")), 3)


@query("category_detect", f"""WITH {ROWS_SQL}, u AS (SELECT 'f0' AS feature, f0 AS v FROM r UNION ALL SELECT 'f1', f1 FROM r UNION ALL SELECT 'f2', f2 FROM r UNION ALL SELECT 'f3', f3 FROM r),
    g AS (SELECT feature, bool_and(v = floor(v)) AS whole, count(DISTINCT v) AS n FROM u WHERE v IS NOT NULL GROUP BY feature)
    SELECT DISTINCT u.feature, u.v AS value FROM u JOIN g USING (feature) WHERE whole AND n BETWEEN 2 AND 64 AND v IS NOT NULL""")
def category_detect(spark: SparkSession, d: str) -> DataFrame:
    found = tabular.detect_categories(rows(spark, d), list(FEATURES))
    return spark.createDataFrame([(f, v) for f, vs in found.items() for v in vs], "feature string, value double")


@query("onehot_dropfirst", f"WITH {ROWS_SQL} SELECT k1, k2, k3, k4, label, CAST(f3 = 2 AS DOUBLE) AS f3_1, CAST(f3 = 3 AS DOUBLE) AS f3_2, CAST(f3 = 4 AS DOUBLE) AS f3_3 FROM r")
def onehot_dropfirst(spark: SparkSession, d: str) -> DataFrame:
    out, _ = tabular.one_hot(rows(spark, d).select(*KEY, "label", "f3"), {"f3": [1.0, 2.0, 3.0, 4.0]})
    return out


SUMMARY_SQL = f"""{ROWS_SQL}, u AS (SELECT 0 AS feature, CAST(f0 AS FLOAT) AS v FROM r UNION ALL SELECT 1, CAST(f1 AS FLOAT) FROM r UNION ALL SELECT 2, CAST(f2 AS FLOAT) FROM r UNION ALL SELECT 3, CAST(f3 AS FLOAT) FROM r),
    s AS (SELECT feature, v, CAST(count(*) AS DOUBLE) AS w FROM u WHERE v IS NOT NULL GROUP BY feature, v)"""


@query("weighted_distinct_summary", f"WITH {SUMMARY_SQL} SELECT feature, CAST(v AS DOUBLE) AS value, w, sum(w) OVER (PARTITION BY feature ORDER BY v) - w AS rmin, sum(w) OVER (PARTITION BY feature ORDER BY v) AS rmax FROM s")
def weighted_distinct_summary(spark: SparkSession, d: str) -> DataFrame:
    return quantize.summarize(rows(spark, d), list(FEATURES))


CUTS_SQL = f"""{SUMMARY_SQL}, c AS (SELECT feature, CAST(v AS DOUBLE) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v) AS i FROM s) WHERE i > 1
    UNION ALL SELECT feature, CAST(CAST(max(v) + CAST(abs(max(v)) + CAST(0.00001 AS FLOAT) AS FLOAT) AS FLOAT) AS DOUBLE) FROM s GROUP BY feature)"""


@query("cuts_lowcard", f"WITH {CUTS_SQL} SELECT feature, cut FROM c")
def cuts_lowcard(spark: SparkSession, d: str) -> DataFrame:
    cuts = quantize.cut_table(rows(spark, d), list(FEATURES), 256)
    return spark.createDataFrame([(f, float(x)) for f, xs in enumerate(cuts) for x in xs], "feature int, cut double")


@query("cuts_orderstat", """WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)
    SELECT DISTINCT v AS cut FROM o WHERE i IN (SELECT CAST(floor(k * n / CAST(16 AS DOUBLE)) AS BIGINT) FROM (SELECT unnest(range(1, 16)) AS k, (SELECT count(*) FROM orders) AS n))""")
def cuts_orderstat(spark: SparkSession, d: str) -> DataFrame:
    return quantize.order_statistic_cuts(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", 16)


@query("cuts_pruned")
def cuts_pruned(spark: SparkSession, d: str) -> DataFrame:
    cuts = quantize.cut_table(spark.read.parquet(f"{d}/orders.parquet"), ["o_totalprice"], 64)
    return spark.createDataFrame([(float(x),) for x in cuts[0]], "cut double")


def _bin_sql(f: int) -> str:
    return f"CASE WHEN f{f} IS NULL THEN -1 ELSE (SELECT count(*) FROM c WHERE feature = {f} AND cut <= f{f}) END"


BINS_SQL = f"{CUTS_SQL}, v AS (SELECT DISTINCT f0, f1, f2, f3 FROM r), m AS (SELECT f0, f1, f2, f3, {', '.join(f'{_bin_sql(f)} AS b{f}' for f in range(4))} FROM v), b AS (SELECT r.*, b0, b1, b2, b3 FROM r JOIN m ON r.f0 = m.f0 AND r.f1 = m.f1 AND r.f2 IS NOT DISTINCT FROM m.f2 AND r.f3 = m.f3)"


def binned(spark: SparkSession, d: str) -> tuple[DataFrame, list[np.ndarray]]:
    df = rows(spark, d)
    cuts = quantize.cut_table(df, list(FEATURES), 256)
    return quantize.with_bins(df, list(FEATURES), cuts), cuts


@query("bin_assign", f"WITH {BINS_SQL} SELECT k1, k2, k3, k4, label, b0, b1, b2, b3 FROM b")
def bin_assign(spark: SparkSession, d: str) -> DataFrame:
    df, _ = binned(spark, d)
    return df.select(*KEY, "label", *[F.col("bins")[i].cast("long").alias(f"b{i}") for i in range(4)])


@query("bin_expression", "WITH q AS (SELECT o_orderkey AS row_id, o_totalprice AS x FROM orders) SELECT row_id, CAST((x >= 1000) AS INTEGER) + CAST((x >= 100000) AS INTEGER) + CAST((x >= 250000) AS INTEGER) AS bin, CASE CAST((x >= 1000) AS INTEGER) + CAST((x >= 100000) AS INTEGER) + CAST((x >= 250000) AS INTEGER) WHEN 0 THEN CAST(1000 AS DOUBLE) WHEN 1 THEN CAST(100000 AS DOUBLE) ELSE CAST(250000 AS DOUBLE) END AS threshold FROM q")
def bin_expression(spark: SparkSession, d: str) -> DataFrame:
    cuts = [1000.0, 100000.0, 250000.0]
    x = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), E.bin_of(F.col("o_totalprice"), cuts).alias("bin"))
    return x.withColumn("threshold", E.threshold_of(F.col("bin"), cuts))


# ---- gradients and links ----

_S = "CASE WHEN p >= 0 THEN 1 / (1 + exp(-p)) ELSE exp(p) / (1 + exp(p)) END"
_Z = "((ln(greatest(y, 1e-6)) - p))"
#: objective -> (label column, g, h) in SQL
GRADIENTS: dict[str, tuple[str, str, str]] = {
    "reg:squarederror": ("y", "p - y", "1.0"),
    "reg:logistic": ("b", f"({_S}) - b", f"greatest(({_S}) * (1 - ({_S})), 1e-16)"),
    "binary:logistic": ("b", f"({_S}) - b", f"greatest(({_S}) * (1 - ({_S})), 1e-16)"),
    "binary:logitraw": ("b", f"({_S}) - b", f"greatest(({_S}) * (1 - ({_S})), 1e-16)"),
    "count:poisson": ("y", "exp(p) - y", "exp(p)"),
    "reg:gamma": ("y", "1 - y * exp(-p)", "y * exp(-p)"),
    "reg:tweedie": ("y", "exp(0.5 * p) - y * exp(-0.5 * p)", "0.5 * exp(0.5 * p) + 0.5 * y * exp(-0.5 * p)"),
    "reg:squaredlogerror": ("y", "CASE WHEN p > -1 THEN (ln(1 + greatest(p, -0.99999)) - ln(1 + y)) / (1 + p) ELSE 0 END", "CASE WHEN p > -1 THEN greatest((1 - ln(1 + greatest(p, -0.99999)) + ln(1 + y)) / ((1 + p) * (1 + p)), 1e-6) ELSE 1e-6 END"),
    "reg:absoluteerror": ("y", "CASE WHEN abs(p - y) < 1e-8 THEN 0 ELSE sign(p - y) END", "CASE WHEN abs(p - y) < 1e-8 THEN 1 ELSE 1 / abs(p - y) END"),
    "reg:pseudohubererror": ("y", "(p - y) / sqrt(1 + (p - y) * (p - y))", "1 / pow(sqrt(1 + (p - y) * (p - y)), 3)"),
    "reg:quantileerror": ("y", "CASE WHEN p >= y THEN 0.5 ELSE -0.5 END", "1.0"),
    "binary:hinge": ("b", "CASE WHEN (2 * b - 1) * p < 1 THEN 1 - 2 * b ELSE 0 END", "1.0"),
    "survival:aft": ("y", f"-{_Z}", "1.0"),
}
NAME = lambda o: o.split(":")[0] + "_" + o.split(":")[1]


def _gradient_query(objective: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g, h = O.gradient(Params(objective=objective), F.col("p"), F.col(GRADIENTS[objective][0]))
        return pairs(spark, d).select("row_id", F.round(g, 5).alias("g"), F.round(h, 5).alias("h"))

    return run


for _o, (_y, _g, _h) in GRADIENTS.items():
    QUERIES[f"grad_{NAME(_o)}"] = _gradient_query(_o)
    SQL[f"grad_{NAME(_o)}"] = f"WITH {PAIRS_SQL} SELECT row_id, round(CAST({_g} AS DOUBLE), 5) AS g, round(CAST({_h} AS DOUBLE), 5) AS h FROM d"


@query("grad_weighted", f"WITH {PAIRS_SQL} SELECT row_id, round((p - y) * w, 5) AS g, round(w, 5) AS h FROM d")
def grad_weighted(spark: SparkSession, d: str) -> DataFrame:
    g, h = O.gradient(Params(), F.col("p"), F.col("y"), F.col("w"))
    return pairs(spark, d).select("row_id", F.round(g, 5).alias("g"), F.round(h, 5).alias("h"))


@query("grad_scale_pos_weight", f"WITH {PAIRS_SQL} SELECT row_id, round((({_S}) - b) * CASE WHEN b > 0 THEN 2.5 ELSE 1 END, 5) AS g, round(({_S}) * (1 - ({_S})) * CASE WHEN b > 0 THEN 2.5 ELSE 1 END, 5) AS h FROM d")
def grad_scale_pos_weight(spark: SparkSession, d: str) -> DataFrame:
    g, h = O.gradient(params(objective="binary:logistic", scale_pos_weight=2.5), F.col("p"), F.col("b"))
    return pairs(spark, d).select("row_id", F.round(g, 5).alias("g"), F.round(h, 5).alias("h"))


_SOFT = "SELECT row_id, row_id % 3 AS y, exp(p) / (exp(p) + exp(p / 2) + exp(-p)) AS q0, exp(p / 2) / (exp(p) + exp(p / 2) + exp(-p)) AS q1, exp(-p) / (exp(p) + exp(p / 2) + exp(-p)) AS q2 FROM d"


@query("grad_multi_softprob", f"WITH {PAIRS_SQL}, q AS ({_SOFT}) " + " UNION ALL ".join(f"SELECT row_id, {k} AS class, round(q{k} - CAST(y = {k} AS DOUBLE), 5) AS g, round(q{k} * (1 - q{k}), 5) AS h FROM q" for k in range(3)))
def grad_multi_softprob(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    g, h = O.class_gradient(F.array(p, p / 2, -p), F.col("row_id") % 3, 3)
    return pairs(spark, d).select("row_id", F.posexplode(F.arrays_zip(g.alias("g"), h.alias("h"))).alias("class", "x")).select("row_id", "class", F.round("x.g", 5).alias("g"), F.round("x.h", 5).alias("h"))


_RANK = f"""{RANKED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY margin DESC, row_id) AS r, row_number() OVER (PARTITION BY group_id ORDER BY label DESC, row_id) AS best, pow(2, label) - 1 AS gain FROM e),
    k2 AS (SELECT *, sum(gain / log2(best + 1)) OVER (PARTITION BY group_id) AS idcg,
        sum(CAST(label > 0 AS DOUBLE)) OVER (PARTITION BY group_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS hits, sum(CAST(label > 0 AS DOUBLE)) OVER (PARTITION BY group_id) AS total,
        sum(CAST(label > 0 AS DOUBLE) / r) OVER (PARTITION BY group_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS pre FROM k),
    j AS (SELECT a.group_id, a.row_id AS ra, b.row_id AS rb, 1 / (1 + exp(a.margin - b.margin)) AS rho, WEIGHT AS wt FROM k2 a JOIN k2 b ON a.group_id = b.group_id AND a.label > b.label),
    x AS (SELECT group_id, ra AS row_id, -rho * wt AS g, greatest(rho * (1 - rho), 1e-16) * wt AS h FROM j UNION ALL SELECT group_id, rb, rho * wt, greatest(rho * (1 - rho), 1e-16) * wt FROM j)
    SELECT group_id, row_id, round(sum(g), 5) AS g, round(sum(h), 5) AS h FROM x GROUP BY group_id, row_id"""
_RANK_WEIGHTS = {
    "rank:pairwise": "1.0",
    "rank:ndcg": "CASE WHEN a.idcg > 0 THEN abs((a.gain - b.gain) * (1 / log2(a.r + 1) - 1 / log2(b.r + 1))) / a.idcg ELSE 0 END",
    "rank:map": """CASE WHEN a.total > 0 AND a.label > 0 AND b.label <= 0 THEN abs(CASE WHEN a.r < b.r THEN a.hits / a.r - b.hits / b.r + b.pre - a.pre
        ELSE (b.hits + 1) / b.r - a.hits / a.r + (a.pre - CAST(1 AS DOUBLE) / a.r) - b.pre END) / a.total ELSE 0 END""",
}


def _rank_query(objective: str) -> Query:
    return lambda spark, d: O.pair_gradient(ranked(spark, d), objective).select("group_id", "row_id", F.round("g", 5).alias("g"), F.round("h", 5).alias("h"))


for _o, _w in _RANK_WEIGHTS.items():
    QUERIES[f"grad_{NAME(_o)}"] = _rank_query(_o)
    SQL[f"grad_{NAME(_o)}"] = "WITH " + _RANK.replace("WEIGHT", _w)


@query("grad_survival_cox", f"""WITH {PAIRS_SQL}, s AS (SELECT row_id, p, round(y + 1, 1) AS t, row_id % 3 <> 0 AS event FROM d), t AS (SELECT t, sum(exp(p)) AS e, sum(CAST(event AS DOUBLE)) AS n FROM s GROUP BY t),
    k AS (SELECT t, n, sum(e) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS risk FROM t),
    c AS (SELECT t, sum(n / risk) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS r1, sum(n / (risk * risk)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS r2 FROM k)
    SELECT row_id, round(exp(p) * r1 - CAST(event AS DOUBLE), 5) AS g, round(exp(p) * r1 - exp(p) * exp(p) * r2, 5) AS h FROM s JOIN c USING (t)""")
def grad_survival_cox(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d).select("row_id", F.col("p").alias("margin"), F.when(F.col("row_id") % 3 != 0, F.round(F.col("y") + 1, 1)).otherwise(-F.round(F.col("y") + 1, 1)).alias("label"))
    return O.cox_gradient(df).select("row_id", F.round("g", 5).alias("g"), F.round("h", 5).alias("h"))


def _link_query(objective: str, classes: int = 1) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = F.col("p")
        out = O.link(Params(objective=objective, num_class=classes), F.array(p, p / 2, -p) if classes > 1 else p)
        cols = [F.round(out[k], 6).alias(f"q{k}") for k in range(3)] if objective == "multi:softprob" else [F.round(out, 6).alias("q")]
        return pairs(spark, d).select("row_id", *cols)

    return run


QUERIES |= {"link_sigmoid": _link_query("binary:logistic"), "link_exp": _link_query("count:poisson"), "link_hinge": _link_query("binary:hinge"), "link_softmax": _link_query("multi:softprob", 3), "link_class": _link_query("multi:softmax", 3)}
SQL |= {
    "link_sigmoid": f"WITH {PAIRS_SQL} SELECT row_id, round({_S}, 6) AS q FROM d", "link_exp": f"WITH {PAIRS_SQL} SELECT row_id, round(exp(p), 6) AS q FROM d",
    "link_hinge": f"WITH {PAIRS_SQL} SELECT row_id, CAST(p > 0 AS DOUBLE) AS q FROM d", "link_softmax": f"WITH {PAIRS_SQL}, q AS ({_SOFT}) SELECT row_id, round(q0, 6) AS q0, round(q1, 6) AS q1, round(q2, 6) AS q2 FROM q",
    "link_class": f"WITH {PAIRS_SQL} SELECT row_id, CASE WHEN p >= 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS q FROM d",
}


# ---- histograms and splits ----


def level_rows(spark: SparkSession, d: str, level: int = 0) -> tuple[DataFrame, list[np.ndarray]]:
    df, cuts = binned(spark, d)
    node = F.lit(0) if level == 0 else F.when(F.col("f0") < 25, 1).otherwise(2)
    return df.select(node.alias("node"), (F.lit(BASE) - F.col("label")).alias("g"), F.lit(1.0).alias("h"), F.lit(1.0).alias("n"), "bins"), cuts


def _hist(spark: SparkSession, d: str, level: int = 0, strategy: str = "arrow") -> DataFrame:
    df, cuts = level_rows(spark, d, level)
    return spark_grow.histogram(df, 4, max(map(len, cuts)), strategy)


def _hist_sql(level: int) -> str:
    node = "0" if level == 0 else "CASE WHEN f0 < 25 THEN 1 ELSE 2 END"
    u = " UNION ALL ".join(f"SELECT node, {f} AS feature, b{f} AS bin, g FROM n" for f in range(4))
    return f"{BINS_SQL}, n AS (SELECT {node} AS node, {BASE:.1f}::DOUBLE - label AS g, b0, b1, b2, b3 FROM b), hu AS ({u}), h AS (SELECT node, feature, CAST(bin AS INTEGER) AS bin, sum(g) AS g, CAST(count(*) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM hu GROUP BY ALL)"


QUERIES |= {"root_histogram": lambda s, d: _hist(s, d), "level_histogram": lambda s, d: _hist(s, d, 1), "level_histogram_catalyst": lambda s, d: _hist(s, d, 1, "catalyst").withColumn("node", F.col("node").cast("int"))}
SQL |= {"root_histogram": f"WITH {_hist_sql(0)} SELECT * FROM h", "level_histogram": f"WITH {_hist_sql(1)} SELECT * FROM h", "level_histogram_catalyst": f"WITH {_hist_sql(1)} SELECT * FROM h"}


def _part_sql(g: str, h: str, lam: float, alpha: float) -> str:
    t = f"(sign({g}) * greatest(abs({g}) - {alpha}, 0))" if alpha else f"({g})"
    return f"({t} * {t} / (({h}) + {lam}))"


def _scan_sql(level: int, lam: float = 1.0, alpha: float = 0.0, mcw: float = 1.0, more: str = "", features: str = "") -> str:
    gain = f"{_part_sql('gl', 'hl', lam, alpha)} + {_part_sql('gp - gl', 'hp - hl', lam, alpha)} - {_part_sql('gp', 'hp', lam, alpha)}"
    return f"""{_hist_sql(level)}, t AS (SELECT node, feature, sum(g) AS gp, sum(h) AS hp, coalesce(sum(g) FILTER (WHERE bin < 0), 0) AS gm, coalesce(sum(h) FILTER (WHERE bin < 0), 0) AS hm FROM h GROUP BY node, feature),
    pre AS (SELECT node, feature, bin, sum(g) OVER w AS g0, sum(h) OVER w AS h0 FROM h WHERE bin >= 0 WINDOW w AS (PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    sides AS (SELECT node, feature, bin, dl AS default_left, CASE WHEN dl THEN g0 + gm ELSE g0 END AS gl, CASE WHEN dl THEN h0 + hm ELSE h0 END AS hl, gp, hp FROM pre JOIN t USING (node, feature), (VALUES (true), (false)) AS s(dl)),
    cand AS (SELECT *, {gain} AS gain FROM sides WHERE hl >= {mcw} AND hp - hl >= {mcw} {more}), ok AS (SELECT * FROM cand WHERE gain > 0 {features}),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin, default_left DESC) AS i FROM ok) WHERE i = 1)"""


_CAND = "SELECT node, feature, bin, default_left, gl, hl, round(gain / 1e9, 2) AS gain FROM {}"


def _cand(df: DataFrame) -> DataFrame:
    return df.select("node", "feature", "bin", "default_left", "gl", "hl", F.round(F.col("gain") / 1e9, 2).alias("gain"))


def _candidates(level: int, **p) -> Query:
    return lambda s, d: _cand(spark_grow.split_candidates(_hist(s, d, level), params(**p)))


def _best(level: int, allowed: dict | None = None, **p) -> Query:
    return lambda s, d: _cand(spark_grow.best_splits(_hist(s, d, level), params(**p), allowed))


QUERIES |= {
    "split_gain": _candidates(0), "split_l1": _candidates(0, alpha=1e6), "missing_direction": lambda s, d: _cand(spark_grow.split_candidates(_hist(s, d), params()).where("feature = 2")), "min_child_weight": _candidates(1, min_child_weight=5000.0),
    "best_split_per_node": _best(1), "split_monotone": _best(1, monotone={0: -1}), "split_interaction": _best(1, {1: [1, 2], 2: [3]}, interactions=((1, 2), (3,))),
}
SQL |= {
    "split_gain": f"WITH {_scan_sql(0)} {_CAND.format('ok')}", "split_l1": f"WITH {_scan_sql(0, alpha=1e6)} {_CAND.format('ok')}", "missing_direction": f"WITH {_scan_sql(0)} {_CAND.format('ok')} WHERE feature = 2",
    "min_child_weight": f"WITH {_scan_sql(1, mcw=5000.0)} {_CAND.format('ok')}", "best_split_per_node": f"WITH {_scan_sql(1)} {_CAND.format('best')}",
    "split_monotone": f"WITH {_scan_sql(1, more='AND (feature <> 0 OR -1 * (gl * (hp - hl + 1) - (gp - gl) * (hl + 1)) >= 0)')} {_CAND.format('best')}",
    "split_interaction": f"WITH {_scan_sql(1, features='AND (node = 1 AND feature IN (1, 2) OR node = 2 AND feature = 3)')} {_CAND.format('best')}",
}


@query("prefix_scan", f"WITH {_scan_sql(1)} SELECT node, feature, bin, g0 AS gl, h0 AS hl FROM pre WHERE feature <> 2")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return _hist(spark, d, 1).where("feature <> 2").select("node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"))


@query("split_exact_midpoint", f"""WITH {ROWS_SQL}, v AS (SELECT f0 AS value, sum({BASE:.1f}::DOUBLE - label) AS g, CAST(count(*) AS DOUBLE) AS h FROM r GROUP BY f0),
    p AS (SELECT value, lead(value) OVER (ORDER BY value) AS nxt, sum(g) OVER (ORDER BY value) AS gl, sum(h) OVER (ORDER BY value) AS hl, sum(g) OVER () AS gp, sum(h) OVER () AS hp FROM v)
    SELECT (value + nxt) / 2 AS threshold, gl, hl, round((gl * gl / (hl + 1) + (gp - gl) * (gp - gl) / (hp - hl + 1) - gp * gp / (hp + 1)) / 1e9, 2) AS gain FROM p WHERE nxt IS NOT NULL""")
def split_exact_midpoint(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    v = rows(spark, d).groupBy(F.col("f0").alias("value")).agg(F.sum(F.lit(BASE) - F.col("label")).alias("g"), F.count(F.lit(1)).cast("double").alias("h"))
    order = Window.partitionBy(F.lit(0)).orderBy("value")  # distinct values only
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(0))
    p = v.select("value", F.lead("value").over(order).alias("nxt"), F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(whole).alias("gp"), F.sum("h").over(whole).alias("hp")).where("nxt is not null")
    gain = E.gain(F.col("gl"), F.col("hl"), F.col("gp") - F.col("gl"), F.col("hp") - F.col("hl"), F.col("gp"), F.col("hp"))
    return p.select(((F.col("value") + F.col("nxt")) / 2).alias("threshold"), "gl", "hl", F.round(gain / 1e9, 2).alias("gain"))


@query("split_categorical_ratio", f"""WITH {ROWS_SQL}, v AS (SELECT f3 AS value, sum({BASE:.1f}::DOUBLE - label) AS g, CAST(count(*) AS DOUBLE) AS h FROM r GROUP BY f3)
    SELECT value, row_number() OVER w AS place, sum(g) OVER w AS gl, sum(h) OVER w AS hl FROM v WINDOW w AS (ORDER BY g / (h + 1e-10), value)""")
def split_categorical_ratio(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    v = rows(spark, d).groupBy(F.col("f3").alias("value")).agg(F.sum(F.lit(BASE) - F.col("label")).alias("g"), F.count(F.lit(1)).cast("double").alias("h"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("g") / (F.col("h") + 1e-10), "value")  # categories only
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return v.select("value", F.row_number().over(order).cast("long").alias("place"), F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"))


_LEAF = f"{ROWS_SQL}, t AS (SELECT f3, sum({BASE:.1f}::DOUBLE - label) AS g, CAST(count(*) AS DOUBLE) AS h FROM r GROUP BY f3)"


def _leaf(**p) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = rows(spark, d).groupBy("f3").agg(F.sum(F.lit(BASE) - F.col("label")).alias("g"), F.count(F.lit(1)).cast("double").alias("h"))
        return t.select("f3", F.round(E.leaf_weight(F.col("g"), F.col("h"), **p), 4).alias("leaf"))

    return run


QUERIES |= {"leaf_weight": _leaf(lambda_=1.0), "leaf_weight_l1": _leaf(lambda_=1.0, alpha=5e6), "leaf_clipped": _leaf(lambda_=1.0, max_delta_step=2000.0)}
SQL |= {
    "leaf_weight": f"WITH {_LEAF} SELECT f3, round(-g / (h + 1), 4) AS leaf FROM t", "leaf_clipped": f"WITH {_LEAF} SELECT f3, round(greatest(least(-g / (h + 1), 2000), -2000), 4) AS leaf FROM t",
    "leaf_weight_l1": f"WITH {_LEAF} SELECT f3, round(sign(-g / (h + 1)) * greatest(abs(-g / (h + 1)) - 5e6 / (h + 1), 0), 4) AS leaf FROM t",
}


# ---- growth ----


def _frame(spark: SparkSession, d: str) -> Frame:
    return Frame(rows(spark, d).withColumn("row_id", F.xxhash64(*KEY, "label")), FEATURES)


def grown(spark: SparkSession, d: str, depth: int) -> tuple[DataFrame, Tree]:
    """Rows with the leaf value of one tree on fixed gradients."""
    df, cuts = binned(spark, d)
    work = df.select(*KEY, "label", (F.lit(BASE) - F.col("label")).alias("g"), F.lit(1.0).alias("h"), F.lit(1.0).alias("n"), "bins")
    tree, leaf = spark_grow.grow(work, 4, cuts, params(max_depth=depth), [0, 1, 2, 3])
    values = F.array(*[F.lit(float(n.value)) for n in tree.nodes])
    return leaf.withColumn("leaf", F.element_at(values, F.col("node") + 1)), tree


_ROOT = _scan_sql(0).replace("best AS", "root AS")
_SIDE = "CASE WHEN (CASE feature WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END) < 0 THEN default_left ELSE (CASE feature WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END) <= bin END"


@query("tree_depth1_score", f"WITH {_ROOT}, a AS (SELECT b.*, {_SIDE} AS go_left, gl, hl, gp, hp FROM b, root) SELECT k1, k2, k3, k4, label, round(CASE WHEN go_left THEN -gl / (hl + 1) ELSE -(gp - gl) / (hp - hl + 1) END, 4) AS leaf FROM a")
def tree_depth1_score(spark: SparkSession, d: str) -> DataFrame:
    return grown(spark, d, 1)[0].select(*KEY, "label", F.round("leaf", 4).alias("leaf"))


def _second(node: str) -> str:
    """Splits of the two children as CTEs over rows with a node column."""
    u = " UNION ALL ".join(f"SELECT node, {f} AS feature, b{f} AS bin, g FROM n2" for f in range(4))
    gain = f"{_part_sql('gl', 'hl', 1.0, 0.0)} + {_part_sql('gp - gl', 'hp - hl', 1.0, 0.0)} - {_part_sql('gp', 'hp', 1.0, 0.0)}"
    return f"""n2 AS (SELECT b.*, CASE WHEN {_SIDE} THEN 1 ELSE 2 END AS node, {BASE:.1f}::DOUBLE - label AS g FROM b, root),
    h2 AS (SELECT node, feature, bin, sum(g) AS g, CAST(count(*) AS DOUBLE) AS h FROM ({u}) GROUP BY ALL),
    t2 AS (SELECT node, feature, sum(g) AS gp, sum(h) AS hp, coalesce(sum(g) FILTER (WHERE bin < 0), 0) AS gm, coalesce(sum(h) FILTER (WHERE bin < 0), 0) AS hm FROM h2 GROUP BY node, feature),
    pre2 AS (SELECT node, feature, bin, sum(g) OVER w AS g0, sum(h) OVER w AS h0 FROM h2 WHERE bin >= 0 WINDOW w AS (PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    both2 AS (SELECT node, feature, bin, dl AS default_left, CASE WHEN dl THEN g0 + gm ELSE g0 END AS gl, CASE WHEN dl THEN h0 + hm ELSE h0 END AS hl, gp, hp FROM pre2 JOIN t2 USING (node, feature), (VALUES (true), (false)) AS s(dl)),
    cand2 AS (SELECT *, {gain} AS gain FROM both2 WHERE hl >= 1 AND hp - hl >= 1),
    best2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin, default_left DESC) AS i FROM cand2 WHERE gain > 0) WHERE i = 1)"""


@query("tree_depth2_score", f"WITH {_ROOT}, {_second('')}, a AS (SELECT n2.*, {_SIDE} AS go_left, gl, hl, gp, hp FROM n2 JOIN best2 USING (node)) SELECT k1, k2, k3, k4, label, round(CASE WHEN go_left THEN -gl / (hl + 1) ELSE -(gp - gl) / (hp - hl + 1) END, 4) AS leaf FROM a")
def tree_depth2_score(spark: SparkSession, d: str) -> DataFrame:
    return grown(spark, d, 2)[0].select(*KEY, "label", F.round("leaf", 4).alias("leaf"))


def boosted(spark: SparkSession, d: str, strategy: str = "spark", **p) -> tuple[Booster, Frame]:
    frame = _frame(spark, d)
    c = params(**({"num_trees": 3, "max_depth": 3} | p))
    return Booster.fit(frame, c, metrics=("rmse",), strategy=strategy), frame


def _history(model: Booster, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h["iteration"], k, round(float(v), 4)) for h in model.history for k, v in h.items() if k != "iteration"], "iteration int, metric string, value double")


def _fit_query(strategy: str = "local", **p) -> Query:
    return lambda s, d: _history(boosted(s, d, strategy, **p)[0], s)


QUERIES |= {
    "boost_fit": _fit_query("spark"), "boost_fit_catalyst": _fit_query("catalyst"), "boost_fit_local": _fit_query(), "lossguide_fit": _fit_query(max_leaves=12, max_depth=0), "exact_fit": _fit_query(tree_method="exact"),
    "dart_fit": _fit_query(booster="dart", rate_drop=0.5, one_drop=True, num_trees=6), "forest_fit": _fit_query(num_parallel_tree=4, num_trees=2), "categorical_fit": _fit_query(categorical=(3,)),
    "sampled_fit": _fit_query(subsample=0.5, colsample_bytree=0.75, colsample_bynode=0.75), "gradient_sampling_fit": _fit_query(subsample=0.3, sampling_method="gradient_based"), "refresh_leaf_fit": _fit_query(subsample=0.3, refresh_leaf=True),
}


@query("continue_fit")
def continue_fit(spark: SparkSession, d: str) -> DataFrame:
    model, frame = boosted(spark, d, "local", num_trees=2)
    return _history(model.continue_fit(frame, 2, metrics=("rmse",), strategy="local"), spark)


@query("early_stop_fit")
def early_stop_fit(spark: SparkSession, d: str) -> DataFrame:
    frame = _frame(spark, d)
    train, valid = (Frame(frame.df.where(F.pmod("row_id", F.lit(5)) == 0 if v else F.pmod("row_id", F.lit(5)) != 0), FEATURES) for v in (False, True))
    return _history(Booster.fit(train, params(num_trees=8, max_depth=2, eta=1.0, early_stopping_rounds=2), valid, ("rmse",), "local"), spark)


@query("multiclass_fit")
def multiclass_fit(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    size = t.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    names = tuple(f"e{i}" for i in range(size))
    df = t.select(F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    model = Booster.fit(Frame(df, names), params(objective="multi:softprob", num_class=10, num_trees=2, max_depth=2), metrics=("mlogloss", "merror"), strategy="local")
    return _history(model, spark)


@query("ranking_fit")
def ranking_fit(spark: SparkSession, d: str) -> DataFrame:
    df = ranked(spark, d).withColumns({"x0": F.col("margin"), "x1": F.pmod("row_id", F.lit(24)).cast("double")})
    return _history(Booster.fit(Frame(df.drop("margin"), ("x0", "x1"), group="group_id"), params(objective="rank:ndcg", num_trees=2, max_depth=2), metrics=("ndcg@5",), strategy="local"), spark)


@query("multi_output_fit")
def multi_output_fit(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000).alias("x0"), F.dayofyear("o_orderdate").cast("double").alias("x1"), F.log("o_totalprice").alias("y0"), (F.col("o_custkey") % 7).cast("double").alias("y1"))
    model = multi.MultiOutput.fit(Frame(t, ("x0", "x1"), "y0"), ("y0", "y1"), params(num_trees=3, max_depth=3))
    return model.predict(t).select("row_id", F.round(F.col("prediction")[0], 4).alias("p0"), F.round(F.col("prediction")[1], 4).alias("p1"))


# ---- linear booster ----

_LX = "coalesce(f0, 0) AS x0, coalesce(f1, 0) AS x1, coalesce(f2, 0) AS x2, coalesce(f3, 0) AS x3"


@query("linear_grad_sums", f"WITH {ROWS_SQL}, l AS (SELECT {BASE:.1f}::DOUBLE - label AS g, {_LX} FROM r) SELECT sum(g) AS bias_g, CAST(count(*) AS DOUBLE) AS bias_h, sum(g * x0) AS g0, sum(x0 * x0) AS h0, sum(g * x3) AS g3, sum(x3 * x3) AS h3 FROM l")
def linear_grad_sums(spark: SparkSession, d: str) -> DataFrame:
    return linear.LinearBooster.sums(rows(spark, d), FEATURES, F.lit(BASE) - F.col("label"), F.lit(1.0)).select("bias_g", "bias_h", "g0", "h0", "g3", "h3")


@query("linear_round", f"WITH {ROWS_SQL}, l AS (SELECT {BASE:.1f}::DOUBLE - label AS g, {_LX} FROM r) SELECT round(-0.3 * sum(g * x0) / (sum(x0 * x0) + 1), 4) AS w0, round(-0.3 * sum(g * x3) / (sum(x3 * x3) + 1), 4) AS w3, round({BASE:.1f}::DOUBLE - 0.3 * sum(g) / count(*), 4) AS bias FROM l")
def linear_round(spark: SparkSession, d: str) -> DataFrame:
    start = linear.LinearBooster(params(booster="gblinear"), FEATURES, np.zeros(4), BASE)
    s = linear.LinearBooster.sums(rows(spark, d), FEATURES, start.margin() - F.col("label"), F.lit(1.0)).first().asDict()
    m = start.round(s)
    return spark.createDataFrame([(round(float(m.weights[0]), 4), round(float(m.weights[3]), 4), round(float(m.bias), 4))], "w0 double, w3 double, bias double")


@query("linear_fit")
def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    m = linear.LinearBooster.fit(_frame(spark, d), params(booster="gblinear", num_trees=5, eta=0.1))
    return spark.createDataFrame([(f, round(float(w), 3)) for f, w in zip((*FEATURES, "bias"), (*m.weights, m.bias), strict=True)], "feature string, weight double")


# ---- metrics ----

_Q = f"CASE WHEN p >= 0 THEN 1 / (1 + exp(-p)) ELSE exp(p) / (1 + exp(p)) END"
_STIRLING = "((y + 9 - 0.5) * ln(y + 9) - (y + 9) + 0.9189385332046727 + 1 / (12 * (y + 9)) - 1 / (360 * pow(y + 9, 3)) + 1 / (1260 * pow(y + 9, 5)) - ln((y + 1) * (y + 2)) - ln((y + 3) * (y + 4)) - ln((y + 5) * (y + 6)) - ln((y + 7) * (y + 8)))"
#: metric -> (prediction, label, SQL value over q and the label)
ROW_METRICS: dict[str, tuple[str, str, str]] = {
    "rmse": ("p", "y", "sqrt(avg((q - y) * (q - y)))"), "mae": ("p", "y", "avg(abs(q - y))"), "rmsle": ("e", "y", "sqrt(avg(pow(ln(1 + q) - ln(1 + y), 2)))"), "mape": ("p", "y", "100 * avg(abs(q - y) / greatest(abs(y), 1e-15))"),
    "mphe": ("p", "y", "avg(sqrt(1 + (q - y) * (q - y)) - 1)"), "logloss": ("s", "b", "avg(-(b * ln(greatest(least(q, 1 - 1e-15), 1e-15)) + (1 - b) * ln(1 - greatest(least(q, 1 - 1e-15), 1e-15))))"),
    "error": ("s", "b", "avg(CASE WHEN (q >= 0.5) = (b > 0.5) THEN 0 ELSE 1 END)"), "error@0.3": ("s", "b", "avg(CASE WHEN (q >= 0.3) = (b > 0.5) THEN 0 ELSE 1 END)"),
    "poisson-nloglik": ("e", "y", f"avg(q - y * ln(q) + {_STIRLING})"), "gamma-nloglik": ("e", "y", "avg(ln(q) + y / q)"), "gamma-deviance": ("e", "y", "avg(2 * (ln(q / greatest(y, 1e-15)) + (y - q) / q))"),
    "tweedie-nloglik": ("e", "y", "avg(y * pow(q, -0.5) / 0.5 + pow(q, 0.5) / 0.5)"),
}
_PRED = {"p": (lambda: F.col("p"), "p"), "e": (lambda: F.exp("p"), "exp(p)"), "s": (lambda: E.sigmoid(F.col("p")), _Q)}


def _metric_query(name: str) -> Query:
    pred, label, _ = ROW_METRICS[name]
    return lambda s, d: pairs(s, d).agg(F.round(M.row_metric(name, _PRED[pred][0](), F.col(label)), 6).alias("value"))


for _m, (_pr, _lab, _sql) in ROW_METRICS.items():
    _n = "metric_" + _m.replace("-", "_").replace("@", "_at_").replace(".", "_")
    QUERIES[_n] = _metric_query(_m)
    SQL[_n] = f"WITH {PAIRS_SQL}, z AS (SELECT *, {_PRED[_pr][1]} AS q FROM d) SELECT round({_sql}, 6) AS value FROM z"


def _class_metric(name: str) -> Query:
    soft = lambda: E.softmax(F.array(F.col("p"), F.col("p") / 2, -F.col("p")))
    return lambda s, d: pairs(s, d).agg(F.round(M.row_metric(name, soft(), F.col("row_id") % 3), 6).alias("value"))


QUERIES |= {"metric_merror": _class_metric("merror"), "metric_mlogloss": _class_metric("mlogloss")}
SQL |= {
    "metric_merror": f"WITH {PAIRS_SQL}, q AS ({_SOFT}) SELECT round(avg(CASE WHEN (CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END) = y THEN 0 ELSE 1 END), 6) AS value FROM q",
    "metric_mlogloss": f"WITH {PAIRS_SQL}, q AS ({_SOFT}) SELECT round(avg(-ln(CASE y WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END)), 6) AS value FROM q",
}


@query("metric_auc", f"""WITH {PAIRS_SQL}, s AS (SELECT p, sum(b) AS pos, count(*) - sum(b) AS neg FROM d GROUP BY p), c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
    SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS value FROM c""")
def metric_auc(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(pairs(spark, d), "p", "b").select(F.round("auc", 6).alias("value"))


@query("metric_aucpr", f"""WITH {PAIRS_SQL}, s AS (SELECT b, row_number() OVER w AS r, sum(b) OVER w AS hits FROM d WINDOW w AS (ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT min(hits / r) OVER (ORDER BY r) AS pre FROM s WHERE b = 1) SELECT round(avg(pre), 6) AS value FROM c""")
def metric_aucpr(spark: SparkSession, d: str) -> DataFrame:
    return M.aucpr(pairs(spark, d), "p", "b").select(F.round("aucpr", 6).alias("value"))


_RM = """WITH {e}, k AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY margin DESC, row_id) AS r, row_number() OVER (PARTITION BY {g} ORDER BY label DESC, row_id) AS best, pow(2, label) - 1 AS gain, CAST(label > 0 AS DOUBLE) AS hit,
    sum(CAST(label > 0 AS DOUBLE)) OVER (PARTITION BY {g} ORDER BY margin DESC, row_id ROWS UNBOUNDED PRECEDING) AS hits FROM e), v AS (SELECT {value} AS v FROM k GROUP BY {g}) SELECT round(avg(v), 6) AS value FROM v"""
_RV = {
    "ndcg@10": "CASE WHEN sum(CASE WHEN best <= 10 THEN gain / log2(best + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN r <= 10 THEN gain / log2(r + 1) ELSE 0 END) / sum(CASE WHEN best <= 10 THEN gain / log2(best + 1) ELSE 0 END) ELSE 1 END",
    "map@10": "CASE WHEN sum(hit) > 0 THEN sum(CASE WHEN r <= 10 THEN hit * hits / r ELSE 0 END) / least(sum(hit), 10) ELSE 0 END", "pre@10": "sum(CASE WHEN r <= 10 THEN hit ELSE 0 END) / least(count(*), 10)",
}


def _rank_metric(name: str, group: str | None) -> Query:
    return lambda s, d: M.ranking(ranked(s, d), name, group, "margin", "label").select(F.round(name.split("@")[0], 6).alias("value"))


for _m, _v in _RV.items():
    for _grp in (None, "group_id"):
        _n = f"metric_{_m.replace('@', '_at_')}" + ("_by_group" if _grp else "")
        QUERIES[_n] = _rank_metric(_m, _grp)
        SQL[_n] = _RM.format(e=RANKED_SQL, g=_grp or "true", value=_v)


@query("metric_cox_nloglik", f"""WITH {PAIRS_SQL}, s AS (SELECT p, round(y + 1, 1) AS t, row_id % 3 <> 0 AS event FROM d), t AS (SELECT t, sum(exp(p)) AS e, sum(CAST(event AS DOUBLE)) AS n, sum(CASE WHEN event THEN p ELSE 0 END) AS m, count(*) AS c FROM s GROUP BY t),
    k AS (SELECT *, sum(e) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS risk FROM t) SELECT round(sum(n * ln(risk) - m) / sum(c), 6) AS value FROM k""")
def metric_cox_nloglik(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d).select("p", F.when(F.col("row_id") % 3 != 0, F.round(F.col("y") + 1, 1)).otherwise(-F.round(F.col("y") + 1, 1)).alias("label"))
    return M.cox_nloglik(df, "p", "label").select(F.round("cox_nloglik", 6).alias("value"))


# ---- scoring and explanation, on a fixed hand-made model ----


def hand_model() -> Booster:
    one = Tree([Node(0, 0, 25.0, None, 1, 2, True, gain=9.0, h=100.0), Node(1, value=0.8, h=40.0), Node(1, 2, 0.03, None, 3, 4, False, gain=4.0, h=60.0), Node(2, value=-0.3, h=20.0), Node(2, value=0.2, h=40.0)])
    two = Tree([Node(0, 1, 0.05, None, 1, 2, True, gain=5.0, h=100.0), Node(1, value=-0.5, h=50.0), Node(1, value=0.4, h=50.0)])
    return Booster(params(objective="binary:logistic", eta=0.5), FEATURES, [one, two], 0.1)


_T1 = "CASE WHEN f0 < 25 THEN {a} ELSE CASE WHEN f2 IS NULL THEN {c} WHEN f2 < 0.03 THEN {b} ELSE {c} END END"
_T2 = "CASE WHEN f1 < 0.05 THEN {a} ELSE {b} END"
_MARGIN = f"(0.1 + 0.5 * ({_T1.format(a='0.8', b='-0.3', c='0.2')}) + 0.5 * ({_T2.format(a='-0.5', b='0.4')}))"
_ID = "k1, k2, k3, k4, label"


@query("predict_margin", f"WITH {ROWS_SQL} SELECT {_ID}, round(CAST({_MARGIN} AS DOUBLE), 6) AS margin FROM r")
def predict_margin(spark: SparkSession, d: str) -> DataFrame:
    return hand_model().predict(rows(spark, d), margin=True).select(*KEY, "label", F.round("prediction", 6).alias("margin"))


@query("predict_proba", f"WITH {ROWS_SQL} SELECT {_ID}, round(1 / (1 + exp(-CAST({_MARGIN} AS DOUBLE))), 6) AS probability FROM r")
def predict_proba(spark: SparkSession, d: str) -> DataFrame:
    return hand_model().predict(rows(spark, d)).select(*KEY, "label", F.round("prediction", 6).alias("probability"))


@query("leaf_index", f"WITH {ROWS_SQL} SELECT {_ID}, {_T1.format(a=1, b=3, c=4)} AS leaf0, {_T2.format(a=1, b=2)} AS leaf1 FROM r")
def leaf_index(spark: SparkSession, d: str) -> DataFrame:
    return hand_model().leaf_index(rows(spark, d)).select(*KEY, "label", F.col("leaves")[0].alias("leaf0"), F.col("leaves")[1].alias("leaf1"))


@query("iteration_range", f"WITH {ROWS_SQL} SELECT {_ID}, round(CAST(0.1 + 0.5 * ({_T2.format(a='-0.5', b='0.4')}) AS DOUBLE), 6) AS margin FROM r")
def iteration_range(spark: SparkSession, d: str) -> DataFrame:
    return hand_model().slice(1, 2).predict(rows(spark, d), margin=True).select(*KEY, "label", F.round("prediction", 6).alias("margin"))


_NODES = "(VALUES (0, 9.0, 100.0), (2, 4.0, 60.0), (1, 5.0, 100.0)) AS n(feature, gain, cover)"
for _k, _v in (("weight", "CAST(count(*) AS DOUBLE)"), ("gain", "CAST(sum(gain) AS DOUBLE)"), ("cover", "CAST(sum(cover) AS DOUBLE)")):
    QUERIES[f"importance_{_k}"] = lambda s, d, k=_k: explain.importance(hand_model(), s, k).select("feature", "score")
    SQL[f"importance_{_k}"] = f"SELECT feature, {_v} AS score FROM {_NODES} GROUP BY feature"


@query("importance_ranking", f"SELECT feature, CAST(gain AS DOUBLE) AS score, row_number() OVER (ORDER BY gain DESC, feature) AS rank FROM {_NODES}")
def importance_ranking(spark: SparkSession, d: str) -> DataFrame:
    return explain.importance_ranking(hand_model(), spark).select("feature", "score", F.col("rank").cast("long").alias("rank"))


@query("leaf_magnitude", "SELECT * FROM (VALUES (0, CAST(1.3 AS DOUBLE)), (1, CAST(0.9 AS DOUBLE))) AS t(tree_id, magnitude)")
def leaf_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return explain.leaf_magnitude(hand_model(), spark).select("tree_id", F.round("magnitude", 6).alias("magnitude"))


@query("pdp_curve", f"""WITH {ROWS_SQL}, g AS (SELECT lo + i * (hi - lo) / 4 AS f0 FROM (SELECT min(f0) AS lo, max(f0) AS hi FROM r), (SELECT unnest(range(0, 5)) AS i)),
    x AS (SELECT g.f0, f1, f2 FROM g, r), s AS (SELECT f0, 1 / (1 + exp(-CAST({_MARGIN} AS DOUBLE))) AS p FROM x)
    SELECT f0 AS value, round(avg(p), 6) AS mean, round(avg(p) - 1.96 * stddev_pop(p) / sqrt(count(*)), 6) AS low, round(avg(p) + 1.96 * stddev_pop(p) / sqrt(count(*)), 6) AS high, count(*) AS n FROM s GROUP BY f0""")
def pdp_curve(spark: SparkSession, d: str) -> DataFrame:
    out = explain.partial_dependence(hand_model(), rows(spark, d), "f0", 5)
    return out.select("value", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "n")


# Expectations of the first tree: node 2 = (20 * -0.3 + 40 * 0.2) / 60 = 1 / 30, root = (40 * 0.8 + 60 / 30) / 100 = 0.34.
@query("approx_attribution", f"""WITH {ROWS_SQL} SELECT {_ID}, round(CAST(0.5 * CASE WHEN f0 < 25 THEN 0.46 ELSE CAST(1 AS DOUBLE) / 30 - 0.34 END AS DOUBLE), 6) AS a0, round(CAST(0.5 * CASE WHEN f1 < 0.05 THEN -0.45 ELSE 0.45 END AS DOUBLE), 6) AS a1,
    round(0.5 * CASE WHEN f0 < 25 THEN CAST(0 AS DOUBLE) WHEN f2 < 0.03 THEN -0.3 - CAST(1 AS DOUBLE) / 30 ELSE 0.2 - CAST(1 AS DOUBLE) / 30 END, 6) AS a2, round(CAST(0.1 + 0.17 - 0.025 AS DOUBLE), 6) AS bias FROM r""")
def approx_attribution(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("attribution")
    out = explain.with_attribution(hand_model(), rows(spark, d), "approximate")
    return out.select(*KEY, "label", *[F.round(a[i], 6).alias(n) for i, n in ((0, "a0"), (1, "a1"), (2, "a2"), (4, "bias"))])


# Shapley by hand for two features: f0 alone, f2 alone and both, with cover shares 0.4 / 0.6 and 1 / 3, 2 / 3.
_V02 = _T1.format(a="0.8", b="-0.3", c="0.2")
_V0 = "CASE WHEN f0 < 25 THEN 0.8 ELSE CAST(1 AS DOUBLE) / 30 END"
_V2 = "(0.4 * 0.8 + 0.6 * CASE WHEN f2 < 0.03 THEN -0.3 ELSE 0.2 END)"


@query("attribution", f"""WITH {ROWS_SQL} SELECT {_ID}, round(CAST(0.5 * (({_V0}) - 0.34 + ({_V02}) - {_V2}) / 2 AS DOUBLE), 6) AS a0, round(CAST(0.5 * CASE WHEN f1 < 0.05 THEN -0.45 ELSE 0.45 END AS DOUBLE), 6) AS a1,
    round(CAST(0.5 * ({_V2} - 0.34 + ({_V02}) - ({_V0})) / 2 AS DOUBLE), 6) AS a2, round(CAST(0.1 + 0.17 - 0.025 AS DOUBLE), 6) AS bias FROM r""")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("attribution")
    out = explain.with_attribution(hand_model(), rows(spark, d), "exact")
    return out.select(*KEY, "label", *[F.round(a[i], 6).alias(n) for i, n in ((0, "a0"), (1, "a1"), (2, "a2"), (4, "bias"))])


@query("interaction", f"WITH {ROWS_SQL} SELECT {_ID}, round(CAST(0.5 * (({_V02}) - ({_V0}) - {_V2} + 0.34) / 2 AS DOUBLE), 6) AS i02, round(CAST(0.5 * CASE WHEN f1 < 0.05 THEN -0.45 ELSE 0.45 END AS DOUBLE), 6) AS i11 FROM r")
def interaction(spark: SparkSession, d: str) -> DataFrame:
    out = explain.with_attribution(hand_model(), rows(spark, d), "interaction")
    return out.select(*KEY, "label", F.round(F.col("attribution")[2], 6).alias("i02"), F.round(F.col("attribution")[6], 6).alias("i11"))


# ---- selection and sampling ----


def _fold_sql(keys: str) -> str:
    return f"""WITH {RANKED_SQL}, k AS (SELECT row_id, label, row_number() OVER ({keys} ORDER BY row_id) - 1 AS i, count(*) OVER ({keys}) AS n FROM e)
    SELECT row_id, CAST(CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1) ELSE (n % 3) + (i - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INTEGER) AS fold FROM k"""


@query("kfold_assign", _fold_sql(""))
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return sampling.folds(ranked(spark, d), 3).select("row_id", "fold")


@query("stratified_assign", _fold_sql("PARTITION BY label"))
def stratified_assign(spark: SparkSession, d: str) -> DataFrame:
    return sampling.folds(ranked(spark, d), 3, label="label").select("row_id", "fold")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for cross-validation results: squared error of a constant by fold."""
    each = sampling.folds(ranked(spark, d), 3).groupBy("fold").agg(F.avg(F.pow(F.col("margin") - F.col("label"), 2)).alias("value"))
    return each.select(F.lit(0).alias("combo"), F.lit("test").alias("split"), F.lit("mse").alias("metric"), "value")


@query("cv_summary", f"WITH f AS ({_fold_sql('')}), {RANKED_SQL}, v AS (SELECT fold, avg(pow(margin - label, 2)) AS value FROM e JOIN f USING (row_id) GROUP BY fold) SELECT 0 AS combo, 'test' AS split, 'mse' AS metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM v")
def cv_summary(spark: SparkSession, d: str) -> DataFrame:
    return select.summarize(_scores(spark, d)).select("combo", "split", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("cross_validate")
def cross_validate(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d).withColumnRenamed("y", "label").select("row_id", "label", "p", "w")
    out = select.cross_validate(Frame(df, ("p", "w")), [params(num_trees=2, max_depth=k) for k in (1, 2)], 3)
    return out.select("combo", "fold", "split", "metric", F.round("value", 5).alias("value"))


@query("grid_search")
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    df = pairs(spark, d).withColumnRenamed("y", "label").select("row_id", "label", "p", "w")
    found = select.grid_search(Frame(df, ("p", "w")), params(num_trees=2), {"max_depth": [1, 2], "eta": [0.1, 0.5]}, k=3)
    return spark.createDataFrame([(i, c["max_depth"], c["eta"], round(m, 5)) for i, (c, m, _) in enumerate(found)], "place int, max_depth int, eta double, mean double")


@query("grid_product", "SELECT CAST(row_number() OVER (ORDER BY d.i, e.i) - 1 AS INTEGER) AS combo, d.v AS max_depth, CAST(e.v AS DOUBLE) AS eta FROM (VALUES (0, 3), (1, 6)) AS d(i, v), (VALUES (0, 0.1), (1, 0.3), (2, 0.5)) AS e(i, v)")
def grid_product(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, c["max_depth"], c["eta"]) for i, c in enumerate(select.grid({"max_depth": [3, 6], "eta": [0.1, 0.3, 0.5]}))], "combo int, max_depth int, eta double")


_CURVE = "c AS (SELECT CAST(user_id AS INTEGER) AS iteration, round(avg(value), 9) AS value FROM events GROUP BY user_id)"


def _curve(spark: SparkSession, d: str) -> list[dict]:
    t = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("v")).orderBy("user_id")
    return [{"iteration": int(r["user_id"]), "valid-rmse": r["v"]} for r in t.collect()]


@query("best_iteration", f"WITH {_CURVE} SELECT iteration, value FROM c ORDER BY value, iteration LIMIT 1")
def best_iteration(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([explain.best_iteration(_curve(spark, d), "valid-rmse")], "iteration int, value double")


@query("learning_curve", f"WITH {_CURVE} SELECT iteration, 'valid-rmse' AS metric, value FROM c")
def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    return explain.learning_curve(_curve(spark, d), spark)


@query("early_stop_scan", f"WITH {_CURVE}, b AS (SELECT iteration, value, value = min(value) OVER (ORDER BY iteration) AND row_number() OVER (PARTITION BY value ORDER BY iteration) = 1 AS better FROM c), p AS (SELECT iteration, max(CASE WHEN better THEN iteration END) OVER (ORDER BY iteration) AS best FROM b) SELECT min(iteration) AS stop, arg_min(best, iteration) AS best FROM p WHERE iteration - best >= 5")
def early_stop_scan(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    h = explain.learning_curve(_curve(spark, d), spark)
    past = Window.partitionBy("metric").orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    better = F.coalesce(F.col("value") < F.min("value").over(past), F.lit(True))
    upto = Window.partitionBy("metric").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    best = h.withColumn("at", F.when(better, F.col("iteration"))).withColumn("best", F.max("at").over(upto))
    return best.where(F.col("iteration") - F.col("best") >= 5).agg(F.min("iteration").alias("stop"), F.min_by("best", "iteration").alias("best"))


@query("row_sample_hash")
def row_sample_hash(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_rows_by_hash(ranked(spark, d), 0.25, 7).select("row_id")


@query("bootstrap_multiplicity")
def bootstrap_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return sampling.with_multiplicity(ranked(spark, d), 7).groupBy("copies").agg(F.count(F.lit(1)).alias("n"))


@query("column_sample")
def column_sample(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, c) for k in range(5) for c in sampling.sample_columns(list(range(8)), 0.5, k)], "seed int, feature int")


@query("model_roundtrip", f"WITH {ROWS_SQL} SELECT {_ID}, round(CAST({_MARGIN} AS DOUBLE), 6) AS margin FROM r")
def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The hand-made model through the open document and binary JSON."""
    from ..sources import model_io

    model = model_io.from_document(model_io.ubjson_decode(model_io.ubjson_encode(model_io.to_document(hand_model()))))
    return model.predict(rows(spark, d), margin=True).select(*KEY, "label", F.round("prediction", 6).alias("margin"))


@query("model_dump")
def model_dump(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import model_io

    lines = model_io.dump_text(hand_model(), FEATURES).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


@query("flagship", f"WITH {_ROOT}, a AS (SELECT b.*, {_SIDE} AS go_left, gl, hl, gp, hp FROM b, root), z AS (SELECT label, {BASE:.1f}::DOUBLE + CASE WHEN go_left THEN -gl / (hl + 1) ELSE -(gp - gl) / (hp - hl + 1) END AS p FROM a) SELECT round(sqrt(avg((p - label) * (p - label))), 2) AS rmse, count(*) AS n FROM z")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Cuts, bins, histogram, best split, leaves, score and error in one go."""
    df, _ = grown(spark, d, 1)
    return df.select((F.lit(BASE) + F.col("leaf")).alias("p"), "label").agg(F.round(M.row_metric("rmse", F.col("p"), F.col("label")), 2).alias("rmse"), F.count(F.lit(1)).alias("n"))


from . import source_queries  # noqa: E402, F401 (registers more queries)
