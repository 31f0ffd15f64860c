"""Objectives, quantiles, growth, scoring and explanation by their definitions."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions import metrics as M
from thicket.functions import objectives as O
from thicket.operators import explain, linear, local, quantize, sampling, select
from thicket.operators.booster import Booster
from thicket.operators.frame import Frame, FrameError
from thicket.plans.params import OBJECTIVES, ParamError, Params, params
from thicket.sources import model_io, tabular


def data(n=300, m=4, seed=1, missing=0.1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, m))
    y = 2 * x[:, 0] - x[:, 1] + 0.5 * x[:, 2] + 0.1 * r.normal(size=n)
    x[r.random(x.shape) < missing] = np.nan
    return x, y


def frame_of(spark, x, y):
    return Frame(tabular.dense(spark, x.tolist(), y.tolist()), tuple(f"f{i}" for i in range(x.shape[1])))


@pytest.mark.parametrize("objective", [o for o in OBJECTIVES if not o.startswith(("multi", "rank", "survival:cox"))])
def test_columns_equal_numpy(spark, objective):
    p, y = np.linspace(-2, 2, 21), np.array([0.0, 1.0, 0.5, 2.0, 3.0, 1.0, 0.25] * 3)
    if objective.startswith("binary") or objective == "reg:logistic":
        y = (y > 0.6).astype(float)
    if objective == "survival:aft":
        y = np.where(np.arange(21) % 4 == 0, -y - 0.1, y + 0.1)
    c = params(objective=objective, scale_pos_weight=1.5, quantile_alpha=0.3, huber_slope=2.0)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, y))], "i int, p double, y double")
    g, h = O.gradient(c, F.col("p"), F.col("y"))
    got = np.array([[r["g"], r["h"]] for r in df.select("i", g.alias("g"), h.alias("h")).orderBy("i").collect()])
    want = np.stack(O.np_gradient(c, p, y), 1)
    assert np.allclose(got, want, atol=1e-5)


@pytest.mark.parametrize("objective", ["reg:squarederror", "binary:logistic", "count:poisson", "reg:gamma", "reg:tweedie", "survival:aft"])
def test_gradient_is_the_derivative_of_the_loss(objective):
    c = params(objective=objective)
    loss = {
        "reg:squarederror": lambda p, y: (p - y) ** 2 / 2, "binary:logistic": lambda p, y: np.log1p(np.exp(p)) - y * p, "count:poisson": lambda p, y: np.exp(p) - y * p,
        "reg:gamma": lambda p, y: p + y * np.exp(-p), "reg:tweedie": lambda p, y: -y * np.exp(-0.5 * p) / -0.5 + np.exp(0.5 * p) / 0.5, "survival:aft": lambda p, y: (np.log(y) - p) ** 2 / 2,
    }[objective]
    p, y, e = np.linspace(-1, 1, 9), np.array([1.0, 0, 1, 1, 0, 1, 0, 1, 1]) + (0 if objective == "binary:logistic" else 0.5), 1e-5
    g, h = O.np_gradient(c, p, y)
    assert np.allclose(g, (loss(p + e, y) - loss(p - e, y)) / (2 * e), atol=1e-6)
    assert np.allclose(h, (loss(p + e, y) - 2 * loss(p, y) + loss(p - e, y)) / e**2, atol=1e-3)


@pytest.mark.parametrize("objective", ["rank:pairwise", "rank:ndcg", "rank:map"])
def test_ranking_gradients(spark, objective):
    r = np.random.default_rng(3)
    m, y, g = r.normal(size=40), r.integers(0, 3, 40).astype(float), np.arange(40) % 4
    df = spark.createDataFrame([(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(g, m, y))], "row_id int, group_id int, margin double, label double")
    got = {x["row_id"]: (x["g"], x["h"]) for x in O.pair_gradient(df, objective).collect()}
    wg, wh = O.np_gradient(params(objective=objective), m, y, None, g)
    assert np.allclose([got.get(i, (0, 0)) for i in range(40)], np.stack((wg, wh), 1), atol=1e-9)
    assert abs(wg.sum()) < 1e-9


def test_map_weights_are_swap_differences():
    m, y = np.array([3.0, 2.0, 1.0, 0.0]), np.array([0.0, 1.0, 0.0, 1.0])

    def ap(order):
        hit = y[order] > 0
        return (hit * np.cumsum(hit) / np.arange(1, 5)).sum() / hit.sum()

    base, g = ap(np.arange(4)), np.zeros(4)
    for a, b in itertools.product(range(4), range(4)):
        if y[a] > y[b]:
            order = np.arange(4)
            order[[a, b]] = order[[b, a]]
            lam = abs(ap(order) - base) / (1 + math.exp(m[a] - m[b]))
            g[a] -= lam
            g[b] += lam
    assert np.allclose(O.np_gradient(params(objective="rank:map"), m, y, None, np.zeros(4))[0], g)


def test_prune_keeps_ranks():
    r = np.random.default_rng(0)
    v, w = np.sort(r.normal(size=5000)), r.random(5000)
    kept = quantize.prune(v, w, 65)
    assert kept[0] == 0 and kept[-1] == 4999 and len(kept) <= 65 and (np.diff(kept) > 0).all()
    assert np.diff(np.cumsum(w)[kept]).max() < 2.5 * w.sum() / 64
    assert quantize.cuts_of(np.array([1.0, 2.0, 3.0]), np.ones(3), 256)[:2].tolist() == [2.0, 3.0]


def test_sketch_merges():
    r = np.random.default_rng(0)
    x = r.normal(size=20000)
    a, b = quantize.QuantileSketch(256), quantize.QuantileSketch(256)
    for v in x[:9000]:
        a.push(float(v))
    for v in x[9000:]:
        b.push(float(v))
    a.merge(b)
    assert abs((x <= a.query(0.9)).mean() - 0.9) < 0.01 and a.total == 20000


def test_strategies_agree(spark):
    x, y = data()
    frame, c = frame_of(spark, x, y), params(num_trees=2, max_depth=3)
    models = [Booster.fit(frame, c, strategy=s) for s in ("local", "spark", "catalyst")]
    base = models[0].numpy_predict(x)
    for m in models[1:]:
        assert np.allclose(m.numpy_predict(x), base, atol=1e-9)
    again = Booster.fit(Frame(frame.df.repartition(7), frame.features), c, strategy="spark")
    assert np.allclose(again.numpy_predict(x), base, atol=1e-9)


@pytest.mark.parametrize("more", [{"subsample": 0.5}, {"num_parallel_tree": 3}, {"subsample": 0.7, "num_parallel_tree": 2}])
def test_strategies_draw_the_same_rows(spark, more):
    x, y = data()
    frame, c = frame_of(spark, x, y), params(num_trees=2, max_depth=3, **more)
    a, b = (Booster.fit(frame, c, strategy=s) for s in ("local", "spark"))
    assert np.allclose(a.numpy_predict(x), b.numpy_predict(x), atol=1e-9)


def test_numpy_and_spark_hash_alike(spark):
    ids = [0, 1, -5, 2**40, 123456789]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    want = df.select(sampling.row_key(F.col("row_id")).alias("k"), sampling.hashed_uniform(F.col("row_id"), 4_000_000_000).alias("u")).collect()
    key = sampling.hash_long(np.array(ids), np.uint64(42)).view(np.int64)
    assert key.tolist() == [r["k"] for r in want]
    assert sampling.uniforms(key, 4_000_000_000).tolist() == [r["u"] for r in want]


def test_leaf_wise_growth_agrees(spark):
    x, y = data()
    c = params(num_trees=2, max_leaves=20, max_depth=0)
    a, b = (Booster.fit(frame_of(spark, x, y), c, strategy=s) for s in ("local", "spark"))
    assert np.allclose(a.numpy_predict(x), b.numpy_predict(x), atol=1e-9)
    assert [sum(n.is_leaf for n in t.nodes) for t in b.trees] == [20, 20]


def test_forest_on_the_cluster(spark):
    x, y = data()
    frame, c = frame_of(spark, x, y), params(num_trees=6, num_parallel_tree=3, max_depth=4, eta=0.5)
    model = Booster.fit(frame, c, metrics=("rmse",), strategy="spark")
    assert len(model.trees) == 18 and model.history[-1]["train-rmse"] < 0.5 * np.std(y)
    assert np.isclose(model.history[-1]["train-rmse"], np.sqrt(np.mean((model.numpy_predict(x) - y) ** 2)))


@pytest.mark.parametrize("objective,k", [("binary:logistic", 1), ("multi:softprob", 3), ("survival:cox", 1), ("rank:pairwise", 1)])
def test_spark_objectives_agree_with_local(spark, objective, k):
    x, y = data(120)
    y = {"binary:logistic": (y > 0).astype(float), "multi:softprob": np.digitize(y, [-1, 1]).astype(float), "survival:cox": np.round(np.abs(y), 1) * np.where(np.arange(120) % 3, 1, -1) + 0.01, "rank:pairwise": np.digitize(y, [-1, 1]).astype(float)}[objective]
    df = tabular.dense(spark, x.tolist(), y.tolist()).withColumn("g", F.pmod("row_id", F.lit(5)))
    frame = Frame(df, ("f0", "f1", "f2", "f3"), group="g" if objective.startswith("rank") else None)
    c = params(objective=objective, num_class=k, num_trees=2, max_depth=2)
    a, b = Booster.fit(frame, c, strategy="local"), Booster.fit(frame, c, strategy="spark")
    assert np.allclose(a.numpy_predict(x), b.numpy_predict(x), atol=1e-7)
    assert len(b.trees) == 2 * k


def test_children_add_up_and_error_falls(spark):
    x, y = data()
    model = Booster.fit(frame_of(spark, x, y), params(num_trees=20, max_depth=4), metrics=("rmse",))
    scores = [h["train-rmse"] for h in model.history]
    assert scores[-1] < 0.3 * scores[0]
    for t in model.trees:
        for n in t.nodes:
            if not n.is_leaf:
                assert math.isclose(n.h, t.nodes[n.left].h + t.nodes[n.right].h) and n.gain > 0


@pytest.mark.parametrize("strategy", ["local", "spark"])
def test_constraints(spark, strategy):
    x, y = data(missing=0)
    model = Booster.fit(frame_of(spark, x, y), params(num_trees=4, max_depth=3, monotone={0: 1}, interactions=((0, 1), (2, 3))), strategy=strategy)
    for t in model.trees:
        def walk(k, seen, t=t):
            n = t.nodes[k]
            if n.is_leaf:
                assert len({f // 2 for f in seen}) <= 1
            else:
                walk(n.left, seen | {n.feature})
                walk(n.right, seen | {n.feature})
        walk(0, frozenset())


@pytest.mark.parametrize("changes", [{"max_leaves": 6, "max_depth": 0}, {"tree_method": "exact"}, {"booster": "dart", "rate_drop": 0.5, "one_drop": True}, {"num_parallel_tree": 3}, {"subsample": 0.6, "colsample_bytree": 0.5, "colsample_bylevel": 0.9, "colsample_bynode": 0.9}, {"subsample": 0.5, "sampling_method": "gradient_based"}, {"subsample": 0.5, "refresh_leaf": True}, {"categorical": (3,)}])
def test_variants_learn(spark, changes):
    x, y = data()
    x[:, 3] = np.arange(len(x)) % 6
    model = Booster.fit(frame_of(spark, x, y), params(num_trees=15, max_depth=3).with_(**changes), metrics=("rmse",))
    assert model.history[-1]["train-rmse"] < 0.6 * np.std(y)
    assert np.isclose(model.history[-1]["train-rmse"], np.sqrt(np.mean((model.numpy_predict(x) - y) ** 2)))
    if "max_leaves" in changes:
        assert all(sum(n.is_leaf for n in t.nodes) <= 6 for t in model.trees)


def test_exact_threshold_is_a_midpoint(spark):
    model = Booster.fit(frame_of(spark, np.array([[1.0], [2.0], [5.0], [9.0]]), np.array([0.0, 0, 10, 10])), params(num_trees=1, max_depth=1, tree_method="exact"))
    assert model.trees[0].nodes[0].threshold == 3.5


def test_early_stop_continue_and_callbacks(spark):
    x, y = data()
    train, valid = frame_of(spark, x[:200], y[:200]), frame_of(spark, x[200:], y[200:])
    c = params(num_trees=60, eta=1.0, max_depth=5, early_stopping_rounds=3)
    model = Booster.fit(train, c, valid, ("rmse",))
    best, _ = explain.best_iteration(model.history, "valid-rmse")
    assert len(model.trees) == best + 1 < 60
    two = Booster.fit(train, params(num_trees=2, max_depth=2))
    whole = Booster.fit(train, params(num_trees=4, max_depth=2))
    assert np.allclose(two.continue_fit(train, 2).numpy_predict(x), whole.numpy_predict(x))
    assert len(Booster.fit(train, params(num_trees=9, callbacks=(lambda it, *_: it == 3,))).trees) == 4


def test_custom_hooks(spark):
    x, y = data(missing=0)
    own = params(num_trees=3, custom_objective=lambda p, y, w: (p - y, np.ones_like(p)), custom_metric=lambda p, y: ("x", float(np.abs(p - y).max())))
    a, b = Booster.fit(frame_of(spark, x, y), own), Booster.fit(frame_of(spark, x, y), params(num_trees=3))
    assert np.allclose(a.numpy_predict(x), b.numpy_predict(x)) and "train-custom" in a.history[0]


def test_scoring_paths_agree(spark, monkeypatch):
    x, y = data()
    frame = frame_of(spark, x, y)
    model = Booster.fit(frame, params(num_trees=3, max_depth=3))
    case = [r[0] for r in model.predict(frame.df).orderBy("row_id").select("prediction").collect()]
    leaves = [r[0] for r in model.leaf_index(frame.df).orderBy("row_id").select("leaves").collect()]
    monkeypatch.setattr("thicket.operators.booster.CASE_NODES", 0)
    walked = [r[0] for r in model.predict(frame.df).orderBy("row_id").select("prediction").collect()]
    assert np.allclose(case, walked) and np.allclose(case, model.numpy_predict(x))
    assert [r[0] for r in model.leaf_index(frame.df).orderBy("row_id").select("leaves").collect()] == leaves


def brute_shapley(model, x):
    """By the definition: missing features follow both branches by cover."""
    m = len(model.features)

    def value(tree, known, k=0):
        n = tree.nodes[k]
        if n.is_leaf:
            return n.value
        a, b = tree.nodes[n.left], tree.nodes[n.right]
        if n.feature in known:
            return value(tree, known, n.left if explain._go_left(tree, k, x) else n.right)
        return (a.h * value(tree, known, n.left) + b.h * value(tree, known, n.right)) / (a.h + b.h)

    out = np.zeros(m)
    for t in model.trees:
        for f in range(m):
            for r in range(m):
                for s in itertools.combinations([g for g in range(m) if g != f], r):
                    w = math.factorial(r) * math.factorial(m - r - 1) / math.factorial(m)
                    out[f] += model.params.eta * t.weight * w * (value(t, {*s, f}) - value(t, set(s)))
    return out


def test_attributions(spark):
    x, y = data(200)
    model = Booster.fit(frame_of(spark, x, y), params(num_trees=3, max_depth=4))
    a = explain.shapley(model, x[:20])
    assert np.allclose(a.sum(1), model.numpy_predict(x[:20]))
    for i in range(5):
        assert np.allclose(a[i, :-1], brute_shapley(model, x[i]))
    assert np.allclose(explain.approximate(model, x).sum(1), model.numpy_predict(x))
    both = explain.interactions(model, x[:10])
    assert np.allclose(both.sum(2), a[:10]) and np.allclose(both, both.transpose(0, 2, 1))


def test_model_files(spark, tmp_path):
    x, y = data()
    model = Booster.fit(frame_of(spark, x, (y > 0).astype(float)), params(objective="binary:logistic", num_trees=3, max_depth=3))
    model_io.save_json(model, str(tmp_path / "m.json"))
    model_io.save_ubjson(model, str(tmp_path / "m.ubj"))
    for loaded in (model_io.load_json(str(tmp_path / "m.json")), model_io.load_ubjson(str(tmp_path / "m.ubj"))):
        assert np.allclose(loaded.numpy_predict(x), model.numpy_predict(x), atol=1e-12)
    again = Booster.from_nodes(model.nodes(spark), model.params, model.features, model.base)
    assert np.allclose(again.numpy_predict(x), model.numpy_predict(x))
    for v in (None, True, 1, -200, 70000, 2**40, 1.5, "é", [], [1.0, 2.0], {"a": [1, {"b": None}]}):
        assert model_io.ubjson_decode(model_io.ubjson_encode(v)) == v
    text = model_io.dump_text(model)
    assert text.count("booster[") == 3 and "missing=" in text and "t2_n0" in model_io.dump_dot(model)
    assert model_io.plot_curve([{"iteration": 0, "a": 1.0}], "a") and model_io.plot_importance([("f0", 2.0), ("f1", 0.0)])


def test_older_document():
    doc = {"objective": "reg:squarederror", "learning_rate": 0.5, "base_score": 1.0, "trees": [{"nodes": [{"id": 0, "feature": 0, "threshold": 2.0, "left": 1, "right": 2}, {"id": 1, "left": -1, "right": -1, "leaf_value": 4.0}, {"id": 2, "left": -1, "right": -1, "leaf_value": 8.0}]}]}
    assert model_io.from_document(doc).numpy_predict(np.array([[2.0], [2.1]])).tolist() == [3.0, 5.0]


def test_linear(spark):
    x = np.array([[1.0, 1], [1, 2], [2, 2], [2, 3]])
    frame = frame_of(spark, x, np.array([3.0, 5, 7, 9]))
    c = params(booster="gblinear", num_trees=30, eta=0.3, lambda_=0.0)
    m = linear.LinearBooster.fit(frame, c)
    w, b = linear.fit_linear_local(x, np.array([3.0, 5, 7, 9]), c)
    assert np.allclose(m.weights, w) and np.isclose(m.bias, b)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,3\n\n4,,6\nx\n7,bad,9\n")
    rows = tabular.csv(spark, str(tmp_path / "a.csv"), 2).orderBy("row_id").collect()
    assert [(r["f0"], r["f1"], r["label"]) for r in rows] == [(1, 2, 3), (4, None, 6), (7, None, 9)]
    (tmp_path / "b.svm").write_text("1 0:2 3:4.5\n0\n1 1:nan\n")
    rows = tabular.libsvm(spark, str(tmp_path / "b.svm")).orderBy("row_id").collect()
    assert [tuple(r)[1:] for r in rows] == [(2, 0, 0, 4.5, 1), (0, 0, 0, 0, 0), (0, None, 0, 0, 1)]
    source = tabular.ChunkedSource(spark, [str(tmp_path / "a.csv")] * 1, "csv", 2)
    assert len(source) == 1 and source.chunk(1) is None and source.chunk(0).count() == 3 and tabular.count_rows(spark, str(tmp_path / "a.csv")) == 4
    with pytest.raises(FrameError):
        tabular.dense(spark, [[1.0], [1.0, 2.0]], [1.0, 2.0])
    with pytest.raises(FrameError):
        tabular.ChunkedSource(spark, [], "csv", 2)


def test_params_are_checked():
    for bad in ({"eta": 0}, {"objective": "x"}, {"max_bin": 1}, {"subsample": 0}, {"no_such": 1}, {"objective": "multi:softmax"}, {"monotone": {0: 2}}):
        with pytest.raises(ParamError):
            params(**bad)
    assert params(learning_rate=0.2, reg_lambda=2).lambda_ == 2.0 and Params().eta == 0.3


def test_frame_checks(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 2.0, 1.0)], "row_id int, f0 double, label double")
    with pytest.raises(FrameError):
        Frame(df, ("f9",))
    with pytest.raises(FrameError):
        Frame(df, ("f0",)).checked()


def test_sampling(spark):
    assert sampling.draws(0, 3).round(6).tolist() == [0.548814, 0.592845, 0.715189]
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    a = {r[0] for r in sampling.sample_rows_by_hash(df, 0.3, 1).collect()}
    assert a == {r[0] for r in sampling.sample_rows_by_hash(df.repartition(9), 0.3, 1).collect()} and abs(len(a) - 1500) < 150
    assert abs(sampling.with_multiplicity(df, 3).agg(F.avg("copies")).first()[0] - 1) < 0.06
    folds = sampling.folds(df.withColumn("y", F.pmod("row_id", F.lit(3))), 4, label="y", shuffle_seed=5).groupBy("fold").count().collect()
    assert {r["fold"] for r in folds} == {0, 1, 2, 3} and all(1247 <= r["count"] <= 1253 for r in folds)
    assert sampling.sample_columns(list(range(5)), 0.01, 3) and sampling.bootstrap(100, 1).sum() == 100


def test_selection(spark):
    x, y = data(120)
    found = select.grid_search(frame_of(spark, x, y), params(num_trees=10), {"max_depth": [1, 3], "eta": [0.01, 0.3]}, k=3)
    assert found[0][0]["eta"] == 0.3 and [m for _, m, _ in found] == sorted(m for _, m, _ in found)
    with pytest.raises(ParamError):
        select.grid_search(frame_of(spark, x, y), params(), {"nonsense": [1]}, k=3)


def test_numpy_and_spark_metrics_agree(spark):
    r = np.random.default_rng(0)
    p, y = r.random(200), (r.random(200) < 0.4).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, y))], "row_id int, pred double, label double")
    for name in ("rmse", "mae", "rmsle", "mphe", "logloss", "error", "error@0.3", "auc", "aucpr", "ndcg@10", "map@10", "pre@10", "cox-nloglik", "poisson-nloglik", "gamma-nloglik", "tweedie-nloglik"):
        assert np.isclose(M.evaluate(df, name), M.np_metric(name, p, y), atol=1e-6), name


def test_streaming(spark, tmp_path):
    from thicket.streaming.models import IncrementalTrainer, score

    x, y = data(60, missing=0)
    frame = frame_of(spark, x, y)
    frame.df.write.parquet(str(tmp_path / "in"))
    model = Booster.fit(frame, params(num_trees=2, max_depth=2))
    stream = spark.readStream.schema(frame.df.schema).parquet(str(tmp_path / "in"))
    q = score(model, stream).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 60
    trainer = IncrementalTrainer(model, lambda df: Frame(df, frame.features))
    trainer(frame.df, 0)
    trainer(frame.df, 0)
    assert len(trainer.model.trees) == 3
    assert local.base_margin(params(), y) == pytest.approx(y.mean())


def large_frame(spark, n=400, missing=0.1, effect=0.0):
    x, y = data(n, missing=missing)
    x[:, 3] = np.arange(n) % 6
    y = y + effect * np.array([0, 3, -2, 1, 4, -1])[np.arange(n) % 6]
    return frame_of(spark, x, y), x, y


def same_trees(a, b, x):
    assert len(a.trees) == len(b.trees) and [len(t.nodes) for t in a.trees] == [len(t.nodes) for t in b.trees]
    assert np.allclose(a.numpy_predict(x), b.numpy_predict(x), atol=1e-9)
    for p, q in zip(a.history, b.history, strict=True):
        assert p.keys() == q.keys() and np.allclose(list(p.values()), list(q.values()))


def fit_beyond(spark, monkeypatch, **more):
    """A fit on the driver, and the same call with data too large for it."""
    frame, x, _ = large_frame(spark, effect=3.0 if "categorical" in more else 0.0)
    c = params(num_trees=3, max_depth=3).with_(**more)
    a = Booster.fit(frame, c, metrics=("rmse",), strategy="local")
    monkeypatch.setattr("thicket.operators.booster.LOCAL_CELLS", 100)
    monkeypatch.setattr(Frame, "arrays", lambda self: pytest.fail("rows went to the driver"))
    same_trees(a, Booster.fit(frame, c, metrics=("rmse",), strategy="local"), x)
    return a


def test_large_local_fit_stays_on_the_cluster(spark, monkeypatch):
    fit_beyond(spark, monkeypatch)


@pytest.mark.parametrize("more", [{"categorical": (3,)}, {"categorical": (3,), "max_cat_to_onehot": 8}, {"categorical": (3,), "max_leaves": 6}])
def test_large_categorical_fit(spark, monkeypatch, more):
    model = fit_beyond(spark, monkeypatch, **more)
    assert any(n.cat_left for t in model.trees for n in t.nodes)


def test_large_gradient_sampled_fit(spark, monkeypatch):
    fit_beyond(spark, monkeypatch, subsample=0.3, sampling_method="gradient_based", num_trees=2)


def test_gradient_draws_equal_over_parts(spark):
    r = np.random.default_rng(0)
    g = r.normal(size=5000)
    for values in (g, np.zeros(5000)):
        df = spark.createDataFrame([(i, float(v), 1.0, 1.0) for i, v in enumerate(values)], "row long, g double, h double, n double").repartition(5)
        got = sampling.drawn_by_gradient(sampling.in_row_order(df, "row"), 0.3, 7).collect()
        want = sampling.sample_by_gradient(values, 0.3, 7)
        assert {x["row"]: x["n"] for x in got} == {i: n for i, n in enumerate(want) if n}


@pytest.mark.parametrize("more", [{}, {"subsample": 0.6, "max_leaves": 5}])
def test_large_multi_output_fit(spark, monkeypatch, more):
    from thicket.operators.multi import MultiOutput

    frame, x, y = large_frame(spark)
    frame = Frame(frame.df.withColumn("z", F.coalesce("f1", F.lit(0.5)) * 2), frame.features)
    c = params(num_trees=3, max_depth=3).with_(**more)
    for structure in ("first", "sum"):
        a = MultiOutput.fit(frame, ("label", "z"), c, structure)
        with monkeypatch.context() as m:
            m.setattr("thicket.operators.multi.LOCAL_CELLS", 100)
            b = MultiOutput.fit(frame, ("label", "z"), c, structure)
        assert [len(t.nodes) for t in a.trees] == [len(t.nodes) for t in b.trees]
        assert np.allclose(a.numpy_predict(x), b.numpy_predict(x), atol=1e-9)


def test_large_cross_validation(spark, monkeypatch):
    frame, _, _ = large_frame(spark, 120)
    combos = [params(num_trees=2, max_depth=2), params(num_trees=2, max_depth=1, subsample=0.7)]
    a = select.cross_validate(frame, combos, 2, ("rmse",)).collect()
    for where in ("select", "booster"):
        monkeypatch.setattr(f"thicket.operators.{where}.LOCAL_CELLS", 100)
    b = select.cross_validate(frame, combos, 2, ("rmse",)).collect()
    key = lambda r: tuple(r)[:4]
    assert [key(r) for r in sorted(a, key=key)] == [key(r) for r in sorted(b, key=key)]
    assert np.allclose([r["value"] for r in sorted(a, key=key)], [r["value"] for r in sorted(b, key=key)], atol=1e-9)


def test_large_refreshed_fit(spark, monkeypatch):
    fit_beyond(spark, monkeypatch, subsample=0.3, refresh_leaf=True)


def test_missing_rows_may_split_from_all_others(spark):
    x = np.array([[1.0], [2.0], [np.nan], [np.nan]] * 5)
    frame = frame_of(spark, x, np.where(np.isnan(x[:, 0]), 10.0, 0.0))
    a, b = (Booster.fit(frame, params(num_trees=1, max_depth=1), strategy=s) for s in ("local", "spark"))
    assert len(a.trees[0].nodes) == 3 and not a.trees[0].nodes[0].default_left
    assert np.allclose(a.numpy_predict(x), b.numpy_predict(x))


def test_large_dart_fit(spark, monkeypatch):
    model = fit_beyond(spark, monkeypatch, booster="dart", rate_drop=0.5, one_drop=True, num_trees=5)
    assert len({t.weight for t in model.trees}) > 1


@pytest.mark.parametrize("more", [{}, {"categorical": (3,)}, {"max_leaves": 7}])
def test_large_exact_fit(spark, monkeypatch, more):
    fit_beyond(spark, monkeypatch, tree_method="exact", **more)


def test_large_loss_guided_fit(spark, monkeypatch):
    fit_beyond(spark, monkeypatch, max_leaves=12, max_depth=0, num_trees=2)


def test_large_continued_fit(spark, monkeypatch):
    frame, x, _ = large_frame(spark)
    start = Booster.fit(frame, params(num_trees=1, max_depth=3), metrics=("rmse",), strategy="local")
    a = start.continue_fit(frame, 2, metrics=("rmse",), strategy="local")
    monkeypatch.setattr("thicket.operators.booster.LOCAL_CELLS", 100)
    monkeypatch.setattr(Frame, "arrays", lambda self: pytest.fail("rows went to the driver"))
    same_trees(a, start.continue_fit(frame, 2, metrics=("rmse",), strategy="local"), x)


def test_large_early_stopped_fit(spark, monkeypatch):
    frame, x, _ = large_frame(spark)
    train, valid = (Frame(frame.df.where(f"row_id % 5 {sign} 0").withColumn("start", F.col("f3") / 10), frame.features, margin="start") for sign in ("!=", "="))
    c = params(num_trees=4, max_depth=4, eta=1.0, early_stopping_rounds=1)
    a = Booster.fit(train, c, valid, ("rmse",), "local")
    monkeypatch.setattr("thicket.operators.booster.LOCAL_CELLS", 100)
    same_trees(a, Booster.fit(train, c, valid, ("rmse",), "local"), x)


def test_large_forest_fit(spark, monkeypatch):
    fit_beyond(spark, monkeypatch, num_parallel_tree=2, num_trees=2)


def test_large_ranking_fit(spark, monkeypatch):
    frame, x, y = large_frame(spark, 120)
    df = frame.df.withColumns({"g": F.pmod("row_id", F.lit(9)), "label": F.when(F.col("label") > 1, 2.0).when(F.col("label") > 0, 1.0).otherwise(0.0)})
    frame, c = Frame(df, frame.features, group="g"), params(objective="rank:ndcg", num_trees=2, max_depth=2)
    a = Booster.fit(frame, c, metrics=("ndcg@5",), strategy="local")
    monkeypatch.setattr("thicket.operators.booster.LOCAL_CELLS", 100)
    monkeypatch.setattr(Frame, "arrays", lambda self: pytest.fail("rows went to the driver"))
    same_trees(a, Booster.fit(frame, c, metrics=("ndcg@5",), strategy="local"), x)


def test_large_sampled_fit(spark, monkeypatch):
    fit_beyond(spark, monkeypatch, subsample=0.5, colsample_bytree=0.75, colsample_bynode=0.75)


def test_large_grid_search(spark, monkeypatch):
    frame, _, _ = large_frame(spark, 120)
    for where in ("select", "booster"):
        monkeypatch.setattr(f"thicket.operators.{where}.LOCAL_CELLS", 100)
    found = select.grid_search(frame, params(num_trees=1), {"max_depth": [1], "eta": [0.01, 0.5]}, k=2)
    assert [x["eta"] for x, _, _ in found] == [0.5, 0.01]


@pytest.mark.parametrize("label", [None, "y"])
@pytest.mark.parametrize("shuffle_seed", [None, 5])
@pytest.mark.parametrize("n", [2, 1003])
def test_folds_of_large_data_by_edges(spark, monkeypatch, label, shuffle_seed, n):
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("row_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("y")).repartition(3)
    expected = sorted(map(tuple, sampling.folds(df, 4, label=label, shuffle_seed=shuffle_seed).select("row_id", "fold").collect()))
    found = sampling.folds_by_edges(df, 4, label=label, shuffle_seed=shuffle_seed)
    assert sorted(map(tuple, found.select("row_id", "fold").collect())) == expected
    assert "Window" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr("thicket.operators.sampling._LABELS", 1)
    assert sorted(map(tuple, sampling.folds_by_edges(df, 4, label=label, shuffle_seed=shuffle_seed).select("row_id", "fold").collect())) == expected


def test_large_search_spreads_its_rows(spark, monkeypatch):
    frame, _, _ = large_frame(spark, 120)
    frame, parts = Frame(frame.df.repartition(3), frame.features), []
    for where in ("select", "booster"):
        monkeypatch.setattr(f"thicket.operators.{where}.LOCAL_CELLS", 100)
    fit = Booster.fit
    monkeypatch.setattr(Booster, "fit", lambda f, c: (parts.append(f.df.rdd.getNumPartitions()), fit(f, c))[1])
    select.grid_search(frame, params(num_trees=1), {"max_depth": [1]}, k=2)
    assert parts == [3, 3]


class Groups(np.ndarray):
    def __eq__(self, other):
        pytest.fail("all rows were compared with one group")


@pytest.mark.parametrize("objective", ["rank:ndcg", "rank:map", "rank:pairwise"])
def test_local_ranking_sorts_groups_once_and_takes_pairs_in_blocks(monkeypatch, objective):
    r = np.random.default_rng(3)
    p, y, group, c = r.normal(size=3000), r.integers(0, 4, 3000).astype(float), r.integers(0, 40, 3000), params(objective=objective)
    expected = np.zeros((2, 3000))
    for k in range(40):
        at = np.flatnonzero(group == k)
        expected[:, at] = O.np_gradient(c, p[at], y[at])
    assert np.allclose(O.np_gradient(c, p, y, None, group.view(Groups)), expected, atol=1e-12)
    assert M.np_metric("ndcg@5", p, y, group.view(Groups)) == pytest.approx(np.mean([M.np_metric("ndcg@5", p[group == k], y[group == k]) for k in range(40)]))
    whole = O.np_gradient(c, p[:300], y[:300])
    monkeypatch.setattr("thicket.functions.objectives._PAIRS", 1000)
    assert np.allclose(O.np_gradient(c, p[:300], y[:300]), whole, atol=1e-12)
    monkeypatch.undo()
    tracemalloc.start()
    O.np_gradient(c, p, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000  # all pairs at once take hundreds of MB


def test_rows_without_a_group_meet_no_others():
    g, h = O.np_gradient(params(objective="rank:pairwise"), np.zeros(4), np.array([0.0, 1, 0, 1]), None, np.array([1.0, 1, np.nan, np.nan]))
    assert g.tolist() == [0.5, -0.5, 0, 0] and h[2:].tolist() == [0, 0]
