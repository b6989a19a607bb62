from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelspark.operators import metrics, models, perceptron
from panelspark.operators import ranker as ranker_module
from panelspark.operators.perceptron import Perceptron, PerceptronModel, loss_and_gradient
from panelspark.operators.ranker import BoostedRanker, pair_gradients
from panelspark.sources.scratch import scratch_path


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, y int, w double")
    return df.withColumn("features", array_to_vector(F.array("a", "b")))


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    layers, x, y, w = [3, 4, 2, 1], rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float), rng.random(20)
    flat = rng.normal(size=4 * 4 + 5 * 2 + 3)
    _, gradient = loss_and_gradient(flat, layers, x, y, w)
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        slope = (loss_and_gradient(flat + step, layers, x, y, w)[0] - loss_and_gradient(flat - step, layers, x, y, w)[0]) / 2e-6
        assert gradient[k] == pytest.approx(slope, abs=1e-5)


def test_weights_equal_copies_and_balance_equals_weights(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1), int(rng.random() < 0.2), float(rng.choice([1, 2, 3]))) for _ in range(60)]
    copies = [(a, b, y, 1.0) for a, b, y, w in rows for _ in range(int(w))]
    net = Perceptron([3], max_iter=4)
    weighted, copied = net.fit(_frame(spark, rows), "y", "features", "w"), net.fit(_frame(spark, copies), "y", "features")
    assert weighted.history["train"] == pytest.approx(copied.history["train"]) and weighted.flat == pytest.approx(copied.flat)
    n_pos = sum(y for *_, y, _ in rows)
    by_hand = [(a, b, y, (60 - n_pos) / n_pos if y else 1.0) for a, b, y, _ in rows]
    balanced = net.fit(_frame(spark, [(*r[:3], 1.0) for r in rows]), "y", "features")
    assert Perceptron([3], max_iter=4, balance=False).fit(_frame(spark, by_hand), "y", "features", "w").flat == pytest.approx(balanced.flat)


def test_patience_keeps_the_best_epoch(spark):
    """Validation labels are the opposite of the training ones: no epoch after the first is better."""
    rng = random.Random(3)
    rows = [(x := rng.gauss(0, 1), rng.gauss(0, 1), int(x > 0), 1.0) for _ in range(80)]
    other = [(a, b, 1 - y, w) for a, b, y, w in rows]
    model = Perceptron([2], max_iter=30, patience=3).fit(_frame(spark, rows), "y", "features", valid=_frame(spark, other))
    falls = model.history["valid"].index(min(model.history["valid"]))
    assert len(model.history["valid"]) == len(model.history["train"]) == falls + 4 < 30
    path = scratch_path(spark, "net")
    model.save(spark, path)
    again = PerceptronModel.load(spark, path)
    a, b = (m.transform(_frame(spark, rows)).select("probability").collect() for m in (model, again))
    assert a == b


def test_missing_features_are_an_error(spark):
    with pytest.raises(Exception, match="missing features"):
        Perceptron([2], max_iter=1).fit(_frame(spark, [(math.nan, 1.0, 1, 1.0), (1.0, 1.0, 0, 1.0)]), "y", "features")


def test_history_has_both_curves(spark):
    df = _frame(spark, [(k / 50, (k % 7) / 7, int(k > 25), 1.0) for k in range(50)])
    for kind, params in (("mlp", {"hidden": [2], "maxIter": 3}), ("gbt", {"maxIter": 3, "maxDepth": 1})):
        fitted = models.Classifier(kind, "y", params=params).fit(df, df)
        curves = {(r["part"], r["iteration"]): r["loss"] for r in fitted.training_history(spark).collect()}
        assert set(curves) == {(p, k) for p in ("train", "valid") for k in range(len(fitted.history["train"]))}


def test_pair_gradients_equal_all_pairs():
    rng = np.random.default_rng(4)
    scores, levels = np.linspace(-2, 2, 6), [(float(g), b) for g in range(3) for b in range(6)]
    counts = rng.integers(0, 4, len(levels))
    rows = [(g, scores[b]) for (g, b), n in zip(levels, counts, strict=True) for _ in range(n)]
    gradient, curvature = pair_gradients(np.array([g for g, _ in levels]), np.array([b for _, b in levels]), counts, scores)
    for (g, b), d, h in zip(levels, gradient, curvature, strict=True):
        p = [(1 if g > r else -1, 1 / (1 + math.exp((1 if g > r else -1) * (scores[b] - s)))) for r, s in rows if r != g]
        assert d == pytest.approx(sum(sign * x for sign, x in p)) and h == pytest.approx(sum(x * (1 - x) for _, x in p))


def test_trees_rank_what_a_line_cannot(spark):
    """Relevance is high in the middle of a range; a hot group, a null one, and missing values."""
    rng = random.Random(5)
    rows = []
    for k in range(600):
        x = rng.uniform(-1, 1)
        rows.append((k, "hot" if k % 3 == 0 else None if k % 50 == 1 else f"g{k % 20}", None if abs(x) > 0.6 else 2 if abs(x) < 0.3 else 1, None if abs(x) > 0.9 else x, rng.random()))
    df = spark.createDataFrame(rows, "id long, g string, r int, x double, noise double").repartition(4)
    ranker = BoostedRanker("g", "r", ["x", "noise"], rounds=9, depth=3).fit(df)
    linear = models.LinearRanker("g", "r", ["id"], ["x", "noise"]).fit(df)
    found = [metrics.ndcg(m.predict(df), "g", "r", "score", ["id"]).agg(F.min("ndcg"), F.avg("ndcg")).first() for m in (ranker, linear)]
    assert found[0][0] > 0.95 and found[0][1] > found[1][1] + 0.1
    path = scratch_path(spark, "ranker")
    ranker.save(spark, path)
    a, b = (m.predict(df).orderBy("id").select("score").collect() for m in (ranker, BoostedRanker.load(spark, path)))
    assert a == b and ranker.predict(df).columns == [*df.columns, "score"]
    assert BoostedRanker("g", "r", ["x"]).fit(df.limit(0)).trees == []


def test_perceptron_blocks_use_all_cores_and_sum_alike(spark, monkeypatch):
    """Epochs don't run on the few partitions that small stored rows have; both ways of adding up agree."""
    rng = random.Random(6)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1), int(rng.random() < 0.3), 1.0) for _ in range(3000)]
    df, met, plain = _frame(spark, rows).coalesce(1), [], perceptron._blocks
    monkeypatch.setattr(perceptron, "_blocks", lambda *args: met.append(plain(*args)) or met[-1])
    monkeypatch.setattr(perceptron, "BLOCK", 200)
    whole = Perceptron([3], max_iter=3).fit(df, "y", "features", valid=df)
    assert met[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sum(len(r["y"]) // 8 for r in met[0].collect()) == 6000 and whole.history["train"] == pytest.approx(whole.history["valid"])
    monkeypatch.setattr(perceptron, "AT_ONCE", 0)
    assert Perceptron([3], max_iter=3).fit(df, "y", "features", valid=df).flat == pytest.approx(whole.flat)


def test_gradients_of_many_groups_equal_those_of_each(monkeypatch):
    """Groups of one level, a few and many, at once and in small parts."""
    rng = np.random.default_rng(8)
    scores = np.linspace(-3, 3, 128)
    sizes = np.array([1, 5, 300, 2, 64, 65, 7, 1, 40], dtype=np.int32)
    grades, bins, counts = [], [], []
    for n in sizes:
        at = rng.choice(3 * 128, n, replace=False)
        grades, bins, counts = [*grades, *(at // 128).astype(float)], [*bins, *(at % 128)], [*counts, *rng.integers(1, 5, n)]
    args = np.array(grades), np.array(bins, dtype=np.int32), np.array(counts)
    ends = np.cumsum(sizes)
    want = [pair_gradients(*(x[e - n : e] for x in args), scores) for n, e in zip(sizes, ends, strict=True)]
    for at_once in (1 << 20, 30):
        monkeypatch.setattr(ranker_module, "AT_ONCE", at_once)
        for k, got in enumerate(ranker_module.many_gradients(sizes, *args, scores)):
            assert got == pytest.approx(np.concatenate([w[k] for w in want]))


def test_a_round_computes_its_groups_in_batches(spark, monkeypatch):
    """No call for each group, and one join of rows and gradients for each tree."""
    met, plain = [], BoostedRanker._targets
    monkeypatch.setattr(BoostedRanker, "_targets", lambda self, *args: met.append(plain(self, *args)) or met[-1])
    df = spark.range(400).selectExpr("id", "id div 4 as g", "cast(id % 2 as int) as r", "cast(id % 7 as double) as x")
    read, fit = [], ranker_module.DecisionTreeRegressor.fit
    monkeypatch.setattr(ranker_module.DecisionTreeRegressor, "fit", lambda self, t: read.append(t.is_cached) or fit(self, t))
    assert len(BoostedRanker("g", "r", ["x"], rounds=2, depth=2).fit(df).trees) == 2 and read == [True, True] and len(met) == 2
    pairs_of = models.LinearRanker("g", "r", ["id"], ["x"])
    seen, fit_lr = [], models.LogisticRegression.fit
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, t: seen.append(t) or fit_lr(self, t))
    pairs_of.fit(df)
    rows = [(r["label"], r["features"][0]) for r in seen[0].collect()]
    assert sorted(x for y, x in rows if y == 1) == sorted(-x for y, x in rows if y == 0) and len(rows) == 2 * models.pairs(df, "g", "r", ["id"], ["x"]).count()
    assert "Union" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
