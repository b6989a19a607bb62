from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions import selection
from panelspark.functions.hashing import unit_hash
from panelspark.operators import metrics, mining, panel, prep, roles, threshold


@pytest.fixture
def few(monkeypatch):
    """Brackets that are narrowed in several rounds, by sketches that are often wrong."""
    monkeypatch.setattr(selection, "FEW", 3)
    monkeypatch.setattr(selection, "ACCURACY", 4)


def test_values_at_every_kind_of_place(spark, few):
    rng = random.Random(1)
    a = [rng.choice([0.0, 1.0, 1.0, -5.5, math.inf, -math.inf, 1e300, 1e-300]) for _ in range(120)] + [float(2**k) for k in range(80)]
    b = [rng.gauss(0, 1) for _ in range(200)]
    rows = [(x, None if k % 3 == 0 else y, None if k % 5 else math.nan) for k, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, `c.d` double").repartition(3)
    table = selection.numbers(df, {"a": F.col("a"), "b": F.col("b")})
    want = {"a": sorted(a), "b": sorted(r[1] for r in rows if r[1] is not None)}
    counts = {c: len(v) for c, v in want.items()}
    places = [(c, k) for c in want for k in (0, 1, counts[c] // 3, counts[c] // 2, counts[c] - 1)]
    found = selection.values_at(table, places, counts)
    for c, k in places:
        assert found[c, k] == (want[c][k], sum(x < want[c][k] for x in want[c]))


def test_quantiles_are_exact_and_empty_columns_have_none(spark, few):
    values = [float(x) for x in range(101)] + [None] * 7
    df = spark.createDataFrame([(x, None) for x in values], "x double, y double").repartition(4)
    stats = prep.numeric_stats(df, {"x": {"median", "q25", "q75"}, "y": {"median"}})
    assert {k: stats["x"][k] for k in ("median", "q25", "q75")} == {"median": 50.0, "q25": 25.0, "q75": 75.0}
    assert stats["y"]["median"] is None and stats["x"]["missing"] == 7


@pytest.mark.parametrize("n", [0, 1, 7, 40, 99, 100, 500])
def test_smallest_rows_by_several_columns(spark, few, n):
    rng = random.Random(n)
    rows = [(k, float(rng.randint(0, 3)), float(rng.randint(0, 2)), None if k == 50 else f"k{k % 37}") for k in range(100)]
    df = spark.createDataFrame(rows, "id long, a double, b double, s string").repartition(3)
    condition = selection.smallest(df, ["a", "b"], ["s", "id"], n)
    got = set() if condition is None else {r["id"] for r in df.where(condition).collect()}
    assert got == {r[0] for r in sorted(rows, key=lambda r: (r[1], r[2], r[3] is not None, r[3] or "", r[0]))[:n]}


@pytest.mark.parametrize("method", ["top_prob", "margin", "entropy"])
def test_hard_negatives_equal_a_sort(spark, few, method):
    """Scores with many ties and missing ones; no window and no global sort in the plan."""
    rng = random.Random(3)
    rows = [(k, int(rng.random() < 0.2)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, y int").repartition(3)
    scores = spark.createDataFrame([(k, round(rng.random() * 8) / 8) for k in range(0, 300, 2)], "id long, score double")
    out = mining.hard_negatives(df, "y", ["id"], scores, ratio=0.5, method=method, floor=10)
    ranked = mining.mining_order(mining.with_scores(df.where("y = 0"), scores, ["id"]), ["id"], method).collect()
    n_pos = sum(y for _, y in rows)
    target = min(max(int(n_pos / 0.5), 10), len(ranked))
    hard = int(target * 0.6)
    u = {r["id"]: r["u"] for r in df.select("id", unit_hash(["id"], 42).alias("u")).collect()}
    rest = sorted((r["id"] for r in ranked if r["rank"] > hard), key=lambda i: (u[i], i))[: target - hard]
    want = {"hard": {r["id"] for r in ranked if r["rank"] <= hard}, "random": set(rest), "positive": {i for i, y in rows if y}}
    got = {}
    for r in out.collect():
        got.setdefault(r["origin"], set()).add(r["id"])
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan


def test_percentile_cut_is_exact(spark, few):
    df = spark.createDataFrame([(k % 10 == 0, k / 7) for k in range(500)], "pos boolean, score double").select(F.col("pos").cast("int").alias("y"), "score")
    negatives = sorted(k / 7 for k in range(500) if k % 10)
    cut = negatives[math.ceil(0.8 * len(negatives)) - 1]
    assert mining.above_percentile(df, "y", 0.8).where("y = 0").agg(F.min("score"), F.count("*")).first() == (cut, sum(x >= cut for x in negatives))
    assert mining.above_percentile(df.where("y = 1"), "y").count() == 50


def test_keyed_dedup_without_a_window(spark):
    rows = [(k % 5 if k % 11 else None, None if k % 7 == 0 else k % 3, f"t{k % 4}", k) for k in range(80)]
    df = spark.createDataFrame(rows, "key long, a int, t string, n int").repartition(4)
    for keep in ("first", "last"):
        out = panel.deduplicate(df, ["key"], ["a", "t"], keep)
        assert out.columns == df.columns and "Window" not in out._jdf.queryExecution().executedPlan().toString()
        order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
        want = {}
        for r in sorted(rows, key=order, reverse=keep == "last"):
            want.setdefault(r[0], r)
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want.values()))


def test_types_by_few_values(spark):
    rows = [(k % 20, None if k % 20 == 7 else k % 21, k % 3, None, k) for k in range(400)]
    df = spark.createDataFrame(rows, "twenty int, more long, three long, nothing int, many long").repartition(6)
    kinds = roles.infer_types(df, df.columns)
    assert kinds == {"twenty": "categorical", "more": "numeric", "three": "categorical", "nothing": "categorical", "many": "numeric"}
    assert set(roles.infer_types(df.limit(0), df.columns).values()) == {"categorical"}


def test_youden_with_one_class_or_none(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7), (0, 0.4)], "y int, p double")
    assert tuple(threshold.tune_youden(df.where("y = 1"), "y", "p").first()) == (0.2, 1.0)
    assert tuple(threshold.tune_youden(df.where("y = 0"), "y", "p").first()) == (1.0, 0.0)
    assert threshold.tune_constrained(df.where("y = 0"), "y", "p", 0.1).first()["feasible"] is False


def test_rows_without_a_score_or_label_are_left_out(spark):
    whole = [(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.4)]
    df = spark.createDataFrame(whole, "y int, p double")
    more = df.unionByName(spark.createDataFrame([(1, None), (0, math.nan), (None, 0.5)], df.schema))
    assert metrics.metric_row(more, "y", "p").first() == metrics.metric_row(df, "y", "p").first()
    assert metrics.losses(more, "y", "p").first() == metrics.losses(df, "y", "p").first()


def test_ndcg_of_groups_equals_the_definition(spark):
    rng = random.Random(4)
    rows = [(None if k % 9 == 0 else "hot" if k % 2 else f"g{k % 5}", rng.choice([None, 0, 1, 2, 3]), rng.choice([0.1, 0.5, 0.9]), k) for k in range(150)]
    df = spark.createDataFrame(rows, "g string, r int, s double, id int").repartition(4)
    for k in (None, 3):
        want = {}
        for g in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == g]
            gains = [2 ** (r[1] or 0) - 1 for r in sorted(own, key=lambda r: (-r[2], r[3]))]
            sum_of = lambda x: sum(v / math.log2(2 + i) for i, v in enumerate(x[:k]))
            best = sum_of(sorted(gains, reverse=True))
            want[g] = sum_of(gains) / best if best else 1.0
        got = {r["g"]: r["ndcg"] for r in metrics.ndcg(df, "g", "r", "s", ["id"], k).collect()}
        assert got == pytest.approx(want)
