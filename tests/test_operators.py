from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelspark.functions.hashing import unit_hash
from panelspark.functions.ranking import global_rank, running_sums, with_previous
from panelspark.operators import clean, curves, experiments, metrics, mining, models, panel, prep, roles, sampling, threshold
from panelspark.plans import catalog
from panelspark.sources.scratch import scratch_path
from panelspark.sources.tables import Registry, Source, limited_handoff


def scored(spark, n=200, seed=0):
    rng = random.Random(seed)
    rows = [(i, int(rng.random() < 0.4), rng.randrange(21) / 20) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, y int, p double")


def test_ranks_and_running_sums_over_partitions_and_ties(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(5), rng.randrange(100)) for i in range(500)]
    for n in (1, 7):
        df = spark.createDataFrame(rows, "id long, k int, v long").repartition(n)
        ranks = {r["id"]: r["rank"] for r in global_rank(df, [F.desc("k"), F.col("id")]).collect()}
        assert [i for i, _ in sorted(ranks.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
        assert sorted(ranks.values()) == list(range(1, 501))
        total, want = 0, {}
        for i, _, v in sorted(rows, key=lambda r: (-r[1], r[0])):
            want[i] = total = total + v
        assert {r["id"]: r["s"] for r in running_sums(df, [F.desc("k"), F.col("id")], {"s": "v"}).collect()} == want


def test_ranking_has_no_single_partition_sort_of_rows(spark):
    plan = global_rank(spark.range(1000), [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the offsets, a row for each partition


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(3000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    runs = {"random": {"fraction": 0.3}, "stratified": {"fraction": 0.3}, "undersample": {"ratio": 0.5}, "oversample": {"ratio": 0.5}, "neg_frac": {"fraction": 0.1}}
    for name, options in runs.items():
        config = {"strategy": name} | options
        a, b = (sorted(r["id"] for r in sampling.by_strategy(x, "y", ["id"], config).collect()) for x in (df, df.repartition(7)))
        assert a == b and a
    assert spark.range(1).select(unit_hash(["id"], 42)).first()[0] < 1
    with pytest.raises(ValueError):
        sampling.by_strategy(df, "y", ["id"], {"strategy": "other"})


def test_sampling_edge_frames(spark):
    df = spark.range(50).withColumn("y", F.lit(1))
    assert sampling.undersample(df, "y", ["id"]).count() == 50
    assert sampling.oversample(df, "y", ["id"]).count() == 50
    assert sampling.class_weights(df.withColumn("y", F.lit(0)), "y").first()["weight"] == 1.0
    with pytest.raises(ValueError):
        sampling.add_weights(df.withColumn("y", F.lit(0)), "y")
    assert sampling.undersample(df.limit(0), "y", ["id"]).count() == 0


def test_hard_negatives_counts(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") < 200).cast("int"))
    points = spark.range(1000).select("id", (F.col("id") / 1000).alias("score"))
    twice = points.unionByName(points.withColumn("score", F.lit(0.0)))
    for method in ("top_prob", "margin", "entropy"):
        out = mining.hard_negatives(df, "y", ["id"], twice, ratio=0.5, method=method).groupBy("origin").count().collect()
        assert {r["origin"]: r["count"] for r in out} == {"positive": 200, "hard": 240, "random": 160}
    top = mining.hard_negatives(df, "y", ["id"], points, ratio=0.5).where("origin = 'hard'")
    assert top.agg(F.min("id")).first()[0] == 760
    with pytest.raises(ValueError):
        mining.hardness("other", F.col("score"))
    few = mining.hard_negatives(df.where("id < 230"), "y", ["id"], points).where("y = 0")
    assert few.count() == 30
    assert mining.hard_negatives(df, "y", ["id"], points, n_hard=10).where("origin = 'hard'").count() == 10
    assert mining.hard_negatives(df, "y", ["id"], points, hard_per_pos=2).where("origin = 'hard'").count() == 400


def test_splits(spark):
    df = spark.range(10).withColumn("year", (F.col("id") + 2000).cast("int"))
    train, valid, test = panel.time_split(df, (2000, 2004), (2006, 2009), (2004, 2006))
    assert [x.count() for x in (train, valid, test)] == [4, 2, 3]
    assert panel.time_split(df, (2000, 2004), (2005, 2005), inclusive=True)[2].count() == 1
    assert panel.time_split(df, (2000, 2004), (2005, 2006))[1] is None
    with pytest.raises(ValueError):
        panel.time_split(df, (2000, 2004), (2005, 2005))
    with pytest.raises(ValueError):
        panel.deduplicate(df, ["id"])


def test_roles(spark):
    df = spark.createDataFrame([(1, "a", 1.0, True, 0, None), (2, "b", 2.0, False, 1, 3)], "id long, s string, d double, b boolean, y int, i int")
    out = roles.resolve(df, "y", keys=["id"])
    assert out.categorical == ["s", "i"] and out.numeric == ["d", "b"]
    assert roles.resolve(df, "y", numeric=["i"], keys=["id"], max_levels=0).numeric == ["d", "b", "i"]
    assert roles.resolve(df, "y", numeric=["gone"], strict=False, auto=False).numeric == []
    for bad in ({"label": "gone"}, {"label": "y", "numeric": ["gone"]}, {"label": "y", "numeric": ["d"], "categorical": ["d"]}):
        with pytest.raises(ValueError):
            roles.resolve(df, **bad)
    with pytest.raises(TypeError):
        roles.resolve(df.withColumn("a", F.array("id")), "y")
    assert roles.split_numeric(df, ["b", "d", "y"]) == (["b", "y"], ["d"])
    assert out.selection() == ["d", "b", "s", "i", "y"]


def test_clean_switches(spark):
    df = spark.createDataFrame([(1, None, math.nan, "a"), (0, 1, math.inf, None)], "y int, f int, d double, c string")
    rows = clean.clean(df, "y", ["c"], ["f"], ["d"]).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.0, None, "a"), (0.0, 1.0, None, None)]
    kept = clean.clean(df, "y", ["c"], ["f"], ["d"], label_cast=None, binary_null_to=None, nan_to_null=False, inf_to_null=False).collect()
    assert kept[0]["f"] is None and math.isnan(kept[0]["d"]) and kept[1]["d"] == math.inf


def test_curves_against_brute_force(spark):
    rows, df = scored(spark)
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    got = curves.auc(df, "y", "p").first()
    assert got["auc_roc"] == pytest.approx(auc)
    assert curves.auc(df.withColumn("p", 1 - F.col("p")), "y", "p").first()["auc_roc"] == pytest.approx(1 - auc)
    ap = sum(sum(y for _, y, q in rows if q == p) / len(pos) * sum(y for _, y, q in rows if q >= p) / sum(q >= p for _, _, q in rows) for p in {r[2] for r in rows})
    assert got["average_precision"] == pytest.approx(ap)
    assert curves.auc(df.where("y = 1"), "y", "p").first()["auc_roc"] is None
    assert 0 < curves.auc(df, "y", "p", approximate=True).first()["auc_roc"] < 1
    assert curves.auc(df.limit(0), "y", "p").first()["auc_roc"] is None


def test_sweep_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3), rng.choice([rng.random(), rng.randrange(100) / 99, 0.0, 1.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    for r in threshold.sweep(df, "y", "p").collect():
        t = r["i"] / 99
        assert r["threshold"] == t
        assert (r["tp"], r["fp"]) == (sum(y for y, p in rows if p >= t), sum(1 - y for y, p in rows if p >= t))
        assert (r["fn"], r["tn"]) == (sum(y for y, p in rows if p < t), sum(1 - y for y, p in rows if p < t))


def test_thresholds(spark):
    rows, df = scored(spark, seed=5)
    f1 = lambda t: 2 * sum(y for _, y, p in rows if p >= t) / max(1, sum(y for _, y, _ in rows) + sum(p >= t for *_, p in rows))
    assert threshold.tune(df, "y", "p") == max((i / 99 for i in range(100)), key=f1)
    youden = {t: sum(y for _, y, p in rows if p >= t) / sum(y for _, y, _ in rows) - sum(1 - y for _, y, p in rows if p >= t) / sum(1 - y for _, y, _ in rows) for t in {p for *_, p in rows}}
    assert youden[threshold.tune(df, "y", "p", "youden")] == pytest.approx(max(youden.values()))
    none = threshold.tune_constrained(df, "y", "p", min_precision=1.1).first()
    assert none["threshold"] == 0.5 and not none["feasible"]
    for bad in (df.withColumn("y", F.lit(2)), df.withColumn("p", F.lit(1.5)), df.withColumn("p", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            threshold.tune(bad, "y", "p")
    with pytest.raises(ValueError):
        threshold.tune(df, "y", "p", "other")


def test_metric_rows_of_edge_frames(spark):
    _, df = scored(spark)
    empty = metrics.metric_row(df.limit(0), "y", "p").first()
    assert empty["n"] == 0 and empty["precision"] == 0 and empty["f1"] == 0
    assert metrics.losses(df, "y", "p").first()["log_loss"] > 0
    pairs = spark.createDataFrame([(1, 3, 0.9, 1), (1, 2, 0.8, 2), (2, 0, 0.5, 3), (3, 1, 0.1, 4), (3, 0, 0.9, 5)], "g int, rel int, s double, id int")
    got = {r["g"]: r["ndcg"] for r in metrics.ndcg(pairs, "g", "rel", "s", ["id"]).collect()}
    assert got[1] == 1 and got[2] == 1 and got[3] == pytest.approx(1 / math.log2(3))


def people(spark, n=300):
    rng = random.Random(2)
    rows = [(i, rng.choice("aabbbcd") if i % 11 else None, rng.choice([rng.gauss(5, 2), None, math.nan]), rng.random() * 10, i % 2 == 0, int(rng.random() < 0.5)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, c string, x double, z double, b boolean, y int").withColumn("flat", F.lit(7.0)).withColumn("void", F.lit(None).cast("double"))


def test_one_hot_keeps_every_level_or_raises(spark):
    df = spark.range(6).select(F.col("id").cast("string").alias("c"))
    assert prep.Preprocessor([], ["c"], max_one_hot=6).fit(df).names() == [f"c={k}" for k in range(6)]
    with pytest.raises(ValueError, match="max_one_hot"):
        prep.Preprocessor([], ["c"], max_one_hot=5).fit(df)


def test_wide_columns_keep_all_levels_and_use_no_task_for_a_column(spark):
    df = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("c"), (F.col("id") / 7).alias("x"))
    plan = prep.Preprocessor(["x"], ["c"], encoding="one_hot", max_one_hot=2000).fit(df)
    assert len(plan.names()) == 1501
    labels = prep.category_levels(df, ["c"])
    assert sorted(r["by_frequency"] for r in labels.collect()) == list(range(1500))
    assert "SinglePartition" not in labels._jdf.queryExecution().executedPlan().toString()


def test_a_fitted_state_is_frozen_and_transforms_without_jobs(spark, tmp_path):
    people(spark).write.parquet(f"{tmp_path}/train")
    train = spark.read.parquet(f"{tmp_path}/train")
    test = people(spark, 50)
    plans = {"x": prep.ColumnPlan(imputation="mode"), "c2": prep.ColumnPlan(encoding="target"), "c3": prep.ColumnPlan(encoding="ordinal")}
    wide = lambda df: df.withColumn("c2", F.col("c")).withColumn("c3", F.col("c"))
    plan = prep.Preprocessor(["x", "z"], ["c", "c2", "c3"], "y", encoding="label", plans=plans).fit(wide(train))
    before = sorted(map(tuple, plan.transform(wide(test), keep=["id"]).collect()))
    train.where("c = 'a'").write.mode("append").parquet(f"{tmp_path}/train")
    spark.sparkContext.setJobGroup("transforming", "no job is expected")
    out = plan.assemble(wide(test))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("transforming")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 50
    assert sorted(map(tuple, plan.transform(wide(test), keep=["id"]).collect())) == before


def test_missing_values_stay_missing_in_vectors(spark):
    df = people(spark).withColumn("y", (F.col("x").isNull() | F.isnan("x")).cast("int"))
    plan = prep.Preprocessor(["x", "z"], [], "y", imputation="none", scaling="none").fit(df)
    vectors = plan.assemble(df, keep=["y"])
    values = [r["v"] for r in vectors.where("y = 1").select(vector_to_array("features").alias("v")).collect()]
    assert plan.names() == ["x", "z", "x_missing"] and values and all(math.isnan(v[0]) and not math.isnan(v[1]) and v[2] == 1 for v in values)
    for kind, params in (("rf", {"numTrees": 10, "maxDepth": 3}), ("gbt", {"maxIter": 2, "maxDepth": 2})):
        model = models.Classifier(kind, "y", params=params).fit(vectors)
        assert model.predict(vectors).where("predicted <> y").count() == 0
    with pytest.raises(Exception, match="(?i)nan"):
        models.Classifier("lr", "y").fit(vectors)


def test_exact_sample_and_random_fill_sort_no_more_than_a_slot(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SLOTS", 16)
    df = spark.range(2000)
    want = {r["id"] for r in df.orderBy(unit_hash(["id"], 42), "id").limit(700).collect()}
    out = sampling.exact_sample(df, 700, ["id"])
    assert {r["id"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "TakeOrdered" not in plan and plan.count("SinglePartition") <= 1  # a row for each sorted partition
    assert sampling.exact_sample(df, 0, ["id"]).count() == 0 and sampling.exact_sample(df, 5000, ["id"]).count() == 2000
    marked = df.withColumn("y", (F.col("id") < 100).cast("int"))
    mined = mining.hard_negatives(marked, "y", ["id"], df.select("id", (F.col("id") / 2000).alias("score")), ratio=0.5)
    plan = mined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "TakeOrdered" not in plan and plan.count("SinglePartition") <= 1
    rest = mined.where("origin = 'random'")
    left = {r["id"] for r in df.where("id between 100 and 1879").orderBy(unit_hash(["id"], 42), "id").limit(80).collect()}
    assert {r["id"] for r in rest.collect()} == left
    assert mining.hard_negatives(marked, "y", ["id"], df.select("id", (F.col("id") / 2000).alias("score")), q=0.01).where("origin = 'hard'").count() == 19


def test_trapezoid_has_no_window_over_all_scores(spark):
    rows, df = scored(spark, 400)
    area = curves.pr_trapezoid(df.repartition(3), "y", "p")
    points = sorted({p for *_, p in rows}, reverse=True)
    real = sum(y for _, y, _ in rows)
    pr = [(sum(y for _, y, q in rows if q >= p) / real, sum(y for _, y, q in rows if q >= p) / sum(q >= p for *_, q in rows)) for p in points]
    want = sum((r - r0) * (p + p0) / 2 for (r0, p0), (r, p) in zip([(0, pr[0][1]), *pr], pr, strict=False))
    assert area.first()[0] == pytest.approx(want)
    text = area._jdf.queryExecution().executedPlan().toString()
    assert text.count("SinglePartition") <= 2  # partitions' last rows, and the final sum


def test_pairs_of_a_hot_group_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(models, "PAIR_BLOCK", 40)
    rows = [(i, 1 if i < 200 else i % 30 + 2, i % 5, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g int, rel int, v double")
    got = sorted((r["id_more"], r["id_less"], r["v"]) for r in models.pairs(df, "g", "rel", ["id"], ["v"]).collect())
    assert got == sorted((a[0], b[0], a[3] - b[3]) for a in rows for b in rows if a[1] == b[1] and a[2] > b[2])
    few = models.pairs(df, "g", "rel", ["id"], ["v"], bound=30)
    rows_of = few.select(F.col("id_more").alias("i")).unionByName(few.select(F.col("id_less").alias("i"))).distinct().join(df, F.col("i") == F.col("id"))
    assert 10 < rows_of.where("g = 1").count() < 60 and few.where("g > 1").count() == sum(a[1] == b[1] > 1 and a[2] > b[2] for a in rows for b in rows)


def test_ranks_and_sums_by_group_and_previous_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc") if i % 9 else None, rng.randrange(1000)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(5)
    order = lambda r: (r[1] is not None, r[1] or "", r[2], r[0])
    seen, want = {}, {}
    for i, g, v in sorted(rows, key=order):
        n, s = seen.get(g, (0, 0))
        seen[g] = want[i] = (n + 1, s + v)
    ranks = {r["id"]: r["rank"] for r in global_rank(df, [F.col("v"), F.col("id")], by=["g"]).collect()}
    sums = {r["id"]: r["s"] for r in running_sums(df, [F.col("v"), F.col("id")], {"s": "v"}, ["g"]).collect()}
    assert {i: (ranks[i], sums[i]) for i in ranks} == want
    line = sorted(rows, key=lambda r: (r[2], r[0]))
    before = {r["id"]: r["p"] for r in with_previous(df, [F.col("v"), F.col("id")], {"p": "id"}).collect()}
    assert before == {r[0]: (line[k - 1][0] if k else None) for k, r in enumerate(line)}


def test_rank_scores_learn_from_all_pairs(spark, monkeypatch):
    met, plain = [], models.pairs
    monkeypatch.setattr(models, "pairs", lambda df, *args: met.append((df, plain(df, *args))) or met[-1][1])
    assert catalog.queries()["rank_scores"](spark, "/root/testdata/sf0.001").count()
    df, got = met[0]
    a, b = df.alias("a"), df.alias("b")
    assert got.count() == a.join(b, F.expr("a.customer_id = b.customer_id and a.n_lines > b.n_lines")).count() > 0


@pytest.mark.parametrize("encoding", ["one_hot", "label", "ordinal", "target", "native"])
def test_preprocessor_round_trip_and_unseen_levels(spark, encoding):
    df = people(spark)
    plan = prep.Preprocessor(["x", "z", "flat"], ["c"], "y", ["b"], encoding=encoding, plans={"z": prep.ColumnPlan(scaling="minmax")}).fit(df.where("c != 'd' or c is null"))
    out = plan.transform(df, keep=["id"])
    assert out.columns == ["id", *plan.names()]
    assert all(v is not None and not math.isnan(v) for r in out.drop("id").collect() for v in r)
    path = scratch_path(spark, "prep")
    plan.save(spark, path)
    again = prep.Preprocessor.load(spark, path).transform(df, keep=["id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert len(plan.assemble(df).first()["features"]) == len(plan.names())


def test_preprocessor_statistics_and_policies(spark):
    df = people(spark)
    every = {"mean", "sd", "min", "max", "median", "q25", "q75", "mode"}
    stats = prep.numeric_stats(df, {"x": every, "z": every, "void": every, "flat": {"median", "mode"}})
    z, x = ([r[c] for r in df.collect() if r[c] is not None and not math.isnan(r[c])] for c in "zx")
    for c, values in (("z", z), ("x", x)):
        want = {"median": np.median(values), "q25": np.quantile(values, 0.25), "q75": np.quantile(values, 0.75), "sd": np.std(values, ddof=1), "mean": np.mean(values)}
        assert {s: stats[c][s] for s in want} == pytest.approx(want)
        assert stats[c]["mode"] == min(values, key=lambda v, own=values: (-own.count(v), v))
    assert stats["x"]["missing"] == 300 - len(x)
    assert {stats["void"][s] for s in every} == {None} and stats["flat"] == {"median": 7.0, "mode": 7.0, "missing": 0}
    rough = prep.numeric_stats(df, {"z": {"median"}}, approximate=True)
    assert abs(rough["z"]["median"] - np.median(z)) < 0.2
    scaled = prep.Preprocessor(["z"], []).fit(df).transform(df).agg(F.avg("z"), F.stddev("z")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)
    levels = prep.category_levels(df.where("c != 'd'"), ["c"])
    assert prep.encode_index(df, "c", levels, unknown="skip").count() == df.where("c != 'd'").count()
    assert prep.encode_index(df.where("c = 'd'"), "c", levels, unknown="keep").first()["c_index"] == 3
    with pytest.raises(Exception, match="unknown level of c"):
        prep.encode_index(df, "c", levels, unknown="error").collect()
    with pytest.raises(ValueError):
        prep.imputed(F.col("x"), "other", {})


def test_pca_is_centred_with_fixed_signs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [5, 1, 0.1] + [100, 0, 0]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    vectors = prep.Preprocessor(["a", "b", "c"], [], scaling="none").fit(df).assemble(df, keep=["id"])
    got = np.array([r["v"] for r in prep.pca(vectors, 9, keep=["id"]).orderBy("id").select(vector_to_array("components").alias("v")).collect()])
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    assert got.shape == (200, 3)
    assert np.abs(got) == pytest.approx(np.abs(centred @ axes.T), abs=1e-6)
    assert np.corrcoef(got[:, 0], x[:, 0])[0, 1] > 0.99


def test_models_find_a_planted_signal(spark):
    df = people(spark, 400).withColumn("y", (F.col("z") > 6).cast("int"))
    for kind, params in (("mlp", {"hidden": [4], "maxIter": 60}), ("lr", {}), ("rf", {"numTrees": 5, "maxDepth": 3}), ("gbt", {"maxIter": 3, "maxDepth": 2})):
        pipeline = experiments.quick_train(df, ["x", "z"], ["c"], "y", kind, ["id"], **params)
        out = pipeline.predict(df)
        assert curves.auc(out, "y", "p1").first()["auc_roc"] > 0.9
        assert kind == "mlp" or pipeline.classifier.importances(spark).first()["feature"] == "z"
        assert pipeline.classifier.training_history(spark).count() == sum(map(len, pipeline.classifier.history.values())) > 0 or kind == "rf"
        assert kind != "lr" or {r["name"] for r in pipeline.classifier.report(spark).collect()} == {"intercept", "iterations", "train_auc", "train_accuracy"}
        assert pipeline.predict(df.drop("y")).count() == 400
    pipeline.tune_threshold(df, "youden")
    path = scratch_path(spark, "model")
    pipeline.save(spark, path)
    back = experiments.Pipeline.load(spark, path)
    same = ("threshold", "weight", "params", "history", "names", "facts")
    assert [getattr(back.classifier, k) for k in same] == [getattr(pipeline.classifier, k) for k in same]
    assert sorted(map(tuple, back.predict(df).select("id", "p1", "predicted").collect())) == sorted(map(tuple, pipeline.predict(df).select("id", "p1", "predicted").collect()))
    with pytest.raises(ValueError):
        pipeline.classifier.set_threshold(1.5)


def test_ranker_orders_groups(spark):
    rng = random.Random(7)
    rows = [(i, i % 30, rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame([(*r, int(r[2] * 4)) for r in rows], "id long, g int, a double, b double, rel int")
    ranker = models.LinearRanker("g", "rel", ["id"], ["a", "b"]).fit(df)
    assert metrics.ndcg(ranker.predict(df), "g", "rel", "score", ["id"]).agg(F.avg("ndcg")).first()[0] > 0.95


def test_experiments_log_and_leaderboard(spark):
    df = people(spark, 400).withColumn("y", (F.col("z") > 6).cast("int")).withColumn("year", (F.col("id") % 4).cast("int"))
    data = {"train": (0, 2), "valid": (2, 3), "test": (3, 4)}
    runs = [{"name": "r", "data": data, "prep": {"numeric": ["x", "z"], "categorical": []}, "sampling": {"tune": {"strategy": "random", "fraction": 0.9}}, "weight_cap": 10.0}]
    table = experiments.run_experiments(df, "y", ["id"], runs, [{"regParam": 0.01}, {"regParam": 1.0}])
    path = scratch_path(spark, "runs")
    experiments.log_runs(table, path)
    experiments.log_runs(table.where("run_name like '%1.0'"), path)
    assert experiments.read_runs(spark, path).exceptAll(table).isEmpty() and experiments.read_runs(spark, path).count() == table.count()
    board = experiments.leaderboard(table).collect()
    assert [r["place"] for r in board] == [1, 2] and board[0]["value"] > 0.9
    keys = {r["key"] for r in table.collect()}
    assert {"sampling_strategy", "sampling_fraction", "weight_cap", "threshold", "override_regParam", "train_f1", "valid_auc_roc", "test_brier"} <= keys


def test_a_grid_fits_its_preprocessing_once_and_goes_on_from_its_log(spark, monkeypatch):
    df = people(spark, 200).withColumn("y", (F.col("z") > 6).cast("int")).withColumn("year", (F.col("id") % 3).cast("int"))
    runs = [{"name": "r", "data": {"train": (0, 2), "test": (2, 3)}, "prep": {"numeric": ["x", "z"], "categorical": []}}]
    fits, models_fitted = [], []
    fit_prep, fit_model = prep.Preprocessor.fit, models.Classifier.fit
    monkeypatch.setattr(prep.Preprocessor, "fit", lambda self, x: (fits.append(1), fit_prep(self, x))[1])
    monkeypatch.setattr(models.Classifier, "fit", lambda self, *x: (models_fitted.append(1), fit_model(self, *x))[1])
    path = scratch_path(spark, "runs")
    first = experiments.run_experiments(df, "y", ["id"], runs, [{"regParam": 0.01}, {"regParam": 1.0}], log=path)
    assert len(fits) == 1 and len(models_fitted) == 2 and first.select("run_name").distinct().count() == 2
    again = experiments.run_experiments(df, "y", ["id"], runs, [{"regParam": 0.01}, {"regParam": 1.0}, {"regParam": 0.1}], log=path)
    assert len(models_fitted) == 3 and again.groupBy("run_name", "kind", "key").count().agg({"count": "max"}).first()[0] == 1
    assert again.select("run_name").distinct().count() == 3


def test_sources(spark, tmp_path):
    df = spark.range(100).withColumn("s", F.lit("x"))
    df.write.parquet(f"{tmp_path}/a")
    df.write.option("header", "true").csv(f"{tmp_path}/b")
    assert Source("a", "parquet", [f"{tmp_path}/a"], where="id >= 90").load(spark).count() == 10
    assert Source("a", "parquet", [f"{tmp_path}/a", f"{tmp_path}/a"]).load(spark).count() == 200
    assert Source("b", "csv", [f"{tmp_path}/b"]).load(spark).dtypes == [("id", "int"), ("s", "string")]
    df.write.mode("overwrite").saveAsTable("default.some_rows")
    for name in ("some_rows", "default.some_rows", "spark_catalog.default.some_rows"):
        assert Source("t", "table", [name], where="id < 7").load(spark).count() == 7
    assert Source("f", "frame", frame=df, where="id < 0").load(spark).count() == 100
    for fraction, n in ((None, 100), (0, 100), (1.5, 100)):
        assert Source("a", "parquet", [f"{tmp_path}/a"], fraction=fraction).load(spark).count() == n
    sampled = Source("a", "parquet", [f"{tmp_path}/a"], fraction=0.3, keys=["id"])
    assert sampled.load(spark).count() == df.where(unit_hash(["id"], 42) < 0.3).count()
    assert sampled.cache(spark).is_cached and sampled.describe(spark).first()["cached"]
    sampled.unpersist()
    registry = Registry.from_dicts({"a": {"kind": "parquet", "paths": [f"{tmp_path}/a"]}})
    registry.load(spark, "a")
    assert spark.sql("select count(*) from a").first()[0] == 100 and registry.names() == ["a"]
    with pytest.raises(KeyError):
        registry.get("b")
    with pytest.raises(ValueError):
        Source("x", "other", ["p"])
    with pytest.raises(Exception, match="(?i)delta"):
        Source("d", "delta", [f"{tmp_path}/a"], options={"versionAsOf": "1"}).load(spark)
    assert limited_handoff(df, ["id"], 5).count() == 5
    assert limited_handoff(df, ["id"], 5, fraction=0.5).count() == df.where(unit_hash(["id"], 42) < 0.5).count()


def test_a_filter_reaches_the_scan(spark):
    source = Source("orders", "parquet", ["/root/testdata/sf0.001/orders.parquet"], where="o_totalprice > 1000")
    plan = source.load(spark).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderdate" not in plan


def test_scoring_a_stream(spark, tmp_path):
    from panelspark.streaming.scoring import score_stream

    df = people(spark, 100)
    pipeline = experiments.quick_train(df, ["x", "z"], ["c"], "y", "lr", ["id"])
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    score_stream(stream, pipeline, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100


def test_a_grid_makes_its_rows_once_and_reads_only_its_columns(spark, monkeypatch):
    """Two runs of three splits read one written copy, which is gone at the end; samplings that may read any column get all."""
    df = people(spark, 200).withColumn("y", (F.col("z") > 6).cast("int")).withColumn("year", (F.col("id") % 3).cast("int")).withColumn("unused", F.lit("u"))
    one = {"data": {"train": (0, 1), "valid": (1, 2), "test": (2, 3)}, "prep": {"numeric": ["x", "z"], "categorical": []}}
    runs = [{"name": "a", **one}, {"name": "b", "sampling": {"tune": {"strategy": "random", "fraction": 0.9}}, **one}]
    seen, gone, split, drop = [], [], experiments.time_split, experiments.discard
    monkeypatch.setattr(experiments, "time_split", lambda x, *rest: seen.append((x.columns, {f.rsplit("/", 1)[0] for f in x.inputFiles()})) or split(x, *rest))
    monkeypatch.setattr(experiments, "discard", lambda *x: gone.extend(x) or drop(*x))
    table = experiments.run_experiments(df, "y", ["id"], runs)
    assert len(seen) == 2 and seen[0] == seen[1] and sorted(seen[0][0]) == ["id", "x", "y", "year", "z"] and len(seen[0][1]) == len(gone) == 1
    assert {(r["run_name"], r["key"]) for r in table.collect()} >= {(n, f"{p}_auc_roc") for n in "ab" for p in ("train", "valid", "test")}
    assert experiments._read(df, "y", ["id"], [{"name": "c", "sampling": {"tune": {"strategy": "hard_negative"}}, **one}], "tune") == df.columns
