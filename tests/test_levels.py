"""One-hot columns of many levels: names and coefficients stay in tables."""

from __future__ import annotations

import math

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelspark.operators import levels, prep
from panelspark.operators.levels import LevelRegression
from panelspark.plans import catalog


def rows(spark, n=400):
    return spark.range(n).selectExpr("id", "concat('a', cast(id * id % 23 as string)) as a", "concat('b', cast(id % 7 as string)) as b", "cast(1 + id % 3 as double) as w", "cast((id * 7919 % 101 < 20 + 10 * (id % 7)) as int) as y")


def test_wide_one_hot_collects_no_names_or_coefficients(spark, monkeypatch):
    """The driver's rows don't follow the number of features, and no schema names them."""
    got, first = [], LogisticRegression.fit
    frame = type(spark.range(1))
    plain = frame.collect

    def collect(self):
        found = plain(self)
        got.append(len(found))
        return found

    def fit(self, df, *more):
        got.append(len(df.first()[self.getFeaturesCol()]))
        return first(self, df, *more)

    monkeypatch.setattr(prep, "MOST_NAMES", 100, raising=False)
    monkeypatch.setattr(frame, "collect", collect)
    monkeypatch.setattr(LogisticRegression, "fit", fit)
    row = catalog.queries()["wide_one_hot"](spark, "/root/testdata/sf0.001").first()
    assert row["features"] > 1000 and row["good"]
    assert max(got) <= 100


def test_unnamed_levels_have_places_and_a_count(spark, monkeypatch):
    monkeypatch.setattr(prep, "MOST_NAMES", 10)
    df = rows(spark)
    plan = prep.Preprocessor([], ["a", "b"], "y", max_one_hot=None).fit(df)
    full = prep.Preprocessor([], ["a", "b"], "y").fit(df)
    assert set(plan.hot) == {"b"} and plan.n_features() == full.n_features() == len(full.names())
    for call in (plan.names, lambda: plan.transform(df), lambda: plan.assemble(df)):
        with pytest.raises(ValueError, match="too many levels"):
            call()
    unseen = df.withColumn("a", F.when(F.col("id") % 2 == 0, F.lit("new")).otherwise(F.col("a")))
    places = {r["id"]: [r["a_place"], r["b_place"]] for r in plan.places(unseen, keep=["id"]).collect()}
    vectors = {r["id"]: r["v"] for r in full.assemble(unseen, keep=["id"]).select("id", vector_to_array("features").alias("v")).collect()}
    width = full.sizes["a"]
    for i, v in vectors.items():
        ones = {k for k, x in enumerate(v) if x}
        a, b = places[i]
        assert ones == ({a} if a is not None else set()) | {width + b}
        assert (a is None) == (i % 2 == 0)


@pytest.mark.parametrize(("columns", "weight"), [(["a"], None), (["a", "b"], "w")])
def test_it_finds_the_regression_of_pyspark(spark, columns, weight, monkeypatch):
    monkeypatch.setattr(levels, "MOST_BROADCAST", 10)
    df = rows(spark).withColumn("a", F.when(F.col("id") % 10 > 0, F.col("a")))
    plan = prep.Preprocessor([], columns, "y", categorical_imputation="level").fit(df.where("a is not null"))
    more = {"weightCol": weight} if weight else {}
    want = LogisticRegression(labelCol="y", maxIter=500, regParam=0.1, tol=1e-12, **more).fit(plan.assemble(df, keep=["y", "w"]))
    model = LevelRegression("y", [f"{c}_place" for c in columns], weight, {"maxIter": 20, "regParam": 0.1, "tol": 1e-9})
    model.fit(plan.places(df, keep=["y", "w"]))
    got = [r["value"] for c in columns for r in model.coefficients[f"{c}_place"].orderBy("level").collect()]
    assert got == pytest.approx(want.coefficients.toArray().tolist(), abs=5e-3)
    assert model.intercept == pytest.approx(want.intercept, abs=5e-3)
    assert model.history[-1] == pytest.approx(want.summary.objectiveHistory[-1], abs=1e-7)
    assert all(b <= a + 1e-12 for a, b in zip(model.history, model.history[1:], strict=False))
    # Levels that it never saw add nothing.
    other = spark.createDataFrame([(None, None), (999, 999)], "a_place int, b_place int")
    assert [r["p1"] for r in model.predict(other).collect()] == pytest.approx([1 / (1 + math.exp(-model.intercept))] * 2)


def test_pure_levels_rare_classes_and_odd_labels(spark):
    df = spark.range(2000).selectExpr("cast(id % 500 as int) as k", "cast(id % 500 = 7 as int) as y", "cast(1 as int) as one")
    model = LevelRegression("y", ["k"], params={"maxIter": 10, "regParam": 1e-4}).fit(df)
    assert model.predict(df).where("predicted != y").isEmpty() and len(model.history) <= 10
    flat = LevelRegression("y", ["one"]).fit(df)
    assert flat.coefficients["one"].first()["value"] == 0 and flat.intercept == pytest.approx(math.log(4 / 1996))
    for value in (0, 1):
        same = LevelRegression("y", ["k", "one"]).fit(df.withColumn("y", F.lit(value)))
        assert {r["predicted"] for r in same.predict(df).collect()} == {value}
    for bad in (df.withColumn("y", F.lit(2)), df.withColumn("y", F.lit(None).cast("int")), df.limit(0)):
        with pytest.raises(ValueError, match="labels"):
            LevelRegression("y", ["k"]).fit(bad)
