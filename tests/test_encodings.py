from __future__ import annotations

import math

import pytest
from pyspark.ml.functions import vector_to_array

from panelspark.operators import experiments, models, prep
from panelspark.sources.scratch import scratch_path

ENCODINGS = ("label", "ordinal", "native", "one_hot", "target")


@pytest.fixture(scope="module")
def frames(spark):
    seen = spark.createDataFrame([(k, "abc"[k % 3], k % 2, float(k)) for k in range(60)] + [(60, "a", 1, None)], "id long, c string, y int, x double")
    return seen, spark.createDataFrame([(1, "a", 1, 1.0), (2, "z", 0, 2.0), (3, None, 0, None)], seen.schema)


@pytest.mark.parametrize("encoding", ENCODINGS)
def test_policies_of_unknown_levels(spark, frames, encoding):
    seen, other = frames
    plan = prep.Preprocessor([], ["c"], "y", encoding=encoding).fit(seen)
    rate = 31 / 61
    kept = {"label": [3.0], "ordinal": [-1.0], "native": [3.0], "one_hot": [0.0, 0.0, 0.0], "target": [pytest.approx(rate)]}[encoding]
    for way in ("transform", "assemble"):

        def rows(policy, way=way):
            plan.unknown = policy
            if way == "transform":
                return {r[0]: [float(x) for x in r[1:]] for r in plan.transform(other, keep=["id"]).collect()}
            return {r[0]: r[1] for r in plan.assemble(other, keep=["id"]).select("id", vector_to_array("features")).collect()}

        got = rows("keep")
        assert got[2] == kept and got[3] == kept and got[1] != kept
        assert set(rows("skip")) == {1}
        with pytest.raises(Exception, match="unknown level of c"):
            rows("error")
        if encoding != "native":
            assert rows("minus")[2] == ([-1.0] if encoding in ("label", "ordinal") else kept)


def test_a_native_category_has_no_number_below_zero(frames):
    with pytest.raises(ValueError, match="minus"):
        prep.Preprocessor([], ["c"], "y", encoding="native", unknown="minus").fit(frames[0])


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_trees_split_native_categories(spark, kind):
    """Levels whose classes alternate need one split of a category, seven of a number; 40 levels need bins."""
    for levels in (8, 40):
        df = spark.createDataFrame([(k, f"l{k % levels:02}", (k % levels) % 2, None if k % 3 else 1.0) for k in range(8 * levels)], "id long, c string, y int, x double")
        params = {"maxDepth": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", **({"numTrees": 1, "bootstrap": False} if kind == "rf" else {"maxIter": 2})}
        pipeline = experiments.Pipeline(prep.Preprocessor(["x"], ["c"], "y", encoding="native", imputation="none", scaling="none"), models.Classifier(kind, "y", params=params), ["id"]).fit(df)
        assert pipeline.predict(df).where("predicted != y").isEmpty()
        unseen = df.limit(1).selectExpr("id", "'new' as c", "y", "x")
        assert pipeline.predict(unseen).count() == 1
        path = scratch_path(spark, "native")
        pipeline.save(spark, path)
        assert experiments.Pipeline.load(spark, path).predict(df).where("predicted != y").isEmpty()


def test_wide_one_hot_is_sparse(spark):
    df = spark.range(3000).selectExpr("id", "cast(id as string) as c", "cast(id % 2 as int) as y", "cast(id as double) as x")
    plan = prep.Preprocessor(["x"], ["c"], "y").fit(df)
    with pytest.raises(ValueError, match="max_columns"):
        plan.transform(df)
    vectors = plan.assemble(df, keep=["y"])
    assert len(plan.names()) == 3001 and vectors.schema["features"].metadata["ml_attr"] == {"num_attrs": 3001}
    first = vectors.first()["features"]
    assert first.size == 3001 and len(first.indices) <= 2
    model = models.Classifier("lr", "y", params={"maxIter": 5, "regParam": 1e-4}).fit(vectors)
    assert model.predict(vectors).where("predicted != y").isEmpty()


def test_vectors_equal_columns(spark, frames):
    """A dense and a sparse way, few and many levels, give the same numbers."""
    seen, other = frames
    for few in (64, 1):
        prep.FEW_LEVELS, before = few, prep.FEW_LEVELS
        try:
            plan = prep.Preprocessor(["x"], ["c"], "y", boolean=["y"], imputation="none", plans={}).fit(seen)
            columns = {r[0]: [float("nan") if x is None else float(x) for x in r[1:]] for r in plan.transform(other, keep=["id"]).collect()}
            vectors = {r[0]: r[1] for r in plan.assemble(other, keep=["id"]).select("id", vector_to_array("features")).collect()}
        finally:
            prep.FEW_LEVELS = before
        for i in columns:
            assert [str(x) for x in columns[i]] == [str(x) for x in vectors[i]]
        assert math.isnan(vectors[3][0]) and len(plan.names()) == len(vectors[3])


def test_dtype_overrides_move_columns(spark, frames):
    seen, _ = frames
    plans = {"x": prep.ColumnPlan(dtype="categorical", encoding="label"), "c": prep.ColumnPlan(dtype="categorical"), "y": prep.ColumnPlan(dtype="boolean")}
    plan = prep.Preprocessor(["x", "y"], ["c"], plans=plans).fit(seen)
    assert plan.names() == ["y", "c=a", "c=b", "c=c", "x_index"]
    assert plan.transform(seen).count() == 61
    with pytest.raises(ValueError, match="dtype"):
        prep.Preprocessor(["x"], [], plans={"x": prep.ColumnPlan(dtype="date")})
