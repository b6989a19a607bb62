"""A ranker of boosted regression trees on pairwise gradients, without a table of pairs.

The loss of a group is that of all its pairs of different relevance.  Rows of a group that share
relevance and score have one gradient, so that it is computed between the counts of such levels:
scores are put into equal bins over their whole range, and a group gives a row for each relevance and bin
that it has, whatever its size.  A batch of groups is computed at once: most groups have a few levels.  A tree is fitted to gradient over curvature, weighted by curvature,
which makes its leaves Newton steps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.ranking import discard, stored

#: Bins of scores, and rounds after which scores are written.
BINS, WRITTEN = 128, 8
#: Groups of up to so many levels are computed side by side, about so many pairs of levels at once.
SMALL, AT_ONCE = 64, 1 << 20
#: Partitions of the groups for each core: levels are few bytes, and would be left to few tasks.
SPREAD = 4


def pair_gradients(grades: np.ndarray, bins: np.ndarray, counts: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the pairwise logistic loss for each level of one group.

    Level i has ``counts[i]`` rows of relevance ``grades[i]`` in bin ``bins[i]``, whose rows score ``scores``
    at that bin.
    """
    order = np.unique(grades)
    table = np.zeros((len(order), len(scores)))
    np.add.at(table, (np.searchsorted(order, grades), bins), counts)
    less = np.cumsum(table, 0) - table
    more = table.sum(0) - less - table
    chance = 1 / (1 + np.exp(np.clip(scores[:, None] - scores[None, :], -500, 500)))  # that i is placed behind j
    grade = np.searchsorted(order, grades)
    behind, ahead = chance[bins], chance.T[bins]
    gradient = (less[grade] * behind).sum(1) - (more[grade] * ahead).sum(1)
    curvature = ((less[grade] + more[grade]) * behind * ahead).sum(1)
    return gradient, curvature


def many_gradients(sizes: np.ndarray, grades: np.ndarray, bins: np.ndarray, counts: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pair_gradients`` of many groups, whose levels follow one another, ``sizes`` of them in each."""
    ends = np.cumsum(sizes)
    gradient, curvature = np.zeros(len(grades)), np.zeros(len(grades))
    for k in np.flatnonzero(sizes > SMALL):
        at = slice(ends[k] - sizes[k], ends[k])
        gradient[at], curvature[at] = pair_gradients(grades[at], bins[at], counts[at], scores)
    chance = 1 / (1 + np.exp(np.clip(scores[:, None] - scores[None, :], -500, 500)))
    few = np.flatnonzero(sizes <= SMALL)
    parts = np.cumsum(sizes[few].astype(np.int64) ** 2) // AT_ONCE
    for own in np.split(few, np.flatnonzero(np.diff(parts)) + 1):
        size, start = sizes[own], ends[own] - sizes[own]
        width, first = np.repeat(size, size), np.repeat(start, size)
        level = np.arange(len(width)) - np.repeat(np.cumsum(size) - size, size) + first
        i = np.repeat(level, width)
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
        behind, ahead = chance[bins[i], bins[j]], chance[bins[j], bins[i]]
        more, other = grades[i] > grades[j], grades[i] != grades[j]
        slot = np.repeat(np.arange(len(level)), width)
        gradient[level] = np.bincount(slot, counts[j] * other * np.where(more, behind, -ahead), len(level))
        curvature[level] = np.bincount(slot, counts[j] * other * behind * ahead, len(level))
    return gradient, curvature


@dataclass
class BoostedRanker:
    """Scores that order the rows of a group by relevance; null relevance counts as 0, missing values as
    lower than all others."""

    group: str
    relevance: str
    values: list[str]
    rounds: int = 30
    depth: int = 4
    rate: float = 0.3
    seed: int = 42
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)

    def _vectors(self, df: DataFrame, keep: list) -> DataFrame:
        numbers = [F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(None)), F.lit(-1e30)).alias(f"__v{k}") for k, v in enumerate(self.values)]
        return VectorAssembler(inputCols=[f"__v{k}" for k in range(len(numbers))], outputCol="__features").transform(df.select(*keep, *numbers)).drop(*[f"__v{k}" for k in range(len(numbers))])

    def fit(self, df: DataFrame) -> BoostedRanker:
        keep = [F.col(self.group).alias("g"), F.coalesce(F.col(self.relevance).cast("double"), F.lit(0.0)).alias("r"), F.lit(0.0).alias("score")]
        rows, self.trees = stored(self._vectors(df, keep), "ranker-rows"), []
        written = rows
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        for k in range(self.rounds):
            low, high = rows.agg(F.min("score"), F.max("score")).first()
            if low is None:
                break
            targets, gradients = self._targets(rows, low, high)
            targets = targets.persist(StorageLevel.MEMORY_AND_DISK)  # a fit reads them several times
            tree = DecisionTreeRegressor(featuresCol="__features", labelCol="__target", weightCol="__h", predictionCol="__step", maxDepth=self.depth, seed=self.seed)
            self.trees.append(tree.fit(targets))
            targets.unpersist()
            discard(gradients)
            before = rows
            if k + 1 == self.rounds:
                break
            rows = self.trees[-1].transform(rows).select("g", "r", (F.col("score") + self.rate * F.col("__step")).alias("score"), "__features")
            if (k + 1) % WRITTEN == 0:
                old, rows = written, stored(rows, "ranker-rows")
                written = rows
                before.unpersist()
                discard(old)
                rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
            else:
                rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
                rows.count()
                before.unpersist()
        rows.unpersist()
        discard(written)
        return self

    def _targets(self, rows: DataFrame, low: float, high: float) -> tuple[DataFrame, DataFrame]:
        """``(__features, __target, __h)`` of the rows whose groups have another relevance, and the stored
        gradients that this reads."""
        width = (high - low) / BINS
        at = F.lit(0) if width <= 0 else F.least(F.floor((F.col("score") - low) / width), F.lit(BINS - 1)).cast("int")
        scores = low + width * (np.arange(BINS) + 0.5)
        binned = rows.withColumn("bin", at)
        levels = binned.groupBy("g", "r", "bin").agg(F.count("*").alias("n"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("levels")
                sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
                r, b, n = (flat.field(c).to_numpy() for c in ("r", "bin", "n"))
                gradient, curvature = many_gradients(sizes, r, b, n, scores)
                g = batch.column("g").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([g, flat.field("r"), flat.field("bin"), pa.array(gradient), pa.array(curvature)], names=["g", "r", "bin", "d", "h"])

        schema = T.StructType([rows.schema["g"], T.StructField("r", T.DoubleType()), T.StructField("bin", T.IntegerType()), T.StructField("d", T.DoubleType()), T.StructField("h", T.DoubleType())])
        gradients = stored(levels.repartition(SPREAD * rows.sparkSession.sparkContext.defaultParallelism, "g").groupBy("g").agg(F.collect_list(F.struct("r", "bin", "n")).alias("levels")).mapInArrow(run, schema), "ranker-gradients")
        found = gradients.where("h > 0").select(F.col("g").alias("__g"), F.col("r").alias("__r"), F.col("bin").alias("__b"), "d", "h")
        met = binned.join(found, F.col("g").eqNullSafe(F.col("__g")) & (F.col("r") == F.col("__r")) & (F.col("bin") == F.col("__b")))
        return met.select("__features", (F.col("d") / F.col("h")).alias("__target"), F.col("h").alias("__h")), gradients

    def predict(self, df: DataFrame, score: str = "score") -> DataFrame:
        out = self._vectors(df, [F.struct(*df.columns).alias("__row")]).withColumn("__score", F.lit(0.0))
        for tree in self.trees:
            out = tree.transform(out).select("__row", "__features", (F.col("__score") + self.rate * F.col("__step")).alias("__score"))
        return out.select("__row.*", F.col("__score").alias(score))

    def save(self, spark: SparkSession, path: str) -> None:
        facts = json.dumps({k: v for k, v in self.__dict__.items() if k != "trees"} | {"n": len(self.trees)})
        spark.createDataFrame([(facts,)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")
        for k, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree-{k}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedRanker:
        facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
        n = facts.pop("n")
        return cls(**facts, trees=[DecisionTreeRegressionModel.load(f"{path}/tree-{k}") for k in range(n)])
