"""Hard-negative mining from a table of scores."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.expressions import entropy, margin, min_max, positive_probability
from panelspark.functions.hashing import unit_hash
from panelspark.functions.ranking import discard, global_rank, stored
from panelspark.functions.selection import numbers, smallest, values_at
from panelspark.operators.sampling import class_counts, negatives_wanted, random_fraction, undersample


def hardness(method: str, score: Column) -> Column:
    """The sort key of a method: the hardest first when ascending."""
    keys = {"top_prob": lambda: -score, "margin": lambda: margin(score), "entropy": lambda: -entropy(score)}
    if method not in keys:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(keys)}")
    return keys[method]()


def with_scores(df: DataFrame, scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Left join; repeated keys of ``scores`` count once with their maximum, missing ones as 0."""
    best = scores.groupBy(*keys).agg(F.max(score).alias(score))
    return df.join(best, keys, "left").withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))


def normalised(scores: DataFrame, score: str = "score") -> DataFrame:
    """Scores moved to [0, 1] by their range, a one-row table that is broadcast."""
    ends = scores.agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    return scores.join(F.broadcast(ends)).withColumn(score, min_max(F.col(score), F.col("__low"), F.col("__high"))).drop("__low", "__high")


def mining_order(df: DataFrame, keys: list[str], method: str, score: str = "score", seed: int = 42, name: str = "rank") -> DataFrame:
    """Rank by hardness; ties by key hash, then key."""
    ranked = df.withColumn("__hard", F.round(hardness(method, F.col(score)), 12)).withColumn("__u", unit_hash(keys, seed))
    return global_rank(ranked, [F.col("__hard"), F.col("__u"), *map(F.col, keys)], name).drop("__hard", "__u")


def hard_negatives(
    df: DataFrame,
    label: str,
    keys: list[str],
    scores: DataFrame,
    ratio: float | None = None,
    hard_fraction: float = 0.6,
    method: str = "top_prob",
    score: str = "score",
    seed: int = 42,
    floor: int = 100,
    n_hard: int | None = None,
    hard_per_pos: float | None = None,
    q: float | None = None,
) -> DataFrame:
    """All positives, the hardest negatives, and a random rest; ``origin`` says which.

    As many negatives as undersampling takes, at most all; ``hard_fraction`` of them (or ``n_hard``,
    or ``hard_per_pos`` for each positive) by hardness, the others by key hash among what is left.
    ``q`` limits the hard ones to that part of all negatives, rounded up.  Nothing is sorted: the last
    hard negative, and the last of the random ones, are found by selection, and a filter on hardness,
    hash and key takes those up to it.  Keys should name a row: rows that repeat the last one's are all
    taken.
    """
    row = class_counts(df, label).first()
    if n_hard is None and hard_per_pos is not None:
        n_hard = int(hard_per_pos * row["n_pos"])
    target = min(negatives_wanted(row["n_pos"], ratio, floor), row["n_neg"])
    hard = min(int(target * hard_fraction) if n_hard is None else n_hard, row["n_neg"])
    if q is not None:
        hard = min(hard, math.ceil(q * row["n_neg"]))
    facts = [F.round(hardness(method, F.col(score)), 12).alias("__hard"), unit_hash(keys, seed).alias("__u")]
    table = stored(with_scores(df.where(F.col(label) == 0).select(*keys), scores, keys, score).select(*keys, *facts), "hardness")
    # No score comes last, as a score above all others in hardness would.
    narrow = table.withColumn("__hard", F.coalesce(F.nanvl("__hard", F.lit(None)), F.lit(math.inf)))
    nobody = F.lit(False)
    is_hard = smallest(narrow, ["__hard", "__u"], keys, hard)
    is_hard = nobody if is_hard is None else is_hard
    is_random = smallest(narrow.where(~is_hard), ["__u"], keys, target - hard)
    discard(table)
    joined = with_scores(df.where(F.col(label).isin(0, 1)), scores, keys, score).select("*", *facts)
    joined = joined.withColumn("__hard", F.coalesce(F.nanvl("__hard", F.lit(None)), F.lit(math.inf)))
    origin = F.when(F.col(label) == 1, "positive").when(is_hard, "hard").when(nobody if is_random is None else is_random, "random")
    return joined.withColumn("origin", origin).where("origin is not null").drop("__hard", "__u")


def hard_summary(mined: DataFrame, score: str = "score") -> DataFrame:
    """Count and mean, least and greatest score of each origin."""
    return mined.groupBy("origin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def above_percentile(df: DataFrame, label: str, quantile: float = 0.8, score: str = "score", accuracy: int | None = None) -> DataFrame:
    """All positives, and the negatives that score at or above a quantile of the negatives: the least
    score that at least that part of them don't exceed.  ``accuracy`` takes a sketch instead."""
    negatives = df.where(F.col(label) == 0)
    if accuracy:
        cut = negatives.agg(F.percentile_approx(score, quantile, accuracy)).first()[0]
    else:
        table = numbers(negatives, {"score": F.col(score)})
        n = table.agg(F.count("score")).first()[0]
        place = max(0, math.ceil(quantile * n) - 1)
        cut = values_at(table, [("score", place)], {"score": n})["score", place][0] if n else None
        discard(table)
    return df.where((F.col(label) == 1) | (F.col(score) >= F.lit(cut)))


def baseline_scores(df: DataFrame, label: str, keys: list[str], features: list[str], estimator: Callable | None = None, ratio: float = 0.5, subsample: float | None = None, seed: int = 42) -> DataFrame:
    """Scores of all rows by a cheap model, fitted on an undersampled part.

    ``estimator(label_col)`` returns a ``pyspark.ml`` estimator on ``features``; logistic regression
    by default.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    part = undersample(vectors, label, keys, ratio, seed)
    if subsample:
        part = random_fraction(part, subsample, keys, seed + 2)
    model = (estimator(label) if estimator else LogisticRegression(labelCol=label, maxIter=50)).fit(part)
    return model.transform(vectors).select(*keys, positive_probability().alias("score"))


def mine(df: DataFrame, label: str, keys: list[str], scores: DataFrame | None = None, features: list[str] | None = None, **options) -> DataFrame:
    """Hard negatives from given scores, or from those of a baseline model on ``features``."""
    if scores is None:
        if not features:
            raise ValueError("mining needs scores or features")
        scores = baseline_scores(df, label, keys, features)
    return hard_negatives(df, label, keys, scores, **options).select(*df.columns)
