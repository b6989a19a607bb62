"""Exact ROC and precision-recall curves over distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ranking import running_sums, with_previous


def rated(df: DataFrame, label: str, score: str) -> DataFrame:
    """The rows that curves and metrics count: those with a label and a score that is a number."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, n, pos)``: rows and positives at each distinct score; rows without a label or a score
    (null, NaN) are left out."""
    return rated(df, label, score).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, n, pos, pp, tp, p_all, n_all)``, scores descending: pp rows and tp positives
    score at least the threshold; of p_all positives and n_all negatives."""
    groups = running_sums(score_groups(df, label, score), [F.col("threshold").desc()], {"pp": "n", "tp": "pos"})
    ends = groups.agg(F.sum("pos").alias("p_all"), (F.sum("n") - F.sum("pos")).alias("n_all"))
    return groups.join(F.broadcast(ends))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, fpr, tpr)`` with a start row at infinity; null rates without a class."""
    points = curve(df, label, score)
    start = points.select("p_all", "n_all").limit(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    rates = points.select("threshold", F.try_divide(F.col("pp") - F.col("tp"), F.col("n_all")).alias("fpr"), F.try_divide(F.col("tp"), F.col("p_all")).alias("tpr"))
    return start.unionByName(rates)


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, precision, recall)``."""
    return curve(df, label, score).select("threshold", (F.col("tp") / F.col("pp")).alias("precision"), F.try_divide("tp", "p_all").alias("recall"))


def auc(df: DataFrame, label: str, score: str, approximate: bool = False) -> DataFrame:
    """One row: ``auc_roc`` and ``average_precision``, null if a class is absent.

    ``approximate`` uses Spark's evaluator, which bins the scores.
    """
    if approximate:
        from pyspark.ml.evaluation import BinaryClassificationEvaluator
        from pyspark.ml.functions import array_to_vector

        vectors = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(1 - F.col(score), F.col(score))).alias("rawPrediction"))
        values = [BinaryClassificationEvaluator(metricName=m).evaluate(vectors) for m in ("areaUnderROC", "areaUnderPR")]
        return df.sparkSession.createDataFrame([tuple(values)], "auc_roc double, average_precision double")
    points = curve(df, label, score)
    negatives = F.col("n") - F.col("pos")
    return points.agg(
        F.try_divide(F.sum(negatives * (F.col("tp") - F.col("pos") / 2)), F.max(F.col("p_all") * F.col("n_all"))).alias("auc_roc"),
        F.try_divide(F.sum(F.col("pos") * (F.col("tp") / F.col("pp"))), F.max("p_all")).alias("average_precision"),
    )


def pr_trapezoid(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the precision-recall curve by trapezoids."""
    points = with_previous(pr_curve(df, label, score), [F.col("threshold").desc()], {"r0": "recall", "p0": "precision"})
    width, height = F.col("recall") - F.coalesce("r0", F.lit(0.0)), F.col("precision") + F.coalesce("p0", "precision")
    return points.agg(F.sum(width * height / 2).alias("pr_area"))
