"""Decision thresholds from a 100-point sweep or from the exact curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.curves import curve

POINTS = 100


def check_inputs(df: DataFrame, label: str, score: str) -> None:
    """An error if a label is not 0 or 1, or a score is not in [0, 1]; one pass."""
    row = df.agg(F.count_if(F.coalesce(~F.col(label).isin(0, 1), F.lit(True))).alias("labels"), F.count_if(F.coalesce(F.isnan(F.col(score)) | (F.col(score) < 0) | (F.col(score) > 1), F.lit(True))).alias("scores")).first()
    if row["labels"] or row["scores"]:
        raise ValueError(f"{row['labels']} labels are not 0 or 1, {row['scores']} scores are not in [0, 1]")


def sweep(df: DataFrame, label: str, score: str, points: int = POINTS) -> DataFrame:
    """``(i, threshold, tp, fp, fn, tn)`` at ``i / (points - 1)``; a row is positive from there on.

    Rows become a histogram of ``points`` buckets, summed from above.
    """
    last = points - 1
    grid = F.array(*[F.lit(i / last) for i in range(points)])
    p = F.col(score)
    k = F.least(F.greatest(F.floor(p * last), F.lit(0)), F.lit(last)).cast("int")
    k = k + F.when((k < last) & (F.get(grid, F.least(k + 1, F.lit(last))) <= p), 1).otherwise(0) - F.when(F.get(grid, k) > p, 1).otherwise(0)
    counts = df.groupBy(k.alias("i")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    every = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    filled = every.join(F.broadcast(counts), "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pos", F.lit(0)).alias("pos"))
    above, whole = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    sums = filled.select("i", F.sum("n").over(above).alias("pp"), F.sum("pos").over(above).alias("tp"), F.sum("n").over(whole).alias("rows"), F.sum("pos").over(whole).alias("real"))
    return sums.select("i", F.get(grid, F.col("i")).alias("threshold"), "tp", (F.col("pp") - F.col("tp")).alias("fp"), (F.col("real") - F.col("tp")).alias("fn"), (F.col("rows") - F.col("real") - F.col("pp") + F.col("tp")).alias("tn"))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    bottom = (1 + beta**2) * tp + beta**2 * fn + fp
    return F.when(bottom > 0, (1 + beta**2) * tp / bottom).otherwise(F.lit(0.0))


def tune_custom(df: DataFrame, label: str, score: str, metric: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """One row ``(threshold, value)``: the first best point of the sweep by ``metric(tp, fp, fn, tn)``."""
    rated = sweep(df, label, score).withColumn("value", metric(*map(F.col, ("tp", "fp", "fn", "tn"))))
    return rated.orderBy(F.desc("value"), "threshold").limit(1).select("threshold", "value")


def tune_f(df: DataFrame, label: str, score: str, beta: float = 1.0) -> DataFrame:
    return tune_custom(df, label, score, lambda tp, fp, fn, tn: f_beta(tp, fp, fn, beta))


def tune_youden(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row ``(threshold, value)``: the highest score with the largest tpr - fpr.

    Without a class its rate is 0: with positives only the lowest score is found, with value 1, and
    without any the threshold 1, with value 0.
    """
    points = curve(df, label, score)
    rate = lambda n, of: F.coalesce(F.try_divide(n, F.col(of)), F.lit(0.0))
    j = rate(F.col("tp"), "p_all") - rate(F.col("pp") - F.col("tp"), "n_all")
    rated = points.select("threshold", F.round(j, 12).alias("value"))
    start = points.limit(1).select(F.lit(1.0).alias("threshold"), F.lit(0.0).alias("value"))
    best = rated.unionByName(start).orderBy(F.desc("value"), F.desc("threshold")).limit(1)
    return best.select(F.least(F.greatest("threshold", F.lit(0.0)), F.lit(1.0)).alias("threshold"), "value")


def tune_constrained(df: DataFrame, label: str, score: str, min_precision: float | None = None, min_recall: float | None = None) -> DataFrame:
    """One row ``(threshold, value, feasible)``: the best F1 within the limits, else 0.5."""
    if min_precision is None and min_recall is None:
        raise ValueError("give min_precision, min_recall or both")
    points = curve(df, label, score).select("threshold", (F.col("tp") / F.col("pp")).alias("precision"), F.coalesce(F.try_divide("tp", "p_all"), F.lit(0.0)).alias("recall"), f_beta(F.col("tp"), F.col("pp") - F.col("tp"), F.col("p_all") - F.col("tp")).alias("value"))
    good = points.where((F.col("precision") >= (min_precision or 0.0)) & (F.col("recall") >= (min_recall or 0.0)))
    best = good.agg(F.max_by("threshold", F.struct(F.round("value", 12), "threshold")).alias("threshold"), F.max("value").alias("value"))
    return best.select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"), F.coalesce("value", F.lit(0.0)).alias("value"), F.col("threshold").isNotNull().alias("feasible"))


def tune(df: DataFrame, label: str, score: str, strategy: str = "f1", **options) -> float:
    """The threshold that a strategy finds on a scored validation frame, after input checks."""
    strategies = {"f1": tune_f, "f_beta": tune_f, "youden": tune_youden, "constrained": tune_constrained, "custom": tune_custom}
    if strategy not in strategies:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(strategies)}")
    check_inputs(df, label, score)
    return strategies[strategy](df, label, score, **options).first()["threshold"]
