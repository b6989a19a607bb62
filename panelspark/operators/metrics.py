"""Metric rows in one aggregation, and NDCG by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.expressions import log_loss
from panelspark.functions.ranking import global_rank
from panelspark.operators.curves import auc, rated


# The names of the metric row.
def confusion_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: n, pos_rate, mean_pred_p1, pred_pos, pos, tp, precision, recall, f1, brier.

    Rows without a label or a score (null, NaN) are left out, as in all curves and losses.
    """
    y, p = F.col(label).cast("int"), F.col(score)
    hit = p >= threshold
    sums = rated(df, label, score).agg(
        F.count("*").alias("n"),
        F.avg(y).alias("pos_rate"),
        F.avg(p).alias("mean_pred_p1"),
        F.count_if(hit).alias("pred_pos"),
        F.count_if(y == 1).alias("pos"),
        F.count_if(hit & (y == 1)).alias("tp"),
        F.avg(F.pow(p - y, 2)).alias("brier"),
    )
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, found, real = F.col("tp"), F.col("pred_pos"), F.col("pos")
    return sums.select("n", "pos_rate", "mean_pred_p1", "pred_pos", "pos", "tp", zero(tp, found).alias("precision"), zero(tp, real).alias("recall"), zero(2 * tp, found + real).alias("f1"), "brier")


def metric_row(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """``confusion_metrics`` with auc_roc and average_precision."""
    return confusion_metrics(df, label, score, threshold).join(F.broadcast(auc(df, label, score)))


def losses(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """One row: brier, log_loss, and their weighted means if a weight is named."""
    y, p = F.col(label).cast("double"), F.col(score)
    each = {"brier": F.pow(p - y, 2), "log_loss": log_loss(y, p)}
    out = [F.avg(v).alias(k) for k, v in each.items()]
    if weight:
        out += [(F.sum(v * F.col(weight)) / F.sum(weight)).alias(f"weighted_{k}") for k, v in each.items()]
    return rated(df, label, score).agg(*out)


def ndcg(df: DataFrame, group: str, relevance: str, score: str, ties: list[str], k: int | None = None) -> DataFrame:
    """``(group, ndcg)`` with gains 2**relevance - 1; a group without gain has 1.

    Places come from range-sorted rows, so that a group of any size is many tasks.
    """
    rows = df.select(group, F.coalesce(F.col(relevance), F.lit(0)).cast("double").alias("__r"), F.col(score).alias("__s"), *[c for c in ties if c != group])
    placed = global_rank(rows, [F.col("__s").desc(), *map(F.col, ties)], "__at", [group])
    gain = F.pow(F.lit(2.0), F.col("__r")) - 1
    inside = F.lit(k is None) | (F.col("__at") <= (k or 0))
    reached = placed.groupBy(group).agg(F.coalesce(F.sum(F.when(inside, gain / F.log2(1 + F.col("__at")))), F.lit(0.0)).alias("dcg"))
    best = global_rank(rows.select(group, "__r"), [F.col("__r").desc()], "__at", [group])
    ideal = best.groupBy(group).agg(F.coalesce(F.sum(F.when(inside, gain / F.log2(1 + F.col("__at")))), F.lit(0.0)).alias("ideal"))
    return reached.withColumnRenamed(group, "__g").join(ideal, F.col("__g").eqNullSafe(F.col(group))).select(group, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(F.lit(1.0)).alias("ndcg"))
