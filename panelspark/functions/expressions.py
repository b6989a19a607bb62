"""Column expressions of cleaning, mining and weighting."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The level that stands for a missing category.
MISSING = "__missing__"


def finite_or_null(column: Column) -> Column:
    return F.when(~(F.isnan(column) | (F.abs(column) == float("inf"))), column)


def level(column: Column) -> Column:
    """A category as text, a null as its own level."""
    return F.coalesce(column.cast("string"), F.lit(MISSING))


def margin(score: Column) -> Column:
    return F.abs(score - 0.5)


def entropy(score: Column) -> Column:
    """Binary entropy with a guard of 1e-10 inside the logarithms."""
    return -score * F.log(score + 1e-10) - (1 - score) * F.log(1 - score + 1e-10)


def min_max(score: Column, low: Column, high: Column) -> Column:
    return (score - low) / (high - low + 1e-10)


def positive_probability(vector: str = "probability") -> Column:
    return vector_to_array(F.col(vector))[1]


def class_weight(label: Column, weight: Column) -> Column:
    return F.when(label == 1, weight).otherwise(F.lit(1.0))


def log_loss(label: Column, p: Column, guard: float = 1e-15) -> Column:
    clamped = F.least(F.greatest(p, F.lit(guard)), F.lit(1 - guard))
    return -(label * F.log(clamped) + (1 - label) * F.log(1 - clamped))
