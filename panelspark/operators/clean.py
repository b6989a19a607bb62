"""Cleaning of a modelling frame in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.expressions import finite_or_null


def clean(
    df: DataFrame,
    label: str,
    categorical: list[str],
    binary: list[str],
    continuous: list[str],
    keep: list[str] = (),
    label_cast: str | None = "double",
    numeric_cast: str | None = "double",
    categorical_cast: str | None = "string",
    binary_null_to: float | None = 0.0,
    nan_to_null: bool = True,
    inf_to_null: bool = True,
) -> DataFrame:
    """``keep``, label, numeric and categorical columns, cast and repaired.

    Missing flags become ``binary_null_to``; NaN and infinities of continuous columns become null.
    Each step can be switched off with None or False.
    """

    def cast(c: str, kind: str | None):
        return F.col(c).cast(kind) if kind else F.col(c)

    out = [F.col(c) for c in keep] + [cast(label, label_cast).alias(label)]
    for c in binary:
        value = cast(c, numeric_cast)
        out.append((value if binary_null_to is None else F.coalesce(value, F.lit(binary_null_to))).alias(c))
    for c in continuous:
        value = cast(c, numeric_cast)
        if nan_to_null and inf_to_null:
            value = finite_or_null(value)
        elif nan_to_null:
            value = F.when(~F.isnan(value), value)
        elif inf_to_null:
            value = F.when(F.abs(value) != float("inf"), value)
        out.append(value.alias(c))
    out += [cast(c, categorical_cast).alias(c) for c in categorical]
    return df.select(*out)


def of_class(df: DataFrame, label: str, value: int) -> DataFrame:
    return df.where(F.col(label) == value)
