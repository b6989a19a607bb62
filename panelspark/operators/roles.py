"""Roles of columns: label, categorical, numeric, key, weight."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, CATEGORICAL = "numeric", "categorical"


@dataclass
class Roles:
    label: str
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    weight: str | None = None
    resolved: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def selection(self) -> list[str]:
        return [*self.features, self.label, *([self.weight] if self.weight else [])]

    def table(self, df: DataFrame) -> DataFrame:
        """``(column, type, role)`` in schema order."""
        rows = [(name, kind, role) for name, (kind, role) in self.resolved.items()]
        return df.sparkSession.createDataFrame(rows, "column string, type string, role string")


def _few_values(df: DataFrame, columns: list[str], most: int) -> dict[str, int]:
    """Distinct values of integer columns, null as one; anything above ``most`` where there are more.

    Each task keeps up to ``most + 1`` values of a column and then no longer looks at it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set] = {c: set() for c in columns}
        for batch in batches:
            for c in columns:
                if len(seen[c]) <= most:
                    seen[c].update(pc.unique(batch.column(c)).to_pylist()[: most + 1])
        rows = [(c, v) for c in columns for v in list(seen[c])[: most + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], ["column", "value"])

    found = df.select(*columns).mapInArrow(run, "column string, value long").distinct()
    return {r["column"]: r["n"] for r in found.groupBy("column").agg(F.count("*").alias("n")).collect()}


def infer_types(df: DataFrame, columns: list[str], max_levels: int = 20, unknown: str = NUMERIC, approximate: bool = False) -> dict[str, str]:
    """Categorical or numeric for each column.

    Text is categorical, booleans and fractions are numeric, integers are categorical if they have
    at most ``max_levels`` distinct values, a null counting as one.  One narrow pass over all integers
    keeps sets that stop growing behind that number.  Decimals and other atomic types follow ``unknown``; nested types are an error.
    """
    out, integers = {}, []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            out[c] = CATEGORICAL
        elif isinstance(kind, (T.BooleanType, T.FloatType, T.DoubleType)):
            out[c] = NUMERIC
        elif isinstance(kind, (T.IntegerType, T.LongType)):
            integers.append(c)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.DateType, T.TimestampType)):
            raise TypeError(f"column {c!r} of type {kind.simpleString()} has no role; list or drop it")
        else:
            out[c] = unknown
    if integers:
        counts = _few_values(df, integers, max_levels) if not approximate else df.agg(*[(F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in integers]).first().asDict()
        out |= {c: CATEGORICAL if (counts.get(c) or 0) <= max_levels else NUMERIC for c in integers}
    return {c: out[c] for c in columns}


def resolve(
    df: DataFrame,
    label: str,
    categorical: list[str] = (),
    numeric: list[str] = (),
    drop: list[str] = (),
    keys: list[str] = (),
    weight: str | None = None,
    overrides: dict[str, str] | None = None,
    auto: bool = True,
    strict: bool = True,
    **inference,
) -> Roles:
    """Explicit lists first, then ``overrides`` by column, then inference, all in schema order.

    A missing label is an error, other missing columns are one if ``strict`` and are left out
    otherwise; a column that is both categorical and numeric is an error.
    """
    if both := set(categorical) & set(numeric):
        raise ValueError(f"both categorical and numeric: {', '.join(sorted(both))}")
    if label not in df.columns:
        raise ValueError(f"the label {label!r} is missing")
    missing = [c for c in [*categorical, *numeric, *keys, *([weight] if weight else [])] if c not in df.columns]
    if missing and strict:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    apart = {*drop, *keys, label, weight}
    given = {c: CATEGORICAL for c in categorical} | {c: NUMERIC for c in numeric}
    given |= {c: r for c, r in (overrides or {}).items() if c not in given}
    open_columns = [c for c in df.columns if c not in apart and c not in given] if auto else []
    given |= infer_types(df, open_columns, **inference)
    roles = Roles(label, [], [], list(drop), [c for c in keys if c in df.columns], weight if weight in df.columns else None)
    for c in df.columns:
        role = "label" if c == label else "weight" if c == weight else "key" if c in keys else "drop" if c in drop else given.get(c, "unused")
        if role in (CATEGORICAL, NUMERIC):
            (roles.categorical if role == CATEGORICAL else roles.numeric).append(c)
        roles.resolved[c] = (df.schema[c].dataType.simpleString(), role)
    return roles


def split_numeric(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """Binary-like columns (all values 0 or 1, at least one value) and continuous ones; one pass."""
    if not columns:
        return [], []
    row = df.agg(*[F.min(F.when(F.col(c).isNotNull(), F.col(c).cast("double").isin(0.0, 1.0))).alias(c) for c in columns]).first()
    binary = [c for c in columns if row[c]]
    return binary, [c for c in columns if c not in binary]


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)
