"""Splits by year, deduplication and class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Range = tuple[int, int]


def in_range(year: str, bounds: Range, inclusive: bool = False) -> Column:
    """``low <= year < high``, or up to ``high`` if ``inclusive``; an empty range is an error."""
    low, high = bounds
    if low > high or (low == high and not inclusive):
        raise ValueError(f"empty range {bounds}")
    upper = F.col(year) <= high if inclusive else F.col(year) < high
    return (F.col(year) >= low) & upper


def time_split(df: DataFrame, train: Range, test: Range, valid: Range | None = None, year: str = "year", inclusive: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    part = lambda r: df.where(in_range(year, r, inclusive))
    return part(train), part(valid) if valid else None, part(test)


def tag_splits(df: DataFrame, train: Range, test: Range, valid: Range | None = None, year: str = "year", inclusive: bool = False) -> DataFrame:
    """One pass: rows of any split with a ``split`` column."""
    tag = F.when(in_range(year, train, inclusive), "train")
    if valid:
        tag = tag.when(in_range(year, valid, inclusive), "valid")
    return df.withColumn("split", tag.when(in_range(year, test, inclusive), "test")).where("split is not null")


def split_summary(tagged: DataFrame, label: str) -> DataFrame:
    return tagged.groupBy("split").agg(F.count("*").alias("n"), F.avg((F.col(label) == 1).cast("double")).alias("pos_rate"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """A row for each label: n, total and the positive rate of all rows (0 for none)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    positives = F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))).over(whole), F.lit(0))
    return counts.select("label", "n", F.sum("n").over(whole).alias("total"), (positives / F.sum("n").over(whole)).alias("pos_rate"))


def deduplicate(df: DataFrame, keys: list[str] | None = None, order_by: list[str] | None = None, keep: str = "first") -> DataFrame:
    """The first or last row of each key by ``order_by``; without keys, distinct rows.

    All other columns break ties, so that the result doesn't depend on the partitioning.  The least or
    greatest row of a key is an aggregate, so that each task sends one row of a key at most.
    """
    if not keys:
        return df.distinct()
    if not order_by:
        raise ValueError("keyed deduplication needs order_by")
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    order = [*order_by, *[c for c in df.columns if c not in order_by and c not in keys]]
    row = F.struct(*order)
    best = df.groupBy(*keys).agg((F.min(row) if keep == "first" else F.max(row)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])
