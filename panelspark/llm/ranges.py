"""Numbers and running sums over range-sorted rows, of which every task holds a bounded part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Tables of at most so many narrow rows are broadcast; the size is counted first.
BROADCAST_ROWS = 50_000
#: Rows that a part of a sort holds on average, whatever their number.
PART_ROWS = 20_000
_SHIFT = 33
#: A sieve has 64 times 2**SIEVE_BITS bits in so many rows at most: about 25 MB, whatever it holds.
SIEVE_BITS = 20


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few, else as it is (AQE splits skew)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sifted(df: DataFrame, column: str, ids: DataFrame, needed: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``column`` may be among ``needed`` of ``ids``, and those whose is not.

    A bitmap of fixed size decides: the first part has all that are, and as many of the others as share
    a bit with them.  Nothing is shuffled.
    """
    hashed = lambda c: F.xxhash64(F.lit("sieve"), c)
    word = F.shiftrightunsigned("__h", 64 - SIEVE_BITS)
    bits = ids.select(hashed(needed).alias("__h")).select(word.alias("__word"), F.expr("shiftleft(1L, cast(__h & 63 as int))").alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = df.withColumn("__h", hashed(column)).withColumn("__at", word).join(F.broadcast(stored(bits, "sieve")), F.col("__at") == F.col("__word"), "left")
    met = F.expr("coalesce(shiftrightunsigned(__bits, cast(__h & 63 as int)) & 1, 0) = 1")
    return marked.where(met).select(*df.columns), marked.where(~met).select(*df.columns)


def sorted_rows(df: DataFrame, order: list[Column | str], rows: int, name: str) -> DataFrame:
    """``df``, of ``rows`` rows, sorted and stored, with ``part`` and the place ``at`` within it.

    The order should break all ties, so that equal first columns can still be split.
    """
    parts = max(1, math.ceil(rows / PART_ROWS))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return stored(placed.withColumn("part", F.shiftright("__id", _SHIFT)).withColumn("at", F.col("__id").bitwiseAND((1 << _SHIFT) - 1)).drop("__id"), name)


def with_running(placed: DataFrame, sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``placed`` with inclusive running sums in the order of the sort, within equal ``by`` if given.

    A table with a row for each part, or for each part and ``by``, holds what came before.
    """
    by = by or []
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.groupBy("part", *by).agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    starts = own.select(F.col("part").alias("__part"), *[F.col(b).alias(f"__by_{b}") for b in by], *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    met = F.col("part") == F.col("__part")
    for b in by:
        met &= F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    joined = placed.join(small(stored(starts, "running-starts")), met).drop("__part", *[f"__by_{b}" for b in by])
    inside = Window.partitionBy("part", *by).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select("*", *[(F.sum(c).over(inside) + F.col(f"__{k}")).alias(k) for k, c in sums.items()]).drop(*[f"__{k}" for k in sums])


def spread_join(df: DataFrame, table: DataFrame, key: str, other: str, salts: int = 64) -> DataFrame:
    """``df`` joined with ``table``, which has one row for each ``key``, without one task for a hot key.

    Rows of a key are dealt by ``other`` over ``salts`` places; the table's row goes to those of them
    that have rows.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(other), F.lit(salts)).cast("int"))
    wanted = salted.select(F.col(key).alias("__key"), "__salt").distinct()
    right = wanted.join(table, F.col("__key") == F.col(key)).drop(key).withColumnRenamed("__salt", "__place")
    return salted.join(right, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__place"))).drop("__salt", "__key", "__place")
