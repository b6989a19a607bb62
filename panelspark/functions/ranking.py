"""Exact ranks, running sums and neighbours without a window that takes all rows.

Rows are range-partitioned and sorted by the whole order, so that ties on the first column can
still be split, and stored once: numbers and offsets must come from the same sort, even if an
executor is lost.  A row's number within its partition comes from its generated id; a table with a
row for each partition holds what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.scratch import scratch_path

_SHIFT = 33


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back; no schema is inferred."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing will read any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted rows with their partition ``__part`` and their place ``__at`` in it."""
    placed = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__id", _SHIFT)).withColumn("__at", F.col("__id").bitwiseAND((1 << _SHIFT) - 1))
    return stored(placed.drop("__id"), "sorted")


def _running(placed: DataFrame, sums: dict[str, Column], by: list[str]) -> DataFrame:
    """Inclusive running sums in the order of the sort, within equal ``by``; a partition of the sort
    is the most that a task holds.  The broadcast table has a row for each partition and the values
    of ``by`` that begin in it."""
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.groupBy("__part", *by).agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    starts = own.select("__part", *by, *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    starts = starts.select(F.col("__part").alias("__p"), *[F.col(b).alias(f"__by_{k}") for k, b in enumerate(by)], *[f"__{k}" for k in sums])
    met = F.col("__part") == F.col("__p")
    for k, b in enumerate(by):
        met &= F.col(b).eqNullSafe(F.col(f"__by_{k}"))
    joined = placed.join(starts if by else F.broadcast(starts), met)
    inside = Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [c for c in placed.columns if c not in ("__part", "__at")]
    return joined.select(*names, *[(F.sum(c).over(inside) + F.col(f"__{k}")).alias(k) for k, c in sums.items()])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """``df`` with the row number by ``order``, which should break all ties; with ``by``, the number
    within each of its values, which the order then begins with."""
    placed = _ordered(df, [*map(F.col, by or []), *order])
    if by:
        return _running(placed, {name: F.lit(1)}, by).withColumn(name, F.col(name).cast("long"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = placed.join(F.broadcast(counts), "__part")
    return joined.withColumn(name, (F.col("__before") + F.col("__at") + 1).cast("long")).drop("__part", "__at", "__before")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``df`` with inclusive running sums by ``order``, within equal ``by`` if given: ``sums`` maps new
    columns to summed ones."""
    return _running(_ordered(df, [*map(F.col, by or []), *order]), {k: F.col(c) for k, c in sums.items()}, by or [])


def with_previous(df: DataFrame, order: list[Column], columns: dict[str, str]) -> DataFrame:
    """``df`` with the row before's values by ``order``: ``columns`` maps new columns to old ones; null in
    the first row.  The first row of a partition gets them from a table of the partitions' last rows."""
    placed = _ordered(df, order)
    ends = placed.groupBy("__part").agg(F.max_by(F.struct(*columns.values()), "__at").alias("__end"))
    ends = ends.select(F.col("__part").alias("__p"), F.lag("__end").over(Window.orderBy("__part")).alias("__end"))
    joined = placed.join(F.broadcast(ends), F.col("__part") == F.col("__p"))
    inside = Window.partitionBy("__part").orderBy("__at")
    found = [F.when(F.col("__at") == 0, F.col(f"__end.{old}")).otherwise(F.lag(old).over(inside)).alias(new) for new, old in columns.items()]
    return joined.select(*df.columns, *found)
