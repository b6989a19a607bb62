"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by leading bits of a document's hash.  A bucket splits on one more bit
exactly while it holds more bytes than the limit.  All depths of a step are decided together from
the totals of fine cells, rolled up to coarser ones, so a step costs a few narrow aggregations
however many buckets split; only cells that are still too large at the finest depth of a step are
looked at again, with more bits.

The hash is of the id, the text and, among rows that agree in both, the row's number, so that null
and repeated ids are spread like any others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import small, sorted_rows, with_running
from .storage import fresh_path, stored

BITS = 60
#: Depths that one step of the roll-up derives from the same finer cells.
LEVELS = 5


def _prefix(depth: int) -> Column:
    return F.shiftright("key", BITS - depth)


def _nodes(cells: DataFrame, low: int, high: int) -> DataFrame:
    """``(level, node, bytes)``: totals of all depths from ``low`` to ``high``, each group of depths
    from the totals of the finest depth of the group below it."""
    finest = cells.select(F.lit(high).alias("level"), F.col("cell").alias("node"), "bytes")
    parts, top = [finest], high
    while top > low:
        to = max(low, top - LEVELS)
        upper = finest.select("bytes", "node", F.explode(F.sequence(F.lit(to), F.lit(top - 1))).alias("level")).withColumn("node", F.expr(f"shiftright(node, {top} - level)"))
        rolled = stored(upper.groupBy("level", "node").agg(F.sum("bytes").alias("bytes")), "shard-nodes")
        parts.append(rolled)
        finest, top = rolled.where(F.col("level") == to), to
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def directory(narrow: DataFrame, limit: int, slack: int = 5) -> DataFrame:
    """``(cell_depth, cell, depth, prefix)``: the shard of every cell of ``narrow(key, bytes)``.

    A shard is named by its depth and its leading hash bits.
    """
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    parts, open_rows, low = [], narrow, 0
    step = max(0, math.ceil(math.log2(max(total, 1) / limit))) + slack
    while True:
        high = min(BITS, low + step)
        cells = stored(open_rows.groupBy(_prefix(high).alias("cell")).agg(F.sum("bytes").alias("bytes")), "shard-cells")
        splits = stored(_nodes(cells, low, high).where(F.col("bytes") > limit).select(F.col("level").alias("l"), F.col("node").alias("n")), "shard-splits")
        nodes = cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("level")).withColumn("node", F.expr(f"shiftright(cell, {high} - level)"))
        deepest = nodes.join(small(splits), (F.col("level") == F.col("l")) & (F.col("node") == F.col("n"))).groupBy(F.col("cell").alias("c")).agg(F.max("level").alias("deepest"))
        leaves = cells.join(deepest, F.col("cell") == F.col("c"), "left").select("cell", F.coalesce(F.col("deepest") + 1, F.lit(low)).alias("depth"))
        done = leaves if high == BITS else leaves.where(F.col("depth") <= high)
        depth = F.least(F.col("depth"), F.lit(high))
        parts.append(stored(done.select(F.lit(high).alias("cell_depth"), "cell", depth.cast("int").alias("depth"), F.expr(f"shiftright(cell, {high} - least(depth, {high}))").alias("prefix")), "shard-directory"))
        large = splits.where(F.col("l") == high).select(F.col("n"))
        if high == BITS or large.isEmpty():
            break
        open_rows = stored(open_rows.join(small(large), _prefix(high) == F.col("n"), "left_semi"), "shard-open")
        low, step = high, 8
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _occurrences(narrow: DataFrame) -> DataFrame:
    """``narrow(row, id, digest, bytes)`` with ``occurrence``: a row's number, from 0, among those with its
    id and digest.  Rows are sorted for it only if there are any such."""
    if narrow.groupBy("id", "digest").count().where("count > 1").isEmpty():
        return narrow.withColumn("occurrence", F.lit(0).cast("long"))
    placed = sorted_rows(narrow, ["id", "digest", "row"], narrow.count(), "shard-sorted")
    return with_running(placed, {"occurrence": F.lit(1)}, ["id", "digest"]).withColumn("occurrence", F.col("occurrence") - 1).drop("part", "at")


def _placed(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """``rows(row, id, digest, bytes)`` with shard, depth, shard_bytes and shard_rows."""
    narrow = _occurrences(stored(rows, "shard-rows"))
    text = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), "digest", F.col("occurrence").cast("string"), F.lit(str(seed)))
    narrow = stored(narrow.select("row", "id", "bytes", F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long").alias("key")), "shard-keys")
    found = stored(directory(narrow, limit), "shard-map")
    depths = [r[0] for r in found.select("cell_depth").distinct().orderBy("cell_depth").collect()]
    columns = ["row", "id", "bytes"]
    parts = []
    for high in depths:
        cells = small(found.where(F.col("cell_depth") == high).select("cell", "depth", "prefix"))
        parts.append(narrow.join(cells, _prefix(high) == F.col("cell")).select(*columns, "depth", "prefix"))
    placed = parts[0] if parts else narrow.select(*columns, F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    for part in parts[1:]:
        placed = placed.unionByName(part)
    totals = placed.groupBy(F.col("depth").alias("d"), F.col("prefix").alias("p")).agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    totals = stored(totals, "shard-totals")
    joined = placed.join(small(totals), (F.col("depth") == F.col("d")) & (F.col("prefix") == F.col("p")))
    shard = F.when(F.col("depth") == 0, "").otherwise(F.expr("right(concat(repeat('0', 60), bin(prefix)), depth)"))
    return joined.select(*columns, shard.alias("shard"), "depth", "shard_bytes", "shard_rows")


def _narrow(df: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(row.alias("row"), F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def assign(df: DataFrame, limit: int = 32 << 20, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, bytes, shard, depth, shard_bytes, shard_rows, oversized)`` for every row of ``df``.

    ``bytes`` is the UTF-8 length of the text (null: 0), ``shard`` the leading hash bits as a string
    of 0 and 1, empty if one shard holds everything.  Every shard has at most ``limit`` bytes, but for
    a single text above the limit, whose shard is marked ``oversized``.  A null id counts as the empty
    string; rows with equal ids go by their texts, and equal rows by their number, so that they are
    spread too.  An empty table gives an empty result.  Other columns are ignored.
    """
    placed = _placed(_narrow(df, F.monotonically_increasing_id(), id_col, text_col), limit, seed)
    return placed.select(F.col("id").alias(id_col), "bytes", "shard", "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(df: DataFrame, path: str | None = None, limit: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the rows of ``df`` as Parquet, a folder for each shard; the path is returned.

    Each task writes whole shards, which the limit bounds.  ``df`` is stored once with a number for
    each row, by which shards are matched; a column ``shard`` of ``df`` is replaced, one named
    ``__row`` is an error.
    """
    path = path or fresh_path(df.sparkSession, "shards")
    whole = stored(df.drop("shard").select("*", F.monotonically_increasing_id().alias("__row")), "shard-texts")
    shards = _placed(_narrow(whole, F.col("__row"), id_col, text_col), limit, 0).select(F.col("row").alias("__of"), F.concat(F.lit("b"), "shard").alias("shard"))
    whole.join(shards, F.col("__row") == F.col("__of")).drop("__row", "__of").repartition("shard").write.partitionBy("shard").parquet(path)
    return path
