"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a repeatable shuffled order, read up to ``repeats``
times.  A document's virtual finish time is the number of words its source has sent when it is
through, divided by the source's target.  All queues are merged in the order of finish time and the
merged sequence is cut at the total budget, so that every source is served in proportion to its
target at any point of the sequence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import small, sorted_rows, with_running
from .storage import discard, stored, with_row_key

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a partition of the delivered mix: about 6 to 120 MB of text.
LEAST_WORDS, MOST_WORDS = 1_000_000, 20_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_column: Column, seed: int) -> Column:
    """60 bits of an md5: the same in every engine and on every partitioning."""
    text = F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], budget: float, repeats: int) -> DataFrame:
    """Water filling: ``totals(source, source_size)`` with a ``target`` for each source.

    Sources in code-point order, null last, take ``weights`` in turn.  The one-partition windows
    run over a row for each source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weighted = (
        totals.withColumn("place", F.row_number().over(named))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget)))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.col("budget") - F.col("caps_before")) / F.col("weights_on")
    filled = (
        weighted.withColumn("caps_before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("weights_on", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("full", F.col("cap") / F.col("weight") <= level)
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("sharing", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("budget") - F.col("spent")) / F.col("sharing"))
    return filled.select("source", "source_size", target.alias("target"))


def _queues(sized: DataFrame, weights: tuple[int, ...], budget: float, repeats: int, seed: int) -> tuple[DataFrame, int, float]:
    """``sized(row, id, source, size)`` with key, source_size, target and ``through``: the words that
    its source has sent when the row is through for the first time; the number of rows, and the
    words of the whole mix.

    Rows are range-sorted by source and key, so that a source or an id of any size is split.
    """
    keyed = stored(sized.withColumn("key", shuffle_key(F.col("id"), seed)), "mix-sizes")
    rows = keyed.count()
    shares = stored(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, repeats), "mix-targets")
    queue = sorted_rows(keyed, [F.col("source").asc_nulls_last(), "key", "id", "size", "row"], rows, "mix-sorted")
    sent = with_running(queue, {"through": F.col("size")}, ["source"]).drop("part", "at")
    share = shares.select(F.col("source").alias("of"), "source_size", "target")
    queued = stored(sent.join(small(share), F.col("source").eqNullSafe(F.col("of"))).drop("of"), "mix-queues")
    discard(keyed, queue)
    total = min(budget, repeats) * (shares.agg(F.sum("source_size")).first()[0] or 0)
    return queued, rows, total


def _sequence(queued: DataFrame, rows: int, total: float, repeats: int) -> DataFrame:
    """``(row, copy, id, source, key, size, sent, finish, position)`` of the merged sequence, up to the budget.

    All copies of all rows are range-sorted by finish time and numbered; the running sum of their
    sizes cuts the sequence.
    """
    finish = F.try_divide(F.col("through") + F.col("source_size") * F.col("copy"), F.col("target"))
    copies = queued.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    narrow = copies.select("row", "id", "source", "size", "key", "copy", finish.alias("finish"))
    order = ["finish", "key", "id", "size", F.col("source").asc_nulls_last(), "row", "copy"]
    merged = with_running(sorted_rows(narrow, order, rows * repeats, "mix-sequence"), {"sent": F.col("size"), "position": F.lit(1)})
    return merged.where(F.col("sent") <= total).select("row", "copy", "id", "source", "key", "size", "sent", "finish", F.col("position").cast("long").alias("position"))


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    budget: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(id, size, source_size, target, taken, copies, first_position)`` for every row of ``df``.

    ``size`` is the number of words (0 for a null text), ``budget`` a multiple of all sizes,
    ``copies`` how often the mix takes the row, ``taken`` the words of that and ``first_position`` the
    place of its first copy in the merged sequence, from 1 (null: not taken).  A null source is a
    source of its own.  Repeated rows queue one behind the other.  Rows without words are never
    taken.  An empty table gives an empty result.  Only the three named columns are read.
    """
    sized = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    queued, rows, total = _queues(sized, weights, budget, repeats, seed)
    taken = _sequence(queued, rows, total, repeats).groupBy(F.col("row").alias("__row")).agg(F.count("*").cast("int").alias("n"), F.min("position").alias("first_position"))
    joined = queued.join(taken, F.col("row") == F.col("__row"), "left").withColumn("copies", F.coalesce("n", F.lit(0)))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "first_position")


def mixed(
    df: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    budget: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    ordered: bool = True,
) -> DataFrame:
    """The rows of ``df`` that the mix takes, as often as it takes them.

    Rows are named by file and place in it: those with null or repeated ids and repeated rows get
    exactly their own copies.  In a source each pass over the queue is taken up to some row: a table of
    these last rows, one for each source and pass, decides for every row in a scan of ``df``, so that no
    text is copied or shuffled.  ``ordered`` hands the rows on in the order of the merged sequence;
    that joins them with their positions and sorts them, two shuffles of texts.
    """
    whole = with_row_key(df)
    row, size = F.struct("file", "index").alias("row"), word_count(F.col(f"all.{text_col}")).alias("size")
    named = [row, F.col(f"all.{id_col}").alias("id"), F.col(f"all.{source_col}").alias("source")]
    queued, rows, total = _queues(whole.select(*named, size), weights, budget, repeats, seed)
    sequence = stored(_sequence(queued, rows, total, repeats), "mix-places")
    discard(queued)
    if ordered:
        by_default = total / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, math.ceil(total / min(max(by_default, LEAST_WORDS), MOST_WORDS)))
        place = F.least(F.floor(F.col("sent") * parts / max(total, 1)), F.lit(parts - 1)).cast("int").alias("__part")
        places = sequence.select("row.*", "position", place)
        return whole.join(places, ["file", "index"]).repartitionById(parts, "__part").sortWithinPartitions("position").select("all.*")
    order = F.struct("key", "id", "size", "row")
    ends = sequence.groupBy("source", "copy").agg(F.max(order).alias("end")).groupBy(F.col("source").alias("of")).agg(F.collect_list("end").alias("ends"))
    ends = stored(ends, "mix-ends")
    discard(sequence)
    facts = whole.select("all", *named, size).withColumn("key", shuffle_key(F.col("id"), seed))
    met = facts.where("size > 0").join(small(ends), F.col("source").eqNullSafe(F.col("of")))
    copies = F.size(F.filter("ends", lambda end: order <= end))
    return met.select("all", F.explode(F.array_repeat(F.lit(0), copies))).select("all.*")
