"""Ranked lexical search by pipelined term partitioning.

The index is cut by blocks of documents, and each term is owned by one of a few stages: rare terms by
the first, the commonest by the last.  Items travel in bundles.  A bundle carries a sparse accumulator
of document scores for each block and goes through the stages one after the other; at each of them it
meets the posting lists of the terms that the stage owns, by a cogroup, and adds their integer
contributions.  Behind the last stage each item's best documents are selected.

Accumulators stay sparse by exact bounds.  A stage knows the most that later stages can add to a
document, and a score that fifty documents of the item have reached already, in this block or, by
histograms of scores, in all blocks.  A document that cannot come up to it any more is left out; no
document that could be in the result is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, stored
from .text import LOWER, chunks, hash_spans, same_spans, utf8

#: Bytes of terms: ASCII letters and digits, and all of other characters.
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Documents of a block, items of a bundle: their product bounds what a task holds.
BLOCK, BUNDLE = 4096, 256
#: Terms in up to such shares of the documents are owned by the first stages; the rest by the last.
SHARES = (0.01, 0.05, 0.25)
#: Bits of the map of terms that items have.
WANTED_BITS = 20
#: Lower edges of the histograms' bins of scores, about 4 % apart.
EDGES = np.array(sorted({int(2 ** (k / 16)) for k in range(1008)}), np.int64)


def _spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms, and for each text the number of its first term (len + 1)."""
    inside = TERM[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.append(False, inside[:-1])[: len(raw)]
    after = np.append(inside[1:], False)[: len(raw)]
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    return begins, np.flatnonzero(inside & (~after | edge[1:])) + 1, np.searchsorted(begins, at)


def term_counts(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats, and distinct terms with the number of the term, the text and
    its occurrences there; only those terms whose bit of ``wanted`` is set, if given."""
    raw, at = utf8(column)
    raw = LOWER[raw]
    begins, ends, first = _spans(raw, at)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    hashed = hash_spans(raw, begins, ends)
    if wanted is not None:
        some = np.flatnonzero(wanted[(hashed >> np.uint64(64 - WANTED_BITS)).astype(np.int64)])
        begins, ends, owner, hashed = begins[some], ends[some], owner[some], hashed[some]
    _, where, of = np.unique(hashed, return_index=True, return_inverse=True)
    padded = np.append(raw, np.zeros(8, np.uint8))
    size = ends - begins
    text = raw.tobytes()
    if same_spans(raw, begins, size, padded, begins[where][of], size[where][of]):
        terms = [text[a:b].decode() for a, b in zip(begins[where].tolist(), ends[where].tolist(), strict=True)]
    else:  # two terms share a hash
        known: dict[str, int] = {}
        of = np.array([known.setdefault(text[a:b].decode(), len(known)) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], np.int64)
        terms = list(known)
    pair, tf = np.unique(of * max(1, len(n)) + owner, return_counts=True)
    return n, terms, pair // max(1, len(n)), pair % max(1, len(n)), tf


def _list(flat: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def _numbers() -> Iterator[int]:
    """Numbers that no other task gives out."""
    part = TaskContext.get().partitionId()
    return iter(range(part << 32, part + 1 << 32))


def bundles(items: DataFrame, size: int = BUNDLE) -> DataFrame:
    """``(bundle, item, item_id, term)`` of ``items(item_id, text)``: a row for each distinct term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers()
        for batch in chunks(batches, "text", rows=size):
            _, terms, term, item, _ = term_counts(batch.column("text"))
            bundle = pa.array(np.full(len(term), next(number)))
            yield pa.RecordBatch.from_arrays([bundle, pa.array(item.astype(np.int32)), batch.column("item_id").take(pa.array(item)), pa.array(terms, pa.string()).take(pa.array(term))], ["bundle", "item", "item_id", "term"])

    schema = T.StructType([T.StructField("bundle", T.LongType()), T.StructField("item", T.IntegerType()), items.schema["item_id"], T.StructField("term", T.StringType())])
    return items.select("item_id", "text").mapInArrow(run, schema)


def _wanted(terms: DataFrame) -> np.ndarray:
    """A bit for each term that items have; at most 2**WANTED_BITS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column("term"))
            hashed = hash_spans(raw, at[:-1], at[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashed >> np.uint64(64 - WANTED_BITS)).astype(np.int32))], ["bit"])

    out = np.zeros(1 << WANTED_BITS, bool)
    out[terms.select("term").mapInArrow(run, "bit int").distinct().toArrow()["bit"].to_numpy()] = True
    return out


def index(docs: DataFrame, wanted: np.ndarray, size: int = BLOCK) -> DataFrame:
    """``(block, term, slots, tfs, sizes, ids)`` of ``docs(id, text)``.

    A row with a term is its posting list in one block: the documents' numbers there, the
    occurrences, and how many terms these documents have.  A row without a term lists the sizes and
    ids of all documents of the block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    kind = docs.schema["id"].dataType

    def rows(block: int, known: dict[str, int], found: list, sizes: list, ids: list) -> pa.RecordBatch:
        size = np.concatenate(sizes)
        term, slot, tf = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((slot, term))
        term, slot, tf = term[order], slot[order], tf[order]
        cuts = np.searchsorted(term, np.arange(len(known) + 1))
        own = pa.array([0, len(size)], pa.int32())
        whole = pa.concat_arrays(ids)
        nothing = lambda t: pa.array([None], pa.list_(t))
        columns = [
            pa.array(np.full(len(known) + 1, block)),
            pa.array([*known, None], pa.string()),
            pa.concat_arrays([_list(slot, cuts, pa.int16()), nothing(pa.int16())]),
            pa.concat_arrays([_list(tf, cuts, pa.int32()), nothing(pa.int32())]),
            pa.concat_arrays([_list(size[slot], cuts, pa.int32()), pa.ListArray.from_arrays(own, pa.array(size.astype(np.int32)))]),
            pa.concat_arrays([pa.array([None] * len(known), pa.list_(whole.type)), pa.ListArray.from_arrays(own, whole)]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "term", "slots", "tfs", "sizes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, wanted = _numbers(), shared.value
        known, found, sizes, ids, held = {}, [], [], [], 0
        for batch in chunks(batches, "text", 1 << 21, max(1, size // 4)):
            if held + batch.num_rows > size:
                yield rows(next(number), known, found, sizes, ids)
                known, found, sizes, ids, held = {}, [], [], [], 0
            n, terms, term, doc, tf = term_counts(batch.column("text"), wanted)
            here = np.array([known.setdefault(t, len(known)) for t in terms], np.int64)
            found.append((here[term] if len(here) else term, doc + held, tf))
            sizes.append(n)
            ids.append(batch.column("id"))
            held += batch.num_rows
        if held:
            yield rows(next(number), known, found, sizes, ids)

    fields = {"block": T.LongType(), "term": T.StringType(), "slots": T.ArrayType(T.ShortType()), "tfs": T.ArrayType(T.IntegerType()), "sizes": T.ArrayType(T.IntegerType()), "ids": T.ArrayType(kind)}
    return docs.select("id", "text").mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in fields.items()]))


def _ratio(tf: np.ndarray, size: np.ndarray, documents: int, terms: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    m = 100 - 50 + (50 * size.astype(np.int64) * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _owners(postings: DataFrame, documents: int, terms: int) -> DataFrame:
    """``(term, weight, peak, stage)`` of each term: ``peak`` is the most it adds to a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tfs, sizes = batch.column("tfs"), batch.column("sizes")
            ratio = _ratio(tfs.flatten().to_numpy(), sizes.flatten().to_numpy(), documents, terms)
            at = tfs.offsets.to_numpy()[:-1] - tfs.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("term"), tfs.value_lengths().cast(pa.int64()), pa.array(np.maximum.reduceat(ratio, at))], ["term", "df", "most"])

    found = postings.select("term", "tfs", "sizes").mapInArrow(run, "term string, df long, most long").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    stage = sum((F.when(F.col("df") > share * documents, 1).otherwise(0) for share in SHARES), F.lit(0))
    return found.select("term", weight.alias("weight"), (weight * F.col("most")).alias("peak"), stage.alias("stage"))


_CARRIED = "block long, bundle long, items array<int>, counts array<int>, slots array<short>, scores array<long>, seen array<struct<item: int, edge: long, n: long>>"


def _stage(documents: int, terms: int, k: int, last: bool, block: int, bundle: int):
    """What a stage does with a bundle's accumulator in a block and the posting lists that it meets."""

    seen = pa.struct([("item", pa.int32()), ("edge", pa.int64()), ("n", pa.int64())])
    kinds = {"block": pa.int64(), "bundle": pa.int64(), "items": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "slots": pa.list_(pa.int16()), "scores": pa.list_(pa.int64()), "seen": pa.list_(seen)}
    names = pa.schema(list(kinds.items()))

    def run(key: tuple, carried: pa.Table, lists: pa.Table) -> pa.Table:
        score = np.zeros((bundle, block), np.int64)
        touched = np.zeros(bundle, bool)
        # Of an item without a term here no bound is at hand, but behind the last stage nothing follows.
        least, rest = np.ones(bundle, np.int64), np.full(bundle, 0 if last else -1, np.int64)
        for batch in carried.to_batches():
            for row in range(batch.num_rows):
                items, counts, slots, scores = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("items", "counts", "slots", "scores"))
                score[np.repeat(items, counts), slots] = scores
                touched[items] = True
        for batch in lists.to_batches():
            for row in range(batch.num_rows):
                slots, tfs, sizes, items, leasts, rests = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("slots", "tfs", "sizes", "items", "leasts", "rests"))
                score[items[:, None], slots[None, :]] += batch.column("weight")[row].as_py() * _ratio(tfs, sizes, documents, terms)
                touched[items] = True
                least[items], rest[items] = leasts, rests
        kept, edges = [], []
        for item in np.flatnonzero(touched).tolist():
            own = score[item]
            at = np.flatnonzero(own)
            if rest[item] >= 0 and len(at):
                reached = least[item]
                if len(at) >= k:
                    reached = max(reached, np.partition(own[at], len(at) - k)[len(at) - k])
                at = at[own[at] + rest[item] >= reached]
            if not len(at):
                continue
            kept.append((item, at, own[at]))
            edge, n = np.unique(np.searchsorted(EDGES, own[at], "right") - 1, return_counts=True)
            edges += [{"item": item, "edge": int(EDGES[e]), "n": int(c)} for e, c in zip(edge, n, strict=True)]
        if not kept:
            return names.empty_table()
        columns = [
            pa.array([key[0].as_py()], pa.int64()),
            pa.array([key[1].as_py()], pa.int64()),
            pa.array([[x[0] for x in kept]], pa.list_(pa.int32())),
            pa.array([[len(x[1]) for x in kept]], pa.list_(pa.int32())),
            _list(np.concatenate([x[1] for x in kept]), np.array([0, sum(len(x[1]) for x in kept)]), pa.int16()),
            _list(np.concatenate([x[2] for x in kept]), np.array([0, sum(len(x[1]) for x in kept)]), pa.int64()),
            pa.array([edges], pa.list_(seen)),
        ]
        return pa.Table.from_arrays(columns, schema=names)

    return run


def _reached(carried: DataFrame, k: int) -> DataFrame:
    """``(bundle, item, least)``: a score that at least ``k`` documents of the item have already."""
    seen = carried.select("bundle", F.explode("seen").alias("s")).groupBy("bundle", F.col("s.item").alias("item"), F.col("s.edge").alias("edge")).agg(F.sum("s.n").alias("n"))
    above = Window.partitionBy("bundle", "item").orderBy(F.desc("edge"))
    return seen.withColumn("above", F.sum("n").over(above)).groupBy("bundle", "item").agg(F.coalesce(F.max(F.when(F.col("above") >= k, F.col("edge"))), F.lit(1)).alias("least"))


def _documents(carried: DataFrame, blocks: DataFrame, kind: T.DataType, k: int) -> DataFrame:
    """``(bundle, item, doc_id, score)``: the best ``k`` of each block, by score and id."""

    def run(key: tuple, accumulators: pa.Table, own: pa.Table) -> pa.Table:
        ids = own.column("ids").combine_chunks().flatten()
        parts = []
        for batch in accumulators.to_batches():
            for row in range(batch.num_rows):
                items, counts, slots, scores = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("items", "counts", "slots", "scores"))
                bundle = pa.array(np.full(len(slots), batch.column("bundle")[row].as_py()))
                parts.append(pa.table({"bundle": bundle, "item": pa.array(np.repeat(items, counts)), "doc_id": ids.take(pa.array(slots)), "score": pa.array(scores)}))
        return pa.concat_tables(parts) if parts else pa.table({"bundle": pa.array([], pa.int64()), "item": pa.array([], pa.int32()), "doc_id": ids[:0], "score": pa.array([], pa.int64())})

    schema = T.StructType([T.StructField("bundle", T.LongType()), T.StructField("item", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    return carried.select("block", "bundle", "items", "counts", "slots", "scores").groupBy("block").cogroup(blocks.select("block", "ids").groupBy("block")).applyInArrow(run, schema)


def search(df: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, bundle: int = BUNDLE) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of ``df`` for each row of ``items``.

    Terms are runs of ASCII letters and digits and all other non-ASCII characters, A-Z lower-cased.  A
    term's weight and its contribution to a document are integers (see ``_owners`` and ``_ratio``); a
    document's score is the sum over the item's distinct terms.  Documents without score are never
    listed; equal scores go by ascending id, null last.  Null and termless texts have no term; such
    items have no rows.  Every row of ``df`` is a document and every row of ``items`` an item of its
    own, repeated and null ids included.  A task holds ``block`` documents and ``bundle`` items.  Other columns are ignored; empty tables give no rows.
    """
    spark = df.sparkSession
    asked = stored(bundles(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), bundle), "lexical-items")
    whole = stored(index(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _wanted(asked), block), "lexical-index")
    blocks, postings = whole.where("term is null"), whole.where("term is not null")
    n = F.filter("sizes", lambda x: x > 0)
    documents, terms = blocks.agg(F.sum(F.size(n)), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    kind = whole.schema["ids"].dataType.elementType
    if not documents:
        schema = T.StructType([asked.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema).withColumnsRenamed({"item_id": item_col, "doc_id": id_col})

    owned = stored(asked.select("bundle", "item", "term").join(_owners(postings, documents, terms), "term"), "lexical-owned")
    stages = range(len(SHARES) + 1)
    later: list[Column] = [F.coalesce(F.sum(F.when(F.col("stage") > s, F.col("peak"))), F.lit(0)).alias(f"rest_{s}") for s in stages]
    rests = stored(owned.groupBy("bundle", "item").agg(*later), "lexical-rests")
    carried, least = spark.createDataFrame([], _CARRIED), rests.select("bundle", "item", F.lit(1).cast("long").alias("least"))
    for s in stages:
        bounds = rests.select("bundle", "item", F.col(f"rest_{s}").alias("rest")).join(least, ["bundle", "item"], "left").select("bundle", "item", "rest", F.coalesce("least", F.lit(1)).alias("least"))
        own = owned.where(F.col("stage") == s).join(bounds, ["bundle", "item"]).groupBy("bundle", "term", "weight").agg(F.collect_list(F.struct("item", "least", "rest")).alias("x"))
        wanted = own.select("bundle", "term", "weight", F.col("x.item").alias("items"), F.col("x.least").alias("leasts"), F.col("x.rest").alias("rests"))
        lists = postings.select("block", "term", "slots", "tfs", "sizes").join(wanted, "term").drop("term")
        met = carried.drop("seen").groupBy("block", "bundle").cogroup(lists.groupBy("block", "bundle")).applyInArrow(_stage(documents, terms, k, s == len(SHARES), block, bundle), _CARRIED)
        further = stored(met, "lexical-carried")
        if s:
            discard(carried)
        carried = further
        if s < len(SHARES):
            least = stored(_reached(carried, k), "lexical-reached")

    found = _documents(carried, blocks, kind, k)
    place = F.row_number().over(Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    named = asked.select("bundle", "item", "item_id").distinct()
    return best.join(named, ["bundle", "item"]).select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
