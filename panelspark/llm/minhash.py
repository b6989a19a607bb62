"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

A document has two small collections of band values, ``side`` on the left and ``side`` on the
right, each of ``rows`` minhashes.  Every pair of a left and a right value is a key of one of
``side * side`` tables, so that 2 * side * rows minhashes serve side**2 bands of 2 * rows.  A pair
of similarity s meets in some table with probability (1 - (1 - s**rows)**side)**2: with the
defaults 0.99993 at s = 0.8 and over 0.999999 from 0.88.

Documents with equal shingle sets are one class; only classes are hashed into tables.  Within a
bucket of a table, members are first compared with the smallest member.  Links are confirmed on the
full sets and give components; only members of a bucket that are then still in different
components are compared with each other, behind exact bounds on their overlap.  In a crowded bucket
of that kind not all pairs are formed: its members meet where the rarest shingles of their sets
agree, as those of every pair of the wanted similarity must (prefix filtering, also exact).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected
from .ranges import sifted, spread_join
from .storage import discard, stored
from .text import LOWER, chunks, hash_spans, mix, utf8, word_spans

_M = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the parity sketch: the Hamming distance of two sketches is never above the size of the
#: symmetric difference of the sets.
SKETCH = 512
#: Members of a bucket up to which all its pairs are formed.
CROWD = 200
#: Rows of about 100 bytes about crowded documents that are broadcast; they are counted first.
CROWD_BROADCAST = 100_000


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and len + 1 offsets.

    A-Z count as a-z.  Fewer than ``k`` words make one shingle; no word makes none.
    """
    raw, at = utf8(column)
    raw = LOWER[raw]
    begins, ends, first = word_spans(raw, at)
    words = hash_spans(raw, begins, ends)
    n = np.diff(first)
    state = np.full(len(words), k, np.uint64)
    for j in range(k):
        span = len(words) - j
        if span > 0:
            state[:span] = mix(state[:span] * _M ^ words[j:])
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=offsets[1:])
    values = state[np.repeat(first[:-1] - offsets[:-1], count) + np.arange(offsets[-1])] if len(words) else state
    for d in np.flatnonzero((n > 0) & (n < k)).tolist():
        own = np.full(1, n[d], np.uint64)
        for word in words[first[d] : first[d + 1]]:
            own = mix(own * _M ^ word)
        values[offsets[d]] = own[0]
    for d in np.flatnonzero(count > 1).tolist():
        values[offsets[d] : offsets[d + 1]].sort()
    fresh = np.ones(len(values), bool)
    if len(values):
        fresh[1:] = values[1:] != values[:-1]
        fresh[offsets[:-1][count > 0]] = True
    kept = np.zeros(len(values) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    return values[fresh], kept[offsets]


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _M)
    return seed[:n], seed[n:] | np.uint64(1)


def signature_batch(column: pa.Array, k: int, rows: int, side: int) -> list[pa.Array]:
    """Columns n, set_a, set_b, left, right, sketch for the texts of ``column``."""
    values, offsets = shingle_sets(column, k)
    n = np.diff(offsets)
    full = np.flatnonzero(n > 0)
    at = offsets[:-1][full]
    size = len(column)
    set_a, set_b = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    bands = np.zeros((len(full), 2 * side), np.uint64)
    sketch = np.zeros((len(full), SKETCH // 8), np.uint8)
    if len(full):
        set_a[full], set_b[full] = np.add.reduceat(values, at), np.add.reduceat(mix(values ^ _M), at)
        shift, factor = _constants(2 * side * rows)
        for c in range(2 * side * rows):
            hashed = (values ^ shift[c]) * factor[c]
            hashed ^= hashed >> np.uint64(29)
            bands[:, c // rows] = mix(bands[:, c // rows] * _M ^ np.minimum.reduceat(hashed, at))
        owner = np.repeat(np.arange(len(full)), n[full])
        for begin in range(0, len(full), 2048):
            low, high = at[begin], offsets[full[min(begin + 2048, len(full)) - 1] + 1]
            cell = (owner[low:high] - begin) * SKETCH + (values[low:high] & np.uint64(SKETCH - 1)).astype(np.int64)
            many = min(2048, len(full) - begin)
            odd = (np.bincount(cell, minlength=many * SKETCH) & 1).astype(np.uint8).reshape(many, SKETCH)
            sketch[begin : begin + many] = np.packbits(odd, axis=1)

    def lists(matrix: np.ndarray) -> pa.Array:
        width = np.zeros(size + 1, np.int32)
        width[1:] = np.cumsum((n > 0) * matrix.shape[1])
        return pa.ListArray.from_arrays(pa.array(width), pa.array(matrix.reshape(-1).view(np.int64)))

    return [pa.array(n, pa.int64()), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), lists(np.ascontiguousarray(bands[:, :side])), lists(np.ascontiguousarray(bands[:, side:])), lists(sketch.view(np.uint64))]


def signatures(df: DataFrame, k: int, rows: int, side: int) -> DataFrame:
    """``(id, n, set_a, set_b, left, right, sketch)`` for ``df(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), *signature_batch(batch.column("text"), k, rows, side)], ["id", "n", "set_a", "set_b", "left", "right", "sketch"])

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([df.schema["id"], *[T.StructField(x, T.LongType()) for x in ("n", "set_a", "set_b")], *[T.StructField(x, longs) for x in ("left", "right", "sketch")]])
    return df.select("id", "text").mapInArrow(run, schema)


def intersections(left: pa.Array, right: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of both shingle sets and of their intersection, row by row."""
    a, at_a = shingle_sets(left, k)
    b, at_b = shingle_sets(right, k)
    shared = [len(np.intersect1d(a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]], assume_unique=True)) for i in range(len(left))]
    return np.diff(at_a), np.diff(at_b), np.array(shared, np.int64)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are similar enough.

    The texts that any pair needs are picked first: a bitmap of fixed size holds back most of the
    others, and only the rest is shuffled.  A centre is ``a`` of any number of pairs, which are spread; as ``b`` a
    document has at most a pair for each of its buckets, or as many as share its rare shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_a", 1 << 20):
            size_a, size_b, both = intersections(batch.column("text_a"), batch.column("text_b"), k)
            ok = pa.array((both > 0) & (100 * both >= percent * (size_a + size_b - both)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    pairs = stored(pairs.select("a", "b"), "minhash-pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("needed")).distinct(), "minhash-needed")
    some, _ = sifted(texts, "id", ids, "needed")
    own = stored(some.join(ids.hint("merge"), F.col("id") == F.col("needed"), "left_semi"), "minhash-texts")
    of_a = own.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    of_b = own.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = spread_join(pairs.select("a", "b").join(of_b, "b"), of_a, "a", "b")
    links = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(run, pairs.select("a", "b").schema), "minhash-links")
    discard(own, ids, pairs)
    return links


def prefixes(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``(id, label, n, sketch, shingle)``: for each row of ``texts(id, label, n, sketch, text)`` its rarest
    shingles, so many that two sets of the wanted similarity have one of them in common.

    Shingles are ordered by the number of texts that have them, then by value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            values, offsets = shingle_sets(batch.column("text"), k)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            for at in range(0, len(values), 1 << 18):
                some = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner[some])), pa.array(values[some].view(np.int64))], ["id", "shingle"])

    schema = T.StructType([texts.schema["id"], T.StructField("shingle", T.LongType())])
    rows = stored(texts.select("id", "text").mapInArrow(run, schema), "minhash-shingles")
    counts = rows.groupBy(F.col("shingle").alias("s")).agg(F.count("*").alias("texts"))
    counted = spread_join(rows.withColumn("s", F.col("shingle")), counts, "s", "id")
    rarest = counted.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("texts", "shingle")))
    facts = texts.select(F.col("id").alias("of"), "label", "n", "sketch")
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return rarest.join(facts, F.col("id") == F.col("of")).where(F.col("place") <= needed).select("id", "label", "n", "sketch", "shingle")


def _may_be_similar(percent: int) -> Column:
    """False only if sizes or sketches of x and y exclude the similarity."""
    apart = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    total = F.col("x.n") + F.col("y.n")
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    return sizes & ((total - apart) * (100 + percent) >= 2 * percent * total)


def near_duplicates(
    df: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    rows: int = 2,
    side: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, a row for each id of ``df``.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``shingle``-word
    shingles; ``component_id`` is the smallest id that can be reached by links and ``kept`` whether
    that is the id itself.  Null or wordless texts have an empty set and no link.  Rows that repeat
    an id stand for one document with the greatest of their texts.  Rows with a null id have no
    links, a null component and are kept.  Other columns are ignored; an empty table gives an empty
    result.
    """
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = named.where("id is not null")
    signed = stored(signatures(named, shingle, rows, side), "minhash-signatures")
    if not signed.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        texts = texts.groupBy("id").agg(F.max("text").alias("text"))
        signed = stored(signatures(texts.unionByName(named.where("id is null")), shingle, rows, side), "minhash-signatures")

    sets = ["n", "set_a", "set_b"]
    classes = stored(signed.where("n > 0 and id is not null").groupBy(*sets).agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("left", "right", "sketch")]), "minhash-classes")
    entries = classes.select("rep", "right", F.posexplode("left").alias("i", "l")).select("rep", "i", "l", F.posexplode("right").alias("j", "r"))
    entries = stored(entries.select(F.xxhash64("i", "j", "l", "r").alias("key"), "rep"), "minhash-entries")
    buckets = entries.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1")
    members = stored(entries.join(buckets, "key"), "minhash-members")
    discard(entries)

    stars = stored(members.where("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "minhash-stars")
    bounded = _bounded(stars, classes, percent)
    links = confirmed(bounded, texts, shingle, percent)

    label = connected(links)
    marked = members.select("key", "rep", "members").join(label, F.col("rep") == F.col("node"), "left").select("key", "rep", "members", F.coalesce("component", "rep").alias("label"))
    marked = stored(marked, "minhash-marked")
    mixed = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    beside = stored(marked.join(mixed, "key"), "minhash-mixed")
    side_by_side = beside.where(F.col("members") <= CROWD).join(classes.select("rep", "n", "sketch"), "rep").select("key", F.col("rep").alias("id"), "label", "n", "sketch")
    rest = _across(side_by_side, "key", percent)
    crowd = stored(beside.where(F.col("members") > CROWD).select(F.col("rep").alias("c"), F.col("label")).distinct(), "minhash-crowd")
    if not crowd.isEmpty():
        facts = crowd.join(classes.select("rep", "n", "sketch"), F.col("c") == F.col("rep")).drop("rep")
        if facts.count() <= CROWD_BROADCAST:
            facts = F.broadcast(facts)
        whole = stored(texts.join(facts, F.col("c") == F.col("id")).select("id", "label", "n", "sketch", "text"), "minhash-crowd-texts")
        heads = stored(prefixes(whole, shingle, percent), "minhash-prefixes")
        shared = heads.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("shingle")
        rest = rest.unionByName(_across(stored(heads.join(shared, "shingle"), "minhash-shared"), "shingle", percent))
    rest = rest.distinct().join(stars, ["a", "b"], "left_anti")
    more = confirmed(rest, texts, shingle, percent)
    discard(members, marked, beside, crowd, stars)
    if not more.isEmpty():
        label = connected(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    whole = classes.select(F.struct(*sets).alias("set"), "rep").join(label, F.col("rep") == F.col("node"), "left").select("set", F.coalesce("component", "rep").alias("component"))
    linked = F.coalesce((F.col("n") > 0) & F.col("id").isNotNull(), F.lit(False))
    alone = signed.where(~linked).select("id", "n", F.col("id").alias("component"))
    # All copies of a text share a set: their join is spread over the ids.
    named_ones = signed.where(linked).select("id", "n", F.struct(*sets).alias("set"))
    out = stored(spread_join(named_ones, whole, "set", "id").select("id", "n", "component").unionByName(alone), "minhash-components")
    discard(signed, classes)
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def _across(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``rows(key, id, label, n, sketch)`` that share a key but no label, unless sizes or
    sketches exclude them."""
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & _may_be_similar(percent))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches don't exclude."""
    of_a = classes.select(F.col("rep").alias("a"), F.struct("n", "sketch").alias("x"))
    of_b = classes.select(F.col("rep").alias("b"), F.struct("n", "sketch").alias("y"))
    joined = spread_join(pairs, of_a, "a", "b").join(of_b, "b")
    return joined.where(_may_be_similar(percent)).select("a", "b")


def deduplicated(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` of which one document of each group of near-duplicates is left.

    Of rows that repeat an id one stays; rows with a null id all stay.  Only rows whose id a bitmap of
    the removed ones holds are shuffled, to be compared with these.
    """
    gone = near_duplicates(df, id_col=id_col, **options).where(~F.col("kept")).select(F.col(id_col).alias("__gone"))
    text_col = options.get("text_col", "text")
    doubtful, safe = sifted(df.where(F.col(id_col).isNotNull()), id_col, gone, "__gone")
    chosen = safe.unionByName(doubtful.join(gone.hint("merge"), F.col(id_col) == F.col("__gone"), "left_anti"))
    repeated = not df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()
    if repeated:
        rest = [c for c in df.columns if c != id_col]
        best = F.max_by(F.struct(*rest), F.struct(F.col(text_col), F.to_json(F.struct(*rest)))).alias("__row")
        chosen = chosen.groupBy(id_col).agg(best).select(*[F.col(id_col) if c == id_col else F.col(f"__row.{c}").alias(c) for c in df.columns])
    return chosen.unionByName(df.where(F.col(id_col).isNull()))
