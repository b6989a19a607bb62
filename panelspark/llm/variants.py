"""Spelling variants: words that differ by one letter, found through a reduced alphabet.

Letters are hashed to a few symbols.  A word's reduced form then has few neighbours at one edit, so
that all of them can be generated: each deletion, each replacement by another symbol, each insertion,
and the form itself (two letters can share a symbol).  Joined with the reduced forms of the whole
vocabulary they give candidates, which are verified on the original words.

Neighbours are numbers: a polynomial hash of the symbols, of which prefix sums give every edit in one
step, however long the word.  Before they are shuffled they pass a bitmap of fixed size that the
vocabulary's own forms have set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, stored
from .text import chunks, mix

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the bitmap (16 MB), in slices that are built apart.
BITS, SLICE_BITS = 27, 7
#: Letters of which all neighbours are made at a time.
BLOCK = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_STEP, _BACK = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
_SIZE, _SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def occurrences(df: DataFrame, min_length: int = 7, min_count: int = 2, drop_every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: the words of all whole texts with their occurrences.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased.  Where
    the crc32 of ``<id>:<word>`` is a multiple of ``drop_every``, the word loses the letter at that
    number modulo its length: variants planted by a rule.  Words of fewer than ``min_length`` code
    points or ``min_count`` occurrences go.  A null text has no words, a null id counts as empty.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run")
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run).where(F.length("run") >= min_length)
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % drop_every == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Reduced:
    """Reduced forms of words, end to end, with what their neighbours' hashes need."""

    def __init__(self, words: list[str], symbols: int):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.size) - self.size
        self.constants = mix(np.arange(1, symbols + 1, dtype=np.uint64) * _SECOND)
        self.symbol = (mix(points.astype(np.uint64) + _STEP) % np.uint64(symbols)).astype(np.int64)
        self.owner = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(points)) - self.first[self.owner]
        self.power = np.ones(int(self.size.max(initial=0)) + 1, np.uint64)
        self.power[1:] = _STEP
        self.power = np.multiply.accumulate(self.power)
        self.term = self.constants[self.symbol] * self.power[self.place]
        sums = np.append(np.uint64(0), np.cumsum(self.term))
        self.before = sums[:-1] - sums[self.first][self.owner]
        self.total = sums[self.first + self.size] - sums[self.first]

    @staticmethod
    def key(value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(value + size.astype(np.uint64) * _SIZE)

    def own(self) -> np.ndarray:
        return self.key(self.total, self.size)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys at one edit, each once, and the words they are of; for blocks of letters."""
        yield self.own(), np.arange(len(self.size))
        for x in self.constants:  # a symbol behind the last one
            yield self.key(self.total + x * self.power[self.size], self.size + 1), np.arange(len(self.size))
        for low in range(0, len(self.symbol), BLOCK):
            at = slice(low, low + BLOCK)
            owner, place, symbol, term, before = self.owner[at], self.place[at], self.symbol[at], self.term[at], self.before[at]
            size, total, power = self.size[owner], self.total[owner], self.power[place]
            # Of equal symbols side by side, deleting any gives the same.
            fresh = (place == 0) | (symbol != np.append(-1, self.symbol)[low : low + len(symbol)])
            less = before + (total - before - term) * _BACK
            yield self.key(less, size - 1)[fresh], owner[fresh]
            for k, x in enumerate(self.constants):
                other = symbol != k
                yield self.key(total + x * power - term, size)[other], owner[other]
                # Before a symbol of its own kind, an insertion is the same as behind it.
                yield self.key(before + x * power + (total - before) * _STEP, size + 1)[other], owner[other]


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - BITS)
    return (keys >> shift).astype(np.int64), ((keys * _SECOND) >> shift).astype(np.int64)


def _keyed(words: DataFrame, symbols: int) -> DataFrame:
    """``(key, id)`` of each word's own form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "word", BLOCK):
            keys = Reduced(batch.column("word").to_pylist(), symbols).own()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("id")], ["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def _bitmap(keyed: DataFrame) -> np.ndarray:
    """The bits that the keys set, packed; slices of the bitmap are put together where their keys meet."""
    inner = BITS - SLICE_BITS

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_bits(batch.column("key").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array((at >> inner).astype(np.int32)), pa.array((at & ((1 << inner) - 1)).astype(np.int32))], ["slice", "bit"])

    def packed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << inner, bool)
        for batch in batches:
            on[batch.column("bit").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["slice", "bits"])

    set_bits = keyed.select("key").mapInArrow(positions, "slice int, bit int").distinct()
    out = np.zeros((1 << SLICE_BITS, (1 << inner) // 8), np.uint8)
    for row in set_bits.groupBy("slice").applyInArrow(packed, "slice int, bits binary").toArrow().to_pylist():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _candidates(words: DataFrame, keyed: DataFrame, symbols: int) -> DataFrame:
    """``(a, b)``: ids of words whose reduced forms are equal or at one edit."""
    shared = words.sparkSession.sparkContext.broadcast(_bitmap(keyed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in chunks(batches, "word", BLOCK):
            ids = batch.column("id").to_numpy()
            for keys, owner in Reduced(batch.column("word").to_pylist(), symbols).neighbours():
                one, two = _bits(keys)
                met = np.flatnonzero((bitmap[one >> 3] >> (7 - (one & 7)).astype(np.uint8)) & 1)
                two = two[met]
                met = met[(bitmap[two >> 3] >> (7 - (two & 7)).astype(np.uint8)) & 1 > 0]
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[met].view(np.int64)), pa.array(ids[owner[met]])], ["key", "a"])

    found = words.select("id", "word").mapInArrow(run, "key long, a long")
    return found.join(keyed.withColumnRenamed("id", "b"), "key").where("a != b").select("a", "b")


def near_words(words: DataFrame, symbols: int = 8) -> DataFrame:
    """``(id, n_near, best_n, best)`` for each of the stored ``words(id, word, n)`` that has near words.

    Near words differ by exactly one inserted, deleted or replaced code point; ``best`` is the one of
    largest n, ties to the smallest in code-point order.
    """
    keyed = stored(_keyed(words, symbols), "variant-keys")
    pairs = _candidates(words, keyed, symbols)
    of_b = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    of_a = words.select(F.col("id").alias("a"), F.col("word").alias("word_a"))
    near = pairs.join(of_b, "b").join(of_a, "a").where(F.levenshtein("word_a", "word_b", 1) == 1)
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("word_b").alias("word"))).alias("best")
    out = stored(near.groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("n_near"), best), "variant-near")
    discard(keyed)
    return out.select("id", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``(from, root)``: where each word of ``links(from, to)`` ends; every word has one link at most, and
    they make no ring.  Each round doubles the length of the ways."""
    ways = stored(links.select("from", F.col("to").alias("root")), "variant-roots")
    while True:
        ahead = ways.select(F.col("from").alias("at"), F.col("root").alias("further"))
        step = ways.join(ahead, F.col("root") == F.col("at"), "left").select("from", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        longer = stored(step, "variant-roots")
        discard(ways)
        ways = longer.select("from", "root")
        ways._stored_path = longer._stored_path
        if longer.where("moved").isEmpty():
            return ways


def group(words: DataFrame, ratio: int = 10, symbols: int = 8) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each row of ``words(word, n)``, whose words are distinct.

    ``form`` is a word's near word of largest n (ties: smallest in code-point order) if that has at
    least ``ratio`` times the word's n, which must be above 1, else null; ``root`` is where the forms
    lead, the word itself if it has none.  Null words are ignored; an empty table stays empty.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms end")
    whole = stored(words.where("word is not null").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "variant-words")
    near = near_words(whole, symbols)
    with_near = whole.join(near, "id", "left")
    formed: Column = F.col("best_n") >= ratio * F.col("n")
    out = with_near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).cast("long").alias("form_n"))
    out = stored(out, "variant-forms")
    ends = roots(out.where("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to")))
    discard(whole)
    return out.join(ends, F.col("word") == F.col("from"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
