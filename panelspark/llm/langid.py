"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import chunks, mix

UNKNOWN = "und"


@dataclass
class Model:
    """``weights[bucket, language]`` holds log probabilities, ``prior`` those of the languages."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    bits: int
    orders: tuple[int, ...]


def grams(texts: list[str], bits: int, orders: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each order by their last position, which text each position is of,
    and whether each text has a letter.

    Texts are lower-cased; a run of anything but letters counts as one blank.  A text begins behind
    blanks and ends with one, and no n-gram reaches into the text before it.
    """
    lowered = [x.lower() for x in texts]
    points = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) + 1 for x in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    starts = np.cumsum(size) - size
    letter = LETTERS()[np.minimum(points, 0x10FFFF)]
    before = np.append(False, letter[:-1])
    before[starts] = False
    keep = letter | before
    owner = owner[keep]
    seen = np.bincount(owner, minlength=len(texts)) > 0
    points = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64)
    place = np.arange(len(points)) - np.searchsorted(owner, owner)
    out = []
    for n in orders:
        state = np.full(len(points), n, np.uint64)
        for back in range(n):
            shifted = np.full(len(points), 32, np.uint64)
            shifted[back:] = points[: max(0, len(points) - back)]
            shifted[place < back] = 32
            state = state * np.uint64(0x100000001B3) ^ shifted
        out.append((mix(state) >> np.uint64(64 - bits)).astype(np.int64))
    return out, owner, seen


_letters: list[np.ndarray] = []


def LETTERS() -> np.ndarray:
    if not _letters:
        codes = np.arange(0x110000)
        _letters.append(np.array([chr(c).isalpha() for c in codes.tolist()]))
    return _letters[0]


def _counter(bits: int, orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        counts = np.zeros((0, 1 << bits), np.int64)
        for batch in chunks(batches, "text"):
            labels = batch.column("lang").to_pylist()
            for x in labels:
                known.setdefault(x, len(known))
            if len(known) > len(counts):
                counts = np.concatenate([counts, np.zeros((len(known) - len(counts), 1 << bits), np.int64)])
            flat = counts.reshape(-1)
            found, owner, _ = grams([x or "" for x in batch.column("text").to_pylist()], bits, orders)
            of = np.array([known[x] for x in labels])[owner]
            for buckets in found:
                np.add.at(flat, (of << bits) | buckets, 1)
        for name, k in known.items():
            at = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[k][at], pa.int64())], ["lang", "bucket", "n"])

    return run


def fit(labelled: DataFrame, max_rows: int | None = None, max_languages: int = 1000, bits: int = 14, orders: tuple[int, ...] = (1, 2, 3), smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``labelled`` that have a text and a language.

    All of them are counted; ``max_rows`` takes about so many by a hash of the id, and all rows of
    languages that have no more than their equal part of it.  A label column with more than
    ``max_languages`` values is an error: that bounds the model, and no label is left out unseen.
    Only n-gram counts, at most ``max_languages`` times 2**bits rows, reach the driver.  The model
    knows the languages that have counts.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()}
    if len(per) > max_languages:
        raise ValueError(f"more than max_languages = {max_languages} labels in {lang_col!r}; raise it, or clean the labels")
    if max_rows is not None and sum(per.values()) > max_rows:
        most = max_rows / len(per)
        cut = F.lit(1 << 20)
        for name in (x for x in per if per[x] > most):
            cut = F.when(F.col("lang") == name, int(most / per[name] * (1 << 20))).otherwise(cut)
        rows = rows.where(F.pmod(F.xxhash64(F.lit("lang"), "id"), F.lit(1 << 20)) < cut)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    counted = rows.select("text", "lang").mapInArrow(_counter(bits, orders), schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted["lang"].to_pylist()))
    place = {x: k for k, x in enumerate(names)}
    counts = np.zeros((1 << bits, len(names)))
    if counted.num_rows:
        codes = counted["lang"].combine_chunks().dictionary_encode()
        at = np.array([place[x] for x in codes.dictionary.to_pylist()])[codes.indices.to_numpy()]
        counts[counted["bucket"].to_numpy(), at] = counted["n"].to_numpy()
    weights = np.log((counts + smoothing) / (counts.sum(0) + smoothing * (1 << bits)))
    prior = np.log(np.array([per[x] for x in names], float) / sum(per[x] for x in names)) if names else np.zeros(0)
    return Model(names, weights.astype(np.float32), prior, bits, orders)


def classify(model: Model, texts: list[str | None], evidence: int = 120) -> tuple[list[str], np.ndarray]:
    """The most probable language, and a probability that is comparable over lengths.

    The language is that of the plain sum of log prior and log likelihoods.  N-grams of a text
    depend on each other, so that this sum is far too certain of long texts: for the probability
    only, it is scaled down to that of ``evidence`` n-grams, which never changes the order.
    """
    n = len(texts)
    found, owner, seen = grams([x or "" for x in texts], model.bits, model.orders)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    total = np.zeros((n, len(model.languages)))
    first = np.searchsorted(owner, np.arange(n))
    for buckets in found:
        for k in range(len(model.languages)):
            total[seen, k] += np.add.reduceat(model.weights[:, k].astype(np.float64)[buckets], first[seen])
    logits = model.prior + total
    best = logits.argmax(1)
    size = np.maximum(1, np.bincount(owner, minlength=n) * len(found))
    p = np.exp((logits - logits.max(1, keepdims=True)) * np.minimum(1, evidence / size)[:, None])
    named = [model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), seen.tolist(), strict=True)]
    return named, np.where(seen, 1 / p.sum(1), 0.0)


def predict(df: DataFrame, model: Model, text_col: str = "text", prefix: str = "lang_", keep: list[str] | Column | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (all by default) with ``<prefix>pred`` and ``<prefix>score``.

    A null text, or one without a letter, is ``und`` with score 0.  Columns of ``df`` that have the
    names of the two new ones are replaced.  The model is broadcast: its size is languages times
    2**bits numbers.
    """
    names = (f"{prefix}pred", f"{prefix}score")
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    text, more = (text_col, []) if text_col in kept else ("__text", [df[text_col].alias("__text")])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            pred, score = classify(shared.value, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, *names])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return df.select(*[df[c] for c in kept], *more).mapInArrow(run, schema)
