"""Toxicity by a linear-chain conditional random field over words.

Token labels come from document labels: a word of a toxic document is first labelled toxic if one of
its hashed features stands in toxic documents far more often than in others; then rounds of retagging
replace these labels by what the chain itself finds in the toxic documents.  The chain has two
states, emissions from hashed features of the word (whole, prefixes, suffix) and learned
transitions, and runs over the whole text, however long.  Forward-backward marginals give the
offending spans; their sum of squares and maximum, calibrated on the labelled documents, give the
score of a document.

Blocks of ``BLOCK`` words serve speed only: each block becomes the 2 by 2 matrix that carries a message
through it, messages pass from block to block along a text, and all blocks then run side by side
from the messages that enter them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .minhash import shingle_sets
from .storage import stored
from .text import LOWER, chunks, hash_spans, mix, utf8, word_spans

BITS, BLOCK = 20, 64
#: Features of a word: the seed of its hash, and how many first or last bytes count (0: all).
FEATURES = ((1, 0), (2, 4), (3, 6), (4, -5))
EDGE = np.zeros(256, bool)
EDGE[[k for k in range(33, 128) if not chr(k).isalnum()]] = True


@dataclass
class Model:
    emission: np.ndarray
    bias: float
    transition: np.ndarray
    start: np.ndarray
    calibration: np.ndarray


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (words, features), starts and ends of the words, first word of each text."""
    raw, at = utf8(column)
    raw = LOWER[raw]
    begins, ends, first = word_spans(raw, at)
    low, high = begins.copy(), ends.copy()
    for _ in range(3):  # punctuation around a word
        low += (low < high - 1) & EDGE[raw[low]] if len(low) else 0
        high -= (low < high - 1) & EDGE[raw[high - 1]] if len(high) else 0
    out = np.empty((len(FEATURES), len(begins)), np.int32)
    for k, (seed, size) in enumerate(FEATURES):
        a = np.maximum(low, high + size) if size < 0 else low
        b = np.minimum(high, low + size) if size > 0 else high
        out[k] = (hash_spans(raw, a, b, seed) >> np.uint64(64 - BITS)).astype(np.int32)
    return out.T, begins - np.repeat(at[:-1], np.diff(first)), ends - np.repeat(at[:-1], np.diff(first)), first


def blocks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the blocks into which the texts are cut."""
    n = np.diff(first)
    many = -(-n // BLOCK)
    index = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(first[:-1], many) + index * BLOCK
    return begin, np.minimum(BLOCK, np.repeat(first[1:], many) - begin)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(0)


def _messages(through: np.ndarray, first_block: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters every block from the left, and from the right; texts run side by side."""
    many = np.diff(first_block)
    order = np.argsort(-many, kind="stable")
    begin, many = first_block[:-1][order], many[order]
    enter, leave = np.empty((2, through.shape[2])), np.ones((2, through.shape[2]))
    enter[:, begin[many > 0]] = _scaled(np.exp(start))[:, None]
    for j in range(1, int(many.max(initial=0))):
        at = begin[: np.searchsorted(-many, -j, "left")] + j
        enter[:, at] = _scaled((enter[:, None, at - 1] * through[:, :, at - 1]).sum(0))
    for j in range(int(many.max(initial=0)) - 1, 0, -1):
        at = begin[: np.searchsorted(-many, -j, "left")] + j
        leave[:, at - 1] = _scaled((through[:, :, at] * leave[None, :, at]).sum(1))
    return enter, leave


def forward_backward(score: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state of every word, and expected transition counts (2, 2).

    ``score`` is the log odds of the toxic state by a word alone; text k has the words from
    ``first[k]`` to ``first[k + 1]``.
    """
    out, pairs = np.zeros(len(score)), np.zeros((2, 2))
    begin, length = blocks_of(first)
    if not len(begin):
        return out, pairs
    place = padded(begin, length)
    steps, blocks = place.shape
    inside = place >= 0
    e1 = np.append(np.exp(np.clip(score, -30, 30)), 1.0)[place]
    t = np.exp(transition)
    first_block = np.concatenate([[0], np.cumsum(-(-np.diff(first) // BLOCK))])
    opens = np.zeros(blocks, bool)
    opens[first_block[:-1][np.diff(first_block) > 0]] = True

    through = np.zeros((2, 2, blocks))
    through[0, 0] = through[1, 1] = 1
    for k in range(steps):
        left, right = through[:, 0], through[:, 1]
        one, two = left * t[0, 0] + right * t[1, 0], left * t[0, 1] + right * t[1, 1]
        if k == 0:
            one, two = np.where(opens, left, one), np.where(opens, right, two)
        two = two * e1[k]
        total = (one + two).sum(0)
        through = np.where(inside[k], np.stack([one, two], 1) / total, through)
    enter, leave = _messages(through, first_block, start)

    alpha = np.empty((steps, 2, blocks))
    now = enter
    for k in range(steps):
        moved = np.stack([now[0] * t[0, 0] + now[1] * t[1, 0], now[0] * t[0, 1] + now[1] * t[1, 1]])
        if k == 0:
            moved = np.where(opens, now, moved)
        moved[1] *= e1[k]
        alpha[k] = now = np.where(inside[k], moved / (moved[0] + moved[1]), now)
    beta = leave
    for k in range(steps - 1, -1, -1):
        own = inside[k]
        both = alpha[k] * beta
        out[place[k, own]] = (both[1] / (both[0] + both[1]))[own]
        ahead = np.stack([beta[0], beta[1] * e1[k]])
        joint = (alpha[k - 1] if k else enter)[:, None] * t[:, :, None] * ahead[None]
        linked = own if k else own & ~opens
        pairs += (joint[:, :, linked] / joint[:, :, linked].sum((0, 1))).sum(2)
        back = np.stack([t[0, 0] * ahead[0] + t[0, 1] * ahead[1], t[1, 0] * ahead[0] + t[1, 1] * ahead[1]])
        beta = np.where(own, back / back.sum(0), beta)
    return out, pairs


def padded(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Word of each step and block, -1 behind the end."""
    steps = np.arange(int(length.max(initial=0)))[:, None]
    return np.where(steps < length, begin + steps, -1)


def marginals(model: Model, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The toxic marginal of every word."""
    return forward_backward(model.emission[features].sum(1) + model.bias, first, model.transition, model.start)[0]


def summaries(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: constant, log of 1 + the sum of squared marginals, their maximum."""
    n = np.diff(first)
    out = np.zeros((len(n), 3))
    out[:, 0] = 1
    full = n > 0
    if full.any():
        out[full, 1] = np.log1p(np.add.reduceat(p * p, first[:-1][full]))
        out[full, 2] = np.maximum.reduceat(p, first[:-1][full])
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a minhash of five-word shingles, which near-copies mostly share."""
    for batch in chunks(batches, "text"):
        values, offsets = shingle_sets(batch.column("text"), 5)
        key = np.zeros(batch.num_rows, np.uint64)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            key[full] = np.minimum.reduceat(mix(values), offsets[:-1][full])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], [*batch.schema.names, "key"])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in chunks(batches, "text"):
        features, _, _, first = word_features(batch.column("text"))
        for k, label in enumerate(batch.column("label").to_pylist()):
            counts[label][np.unique(features[first[k] : first[k + 1]])] += 1
    at = np.flatnonzero(counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[1][at], pa.int64()), pa.array(counts[0][at], pa.int64())], ["feature", "toxic", "clean"])


def fit_chain(features: np.ndarray, tags: np.ndarray, first: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-4, model: Model | None = None) -> Model:
    """Maximum likelihood by AdaGrad over all texts, from ``model`` on if there is one."""
    model = model or Model(np.zeros(1 << BITS, np.float32), -2.0, np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    if not len(tags):
        return model
    opening = first[:-1][np.diff(first) > 0]
    linked = np.ones(len(tags), bool)
    linked[opening] = False
    tag = tags.astype(np.int64)
    observed = np.bincount((np.append(0, tag[:-1]) * 2 + tag)[linked], minlength=4).reshape(2, 2).astype(float)
    seen = [np.full(1 << BITS, 1e-8), 1e-8, np.full((2, 2), 1e-8), np.full(2, 1e-8)]
    n = max(1, int(tags.sum()))
    for _ in range(rounds):
        p, pairs = forward_backward(model.emission[features].sum(1) + model.bias, first, model.transition, model.start)
        rest = (tags - p) / n
        emission = np.bincount(features.ravel(), np.repeat(rest, features.shape[1]), 1 << BITS) - decay * model.emission
        begins = np.array([-rest[opening].sum(), rest[opening].sum()])
        for k, (name, slope) in enumerate((("emission", emission), ("bias", rest.sum()), ("transition", (observed - pairs) / n), ("start", begins))):
            seen[k] = seen[k] + slope**2
            setattr(model, name, getattr(model, name) + rate * slope / np.sqrt(seen[k]))
    model.emission = model.emission.astype(np.float32)
    return model


def retagged(model: Model, features: np.ndarray, first: np.ndarray, toxic: np.ndarray, at_least: float = 0.5, doubtful: float = 0.2) -> np.ndarray:
    """New labels: words that the chain finds in toxic documents, none in others.

    A toxic document without one keeps its most suspect word if that reaches ``doubtful``.
    """
    p = marginals(model, features, first)
    n = np.diff(first)
    most = np.zeros(len(n))
    most[n > 0] = np.maximum.reduceat(p, first[:-1][n > 0]) if len(p) else 0
    limit = np.where(most >= at_least, at_least, np.maximum(most, doubtful))
    return ((p >= np.repeat(limit, n)) & np.repeat(toxic, n)).astype(float)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.array([0.01, 1, 1]) * len(y) / 100
        slope = x.T @ (y - p) - penalty * w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), slope)
    return w


def fit(labelled: DataFrame, max_docs: int = 12_000, max_words: int = 400_000, longest: int = 20_000, retags: int = 2, least_docs: int = 5, lift: float = 3.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from ``labelled`` rows with a text and a label of 0 or 1.

    Documented bounds: about ``max_docs`` documents, by a hash of the id; the chain learns from whole
    documents of them with about ``max_words`` words in all, none of more than ``longest`` words.
    The driver gets the features with a lift of exp(``lift``) in at least ``least_docs`` toxic
    documents, the words of those whole documents, and three numbers for each document.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("text is not null and label in (0, 1)")
    total = rows.count()
    share = min(1.0, max_docs / max(1, total))
    sample = stored(rows.where(F.pmod(F.xxhash64(F.lit("toxic"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1)), "toxic-sample")
    # Copies of a text would make each of its rare words look frequent: one of a group counts.
    sets = sample.select("id", "text", "label").mapInArrow(_keyed, T.StructType([*sample.schema, T.StructField("key", T.LongType())]))
    single = stored(sets.groupBy("key").agg(F.min_by(F.struct("text", "label"), "id").alias("one")).select("one.*"), "toxic-single")
    n = {r["label"]: r["count"] for r in single.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    schema = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    odds = odds - F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))  # less its standard error
    found = single.select("text", "label").mapInArrow(_document_frequencies, schema).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= least_docs) & (odds >= lift))
    offending = np.zeros(1 << BITS, bool)
    offending[[r["feature"] for r in found.select("feature").collect()]] = True

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            features, _, _, first = word_features(batch.column("text"))
            out = []
            for label, a, b in zip(batch.column("label").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if 0 < b - a <= longest:
                    suspect = offending[features[a:b]].any(1)
                    kind = 2 if label and suspect.any() else int(suspect.any() or label)
                    out.append((features[a:b].tobytes(), (suspect & bool(label)).astype(np.int8).tobytes(), label, kind, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()))], ["features", "tags", "label", "kind", "words"])

    pieces = stored(single.select("text", "label").mapInArrow(tagged, "features binary, tags binary, label int, kind int, words long"), "toxic-words")
    words, taken = {r["kind"]: r["words"] for r in pieces.groupBy("kind").agg(F.sum("words").alias("words")).collect()}, None
    for kind in (2, 1, 0):  # with toxic words; clean with such words, or toxic without; other documents
        part = min(1.0, max_words / 3 / max(1, words.get(kind, 0)))
        some = pieces.where((F.col("kind") == kind) & (F.pmod(F.xxhash64("features"), F.lit(1 << 20)) < int(part * (1 << 20)) + (part == 1)))
        taken = some if taken is None else taken.unionByName(some)
    got = taken.select("features", "tags", "label").toArrow()
    rows = [np.frombuffer(x, np.int32).reshape(-1, len(FEATURES)) for x in got["features"].to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    features = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)), np.int32)
    tags = np.concatenate([np.frombuffer(x, np.int8) for x in got["tags"].to_pylist()]).astype(float) if rows else np.zeros(0)
    model = fit_chain(features, tags, first)
    for _ in range(retags):
        tags = retagged(model, features, first, np.array(got["label"].to_pylist(), bool))
        model = fit_chain(features, tags, first, rounds=20, rate=0.2, model=model)

    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            features, _, _, first = word_features(batch.column("text"))
            x = summaries(marginals(shared.value, features, first), first)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column("label").cast(pa.float64())], ["total", "most", "label"])

    facts = sample.select("text", "label").mapInArrow(measured, "total double, most double, label double").toArrow()
    if toxic and clean:
        x = np.column_stack([np.ones(facts.num_rows), facts["total"].to_numpy(), facts["most"].to_numpy()])
        model.calibration = calibrate(x, facts["label"].to_numpy())
    else:
        model.calibration = np.array([0.0 if not (toxic or clean) else (4.0 if toxic else -4.0), 0.0, 0.0])
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """``(id, score, spans)``: probability of toxicity and the offending spans.

    A span has the byte offsets ``begin`` and ``end`` in the UTF-8 text and the largest marginal of
    its words; neighbouring words whose marginals reach ``at_least`` make one span.  A null or
    wordless text gets the score of a text without evidence and no span.  Each row gives a row;
    other columns are ignored.  The model's size is fixed by ``BITS``.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in chunks(batches, "text"):
            features, begins, ends, first = word_features(batch.column("text"))
            p = marginals(own, features, first)
            logit = summaries(p, first) @ own.calibration
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            hits = np.flatnonzero(p >= at_least)
            texts = np.searchsorted(first, hits, "right") - 1
            before = (-2, -1)
            for word, text in zip(hits.tolist(), texts.tolist(), strict=True):
                if before == (word - 1, text):
                    spans[text][-1]["end"] = int(ends[word])
                    spans[text][-1]["p"] = max(spans[text][-1]["p"], float(p[word]))
                else:
                    spans[text].append({"begin": int(begins[word]), "end": int(ends[word]), "p": float(p[word])})
                before = (word, text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30)))), pa.array(spans, kind)], ["id", "score", "spans"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])))])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
