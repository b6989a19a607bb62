"""Quality grades by cumulative-link (proportional odds) regression.

A text is the square roots of its relative frequencies of hashed character n-grams, and a few
ratios.  All grades share one weight vector; ordered thresholds cut the line that it projects on.
P(grade <= j) = logistic(threshold_j - weights . x) gives an expected grade and the tail
probability by which texts are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored
from .text import LOWER, chunks, hash_spans, mix, utf8, word_spans

BITS, EXTRA = 12, 3
WIDTH = (1 << BITS) + EXTRA
#: Texts that are turned into dense rows at a time: with their counts, about 50 MB.
ROWS = 512


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray


def vectors(column: pa.Array) -> np.ndarray:
    """A row for each text: root frequencies of 1- to 3-grams of bytes, then the square roots of the
    shares of words that repeat the word before, of words seen before, and of words at all."""
    raw, at = utf8(column)
    raw = LOWER[raw]
    n = len(column)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(raw):
        return out
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    counts = np.zeros(n << BITS, np.int32)
    code = raw.astype(np.uint64)
    state = np.zeros(len(raw), np.uint64)
    for back in range(3):
        shifted = np.concatenate([np.zeros(back, np.uint64), code[: len(code) - back]])
        state = state * np.uint64(257) + shifted + np.uint64(1)
        inside = np.arange(len(raw)) - np.repeat(at[:-1], size) >= back
        bucket = (mix(state) >> np.uint64(64 - BITS)).astype(np.int64)
        counts += np.bincount((owner << BITS | bucket)[inside], minlength=len(counts)).astype(np.int32)
    out[:, : 1 << BITS] = np.sqrt(counts.reshape(n, -1) / np.maximum(1, 3 * size)[:, None])
    begins, ends, first = word_spans(raw, at)
    words = hash_spans(raw, begins, ends)
    many = np.diff(first)
    of = np.repeat(np.arange(n), many)
    if len(words):
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        order = np.lexsort((words, of))
        again = np.zeros(len(words), bool)
        again[1:] = (words[order][1:] == words[order][:-1]) & (of[order][1:] == of[order][:-1])
        out[:, -3] = np.sqrt(np.bincount(of[same], minlength=n) / np.maximum(1, many))
        out[:, -2] = np.bincount(of[order][again], minlength=n) / np.maximum(1, many + 50)
    out[:, -1] = 0.2 * (many > 0)
    return out


def cuts_of(free: np.ndarray, width: int) -> np.ndarray:
    """Ordered thresholds: the first one is free, the others add the exponentials of theirs."""
    return np.cumsum(np.concatenate([free[width : width + 1], np.exp(free[width + 1 :])]))


def slope_of(free: np.ndarray, x: np.ndarray, y: np.ndarray, levels: int, decay: float = 1e-4) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with its penalty, and the gradient by weights and thresholds."""
    width, rows = x.shape[1], np.arange(len(y))
    w, cut = free[:width], cuts_of(free, width)
    line = (x @ w.astype(x.dtype)).astype(np.float64)
    edge = 1 / (1 + np.exp(-np.clip(cut[None] - line[:, None], -30, 30)))
    below = np.concatenate([np.zeros((len(y), 1)), edge, np.ones((len(y), 1))], 1)
    slope = below * (1 - below)
    inside = np.maximum(below[rows, y + 1] - below[rows, y], 1e-9)
    high, low = slope[rows, y + 1] / inside, slope[rows, y] / inside
    g_line = (high - low) / len(y)
    g_cut = np.zeros(levels + 1)
    np.add.at(g_cut, y + 1, -high / len(y))
    np.add.at(g_cut, y, low / len(y))
    tail = np.cumsum(g_cut[1:-1][::-1])[::-1]
    gradient = np.concatenate([x.T @ g_line.astype(x.dtype) + decay * w, tail[:1], tail[1:] * np.exp(free[width + 1 :])])
    return float(-np.log(inside).mean() + decay / 2 * (w @ w)), gradient


def learn(x: np.ndarray, y: np.ndarray, levels: int, rounds: int = 200, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the full likelihood; ``y`` counts from 0."""
    share = np.clip(np.cumsum(np.bincount(y, minlength=levels))[:-1] / max(1, len(y)), 0.01, 0.99)
    cut = np.log(share / (1 - share))
    free = np.concatenate([np.zeros(x.shape[1]), cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    first, second = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, rounds + 1):
        _, gradient = slope_of(free, x, y, levels, decay)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        free = free - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return free[: x.shape[1]], cuts_of(free, x.shape[1])


def fit(graded: DataFrame, max_rows: int = 5_000, max_grades: int = 100, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Learn from ``graded`` rows with a text and an integer grade.

    ``max_rows`` is the documented bound: of more rows, about so many are taken by a hash of the id.
    Their vectors, a bounded table, go to the driver.  With a single grade the model always says
    that one; without any it says nothing.  More than ``max_grades`` grades are an error.
    """
    rows = graded.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(grade_col).cast("int").alias("grade")).where("text is not null and grade is not null")
    per = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().limit(max_grades + 1).collect()}
    if len(per) > max_grades:
        raise ValueError(f"more than {max_grades} grades")
    grades = sorted(per)
    if len(per) < 2:
        return Model(grades, np.zeros(WIDTH), np.zeros(0))
    share = min(1.0, max_rows / sum(per.values()))
    sample = stored(rows.where(F.pmod(F.xxhash64(F.lit("grade"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1)), "grade-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20, ROWS):
            x = vectors(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([row.astype(np.float16).tobytes() for row in x], pa.binary())], ["grade", "x"])

    got = sample.select("text", "grade").mapInArrow(run, "grade int, x binary").toArrow()
    x = np.empty((got.num_rows, WIDTH), np.float32)
    for k, row in enumerate(got["x"]):
        x[k] = np.frombuffer(row.as_buffer(), np.float16)
    y = np.searchsorted(grades, got["grade"].to_numpy())
    return Model(grades, *(learn(x, y, len(grades)) if len(y) else (np.zeros(WIDTH), np.zeros(len(grades) - 1))))


def chances(model: Model, column: pa.Array) -> np.ndarray:
    """The probability of each grade, a row for each text."""
    line = vectors(column).astype(np.float64) @ model.weights
    below = 1 / (1 + np.exp(-np.clip(model.thresholds[None] - line[:, None], -30, 30)))
    return np.diff(np.concatenate([np.zeros((len(line), 1)), below, np.ones((len(line), 1))], 1), axis=1)


def predict(df: DataFrame, model: Model, at_least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, expected_grade, tail_probability)``: the mean of the grade's distribution, and the
    probability that it is ``at_least`` or more; both null if the model knows no grade.

    A null text counts as empty.  Each row gives a row; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        grades = np.array(own.grades, float)
        for batch in chunks(batches, "text", 1 << 20, ROWS):
            if len(grades):
                p = chances(own, batch.column("text"))
                out = [pa.array(p @ grades), pa.array(p[:, grades >= at_least].sum(1))]
            else:
                out = [pa.nulls(batch.num_rows, pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), *out], ["id", "expected_grade", "tail_probability"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
