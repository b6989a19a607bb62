"""A multilayer perceptron with weights, class balance, early stopping and two loss curves.

Rows are packed once into blocks, the bytes of their matrices, which are dealt evenly to all cores and
kept.  Every epoch is one pass over them: tasks add up the gradient and the loss of their blocks, and a
sum by parameter joins those of the tasks.  The driver holds the parameters, whose number the layers
fix, and makes an Adam step with decoupled weight decay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.ranking import discard, stored

#: Numbers of a block, about, and partitions of the blocks for each core.
BLOCK, SPREAD = 1 << 16, 2
#: Up to so many numbers the sums of all tasks are added on the driver, which spares a shuffle in every epoch;
#: beyond them tasks add them up, so many parameters in each.
AT_ONCE, PARAMETERS = 1 << 20, 1 << 16


def _shapes(layers: list[int]) -> list[tuple[int, int]]:
    """A matrix of each layer; its last row holds the constants."""
    return [(a + 1, b) for a, b in zip(layers, layers[1:], strict=False)]


def _matrices(flat: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _shapes(layers):
        size = shape[0] * shape[1]
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def forward(flat: np.ndarray, layers: list[int], x: np.ndarray) -> list[np.ndarray]:
    """Inputs of every layer, hidden ones through tanh, and the logits at last."""
    steps = [x]
    matrices = _matrices(flat, layers)
    for k, m in enumerate(matrices):
        z = steps[-1] @ m[:-1] + m[-1]
        steps.append(np.tanh(z) if k + 1 < len(matrices) else z)
    return steps


def loss_and_gradient(flat: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows of the weighted cross entropy and its gradient."""
    steps, matrices = forward(flat, layers, x), _matrices(flat, layers)
    logit = steps[-1][:, 0]
    loss = float((weight * (np.logaddexp(0.0, logit) - y * logit)).sum())
    off = (weight * (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y))[:, None]
    parts = []
    for k in range(len(matrices) - 1, -1, -1):
        parts.append(np.concatenate([steps[k].T @ off, off.sum(0)[None]]).ravel())
        if k:
            off = off @ matrices[k][:-1].T * (1 - steps[k] ** 2)
    return loss, np.concatenate(parts[::-1])


@dataclass
class Perceptron:
    """``fit`` returns a model; ``balance`` weighs positives by negatives over positives.

    The learning rate halves when the loss that is watched, on ``valid`` or else the training one,
    hasn't fallen for ``plateau`` epochs; with ``valid``, training ends after ``patience`` such epochs, and
    the parameters of the best epoch are kept.
    """

    hidden: list[int]
    max_iter: int = 100
    rate: float = 0.05
    decay: float = 1e-5
    patience: int = 10
    plateau: int = 5
    least_gain: float = 1e-6
    balance: bool = True
    seed: int = 42

    def fit(self, train: DataFrame, label: str, features: str, weight: str | None = None, valid: DataFrame | None = None) -> PerceptronModel:
        """Rows without a label or with weight 0 teach nothing; missing features are an error."""
        width = len(train.select(vector_to_array(F.col(features)).alias("v")).first()["v"])
        layers = [width, *self.hidden, 1]

        def plain(df: DataFrame, held: bool) -> DataFrame:
            own = F.lit(1.0) if weight is None or weight not in df.columns else F.col(weight).cast("double")
            return df.where(F.col(label).isNotNull()).select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), own.alias("w"), F.lit(held).alias("held"))

        rows = plain(train, False) if valid is None else plain(train, False).unionByName(plain(valid, True))
        written = stored(_blocks(rows, width), "perceptron-blocks")  # an epoch then plans a scan, not all that made the rows
        blocks = written.persist(StorageLevel.MEMORY_AND_DISK)
        sums = {(r["held"], up): r["p" if up else "n"] for r in blocks.groupBy("held").agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n")).collect() for up in (False, True)}
        positive = sums.get((False, False), 0.0) / sums[False, True] if self.balance and sums.get((False, True)) else 1.0
        total = {held: sums.get((held, False), 0.0) + positive * sums.get((held, True), 0.0) for held in (False, True)}
        rng = np.random.default_rng(self.seed)
        flat = np.concatenate([np.concatenate([rng.normal(0, 1 / np.sqrt(a - 1 or 1), (a - 1, b)), np.zeros((1, b))]).ravel() for a, b in _shapes(layers)])
        mean, square, rate = np.zeros_like(flat), np.zeros_like(flat), self.rate
        best, since, watched = flat, 0, np.inf
        history: dict[str, list[float]] = {"train": []} | ({"valid": []} if valid is not None else {})
        for step in range(1, self.max_iter + 1):
            loss, held_loss, gradient = _pass(blocks, flat, layers, positive)
            history["train"].append(loss / max(total[False], 1e-12))
            if valid is not None:
                history["valid"].append(held_loss / max(total[True], 1e-12))
            now = history["valid" if valid is not None else "train"][-1]
            if now < watched - self.least_gain:
                best, since, watched = flat, 0, now
            else:
                since += 1
                if since % self.plateau == 0:
                    rate /= 2
                if valid is not None and since >= self.patience:
                    break
            gradient = gradient / max(total[False], 1e-12)
            mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
            flat = flat * (1 - rate * self.decay) - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        blocks.unpersist()
        discard(written)
        return PerceptronModel(layers, best, features, history)


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """``(held, positives, negatives, x, y, w)``: weights of both classes, and bytes of doubles.

    The number of partitions does not follow the size of the rows as they are stored: few, small ones
    would leave cores idle in every epoch.
    """
    most = max(1, BLOCK // max(width, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            if np.isnan(x).any():
                raise ValueError("the perceptron takes no missing features: impute them")
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy(zero_copy_only=False)
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            out: dict[str, list] = {c: [] for c in ("held", "positives", "negatives", "x", "y", "w")}
            for part in (False, True):
                at = np.flatnonzero(held == part)
                for start in range(0, len(at), most):
                    own = at[start : start + most]
                    up = y[own] > 0.5
                    values = (part, float(w[own][up].sum()), float(w[own][~up].sum()), x[own].tobytes(), y[own].tobytes(), w[own].tobytes())
                    for c, v in zip(out, values, strict=True):
                        out[c].append(v)
            types = [pa.bool_(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    packed = rows.mapInArrow(run, "held boolean, positives double, negatives double, x binary, y binary, w binary")
    return packed.repartition(SPREAD * rows.sparkSession.sparkContext.defaultParallelism)


def _pass(blocks: DataFrame, flat: np.ndarray, layers: list[int], positive: float) -> tuple[float, float, np.ndarray]:
    """Loss of the training and the held-out rows, and the training gradient; summed by parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(flat) + 2)
        for batch in batches:
            for held, *parts in zip(*(batch.column(c) for c in ("held", "x", "y", "w")), strict=True):
                x, y, weight = (np.frombuffer(p.as_buffer(), dtype=float) for p in parts)
                x, weight = x.reshape(len(y), -1), weight * np.where(y > 0.5, positive, 1.0)
                if held.as_py():
                    logit = forward(flat, layers, x)[-1][:, 0]
                    out[1] += float((weight * (np.logaddexp(0.0, logit) - y * logit)).sum())
                else:
                    loss, gradient = loss_and_gradient(flat, layers, x, y, weight)
                    out[0] += loss
                    out[2:] += gradient
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["at", "value"])

    found, n = blocks.mapInArrow(run, "at int, value double"), len(flat) + 2
    if n * SPREAD * blocks.sparkSession.sparkContext.defaultParallelism > AT_ONCE:
        found = found.repartition(-(-n // PARAMETERS), "at").groupBy("at").agg(F.sum("value").alias("value"))
    summed, out = found.toArrow(), np.zeros(n)
    np.add.at(out, summed["at"].to_numpy(), summed["value"].to_numpy())
    return float(out[0]), float(out[1]), out[2:]


@dataclass
class PerceptronModel:
    layers: list[int]
    flat: np.ndarray
    features: str = "features"
    history: dict[str, list[float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``, a vector of both classes' probabilities."""
        flat, layers = self.flat, self.layers

        @F.pandas_udf("double")
        def positive(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            logit = forward(flat, layers, np.stack(x.to_numpy()))[-1][:, 0]
            if np.isnan(logit).any():
                raise ValueError("the perceptron takes no missing features: impute them")
            return pd.Series(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

        p = positive(vector_to_array(F.col(self.features)))
        return df.withColumn("__p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).drop("__p")

    def save(self, spark: SparkSession, path: str) -> None:
        facts = json.dumps({"layers": self.layers, "features": self.features, "history": self.history})
        spark.createDataFrame([(facts, self.flat.tolist())], "facts string, flat array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PerceptronModel:
        row = spark.read.parquet(path).first()
        return cls(flat=np.array(row["flat"]), **json.loads(row["facts"]))
