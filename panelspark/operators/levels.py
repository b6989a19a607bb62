"""Logistic regression on one-hot columns of any number of levels, with its coefficients in tables.

Rows are summed once into cells, one for each combination of levels.  An iteration takes the columns in
turn: given all other coefficients, those of a column's levels don't touch each other, so that each takes
a Newton step of its own from sums over its cells; then the intercept does.  The driver holds the
intercept and a handful of sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ranking import discard, stored
from panelspark.operators.models import decided

#: Up to so many coefficients of a column are broadcast.
MOST_BROADCAST = 100_000


def _chance(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def _loss(margin: Column) -> Column:
    """log(1 + exp(margin)), without an overflow."""
    return F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))


def _step(slope: Column, bend: Column) -> Column:
    """A Newton step shortened to its logarithm: for a logistic loss of 0/1 features it never goes uphill."""
    return F.when(bend > 0, -F.signum(slope) * F.log1p(F.abs(slope) / bend)).otherwise(F.lit(0.0))


@dataclass
class LevelRegression:
    """A model of 0/1 ``label``s on ``columns`` of level numbers; a null has no feature.

    It minimises what ``pyspark.ml``'s regression does: the mean log loss and ``regParam`` / 2 times
    the squares of coefficients of features scaled to deviation 1.  A level of all rows gets 0, as there.
    ``params`` are ``maxIter``, ``regParam`` and ``tol``, the relative fall of that sum at which it stops.
    """

    label: str
    columns: list[str]
    weight: str | None = None
    params: dict = field(default_factory=dict)
    threshold: float = 0.5
    intercept: float = 0.0
    history: list[float] = field(default_factory=list)
    sizes: dict[str, int] = field(default_factory=dict)
    coefficients: dict[str, DataFrame] = field(default_factory=dict)  # (level, value) by column

    def fit(self, df: DataFrame) -> LevelRegression:
        params = {"maxIter": 100, "regParam": 0.01, "tol": 1e-6} | self.params
        weight, y = F.col(self.weight).cast("double") if self.weight else F.lit(1.0), F.col(self.label).cast("double")
        sums = {"__n": F.sum(weight), "__pos": F.sum(weight * y), "__squares": F.sum(weight * weight), "__bad": F.count_if(y.isNull() | ~y.isin(0.0, 1.0))}
        cells = stored(df.groupBy(*self.columns).agg(*[v.alias(k) for k, v in sums.items()]).withColumn("__margin", F.lit(0.0)), "cells")
        facts = cells.agg(*[F.sum(k).alias(k) for k in sums]).first()
        total, positive = facts["__n"], facts["__pos"]
        if not total or facts["__bad"]:
            raise ValueError(f"labels of {self.label} must be 0 or 1, of one row at least; {facts['__bad'] or 0} are not")
        self.sizes, self.history, self.coefficients = {}, [], {}
        free = total - facts["__squares"] / total
        # The penalty's second derivative, in units of a row: variance of the level's 0/1 feature times rows.
        ridge = lambda n: params["regParam"] * total * (n - n * n / total) / (free or 1.0)
        if 0 < positive < total:
            self.intercept = math.log(positive / (total - positive))
            for _ in range(params["maxIter"]):
                penalty = 0.0
                if len(self.columns) == 1:
                    cells = self._in_place(cells, ridge, total)
                else:
                    for c in self.columns:
                        cells, more = self._by_level(cells, c, ridge, total)
                        penalty += more
                self._intercept_step(cells, ridge, penalty, total)
                if len(self.history) > 1 and self.history[-2] - self.history[-1] <= params["tol"] * abs(self.history[-2]):
                    break
        else:
            self.intercept = math.inf if positive else -math.inf
        if len(self.columns) == 1:
            c = self.columns[0]
            self.coefficients[c], self.sizes[c] = cells.where(F.col(c).isNotNull()).select(F.col(c).alias("level"), F.col("__margin").alias("value")), cells.count()
        else:
            discard(cells)
        return self

    def _slope(self) -> tuple[Column, Column]:
        """First and second derivative of a cell's loss by its margin."""
        p = _chance(F.col("__margin") + self.intercept)
        return F.col("__n") * p - F.col("__pos"), F.col("__n") * p * (1 - p)

    def _in_place(self, cells: DataFrame, ridge, total: float) -> DataFrame:
        """The only column's step: a cell is a level, and its margin the level's coefficient."""
        (slope, bend), pull = self._slope(), ridge(F.col("__n"))
        learned = F.col(self.columns[0]).isNotNull() & (F.col("__n") < total)
        step = F.when(learned, _step(slope + pull * F.col("__margin"), bend + pull)).otherwise(F.lit(0.0))
        moved = stored(cells.withColumn("__margin", F.col("__margin") + step), "cells")
        discard(cells)
        return moved

    def _by_level(self, cells: DataFrame, c: str, ridge, total: float) -> tuple[DataFrame, float]:
        """One column's step, and the penalty of its new coefficients."""
        slope, bend = self._slope()
        sums = cells.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("level")).agg(F.sum("__n").alias("n"), F.sum(slope).alias("slope"), F.sum(bend).alias("bend"))
        old = self.coefficients.get(c)
        known = sums.withColumn("old", F.lit(0.0)) if old is None else sums.join(old.select("level", F.col("value").alias("old")), "level")
        pull = ridge(F.col("n"))
        step = F.when(F.col("n") < total, _step(F.col("slope") + pull * F.col("old"), F.col("bend") + pull)).otherwise(F.lit(0.0))
        table = stored(known.select("level", "n", step.alias("step"), (F.col("old") + step).alias("value")), "coefficients")
        self.sizes[c] = self.sizes[c] if c in self.sizes else table.count()
        moved = self._joined(cells, table, c, "step")
        moved = stored(moved.withColumn("__margin", F.col("__margin") + F.col("__found")).drop("__found"), "cells")
        discard(cells, *([] if old is None else [old]))
        self.coefficients[c] = table
        return moved, table.agg(F.sum(pull * F.col("value") * F.col("value")) / 2).first()[0] or 0.0

    def _intercept_step(self, cells: DataFrame, ridge, penalty: float, total: float) -> None:
        """The mean loss of the coefficients as they are, and then the intercept's step."""
        slope, bend = self._slope()
        margin = F.col("__margin") + self.intercept
        own = ridge(F.col("__n")) * F.col("__margin") * F.col("__margin") / 2 if len(self.columns) == 1 else F.lit(0.0)
        loss = F.col("__n") * _loss(margin) - F.col("__pos") * margin + own
        row = cells.agg(F.sum(slope).alias("slope"), F.sum(bend).alias("bend"), F.sum(loss).alias("loss")).first()
        self.history.append((row["loss"] + penalty) / total)
        if row["bend"] > 0:
            self.intercept -= math.copysign(math.log1p(abs(row["slope"]) / row["bend"]), row["slope"])

    def _joined(self, df: DataFrame, table: DataFrame, c: str, value: str) -> DataFrame:
        """``df`` with the table's value at the column's level as ``__found``, 0 without one."""
        right = table.select(F.col("level").alias("__level"), F.col(value).alias("__value"))
        right = F.broadcast(right) if self.sizes[c] <= MOST_BROADCAST else right
        return df.join(right, F.col(c) == F.col("__level"), "left").withColumn("__found", F.coalesce("__value", F.lit(0.0))).drop("__level", "__value")

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p1`` and ``predicted``; levels that weren't learned add nothing."""
        out = df.withColumn("__sum", F.lit(self.intercept))
        for c in self.coefficients:
            out = self._joined(out, self.coefficients[c], c, "value").withColumn("__sum", F.col("__sum") + F.col("__found")).drop("__found")
        return out.withColumn("p1", _chance(F.col("__sum"))).drop("__sum").withColumn("predicted", decided(F.col("p1"), self.threshold))
