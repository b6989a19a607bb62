"""Exact order statistics without sorting a column.

A bracket is a range of values that holds a wanted place.  In each round a sketch of the values
inside the bracket names a narrower one, and exact counts say how many values lie below and inside
it: the sketch only guides, so that its errors cost a round and never change a result.  When few
distinct values are left, they are counted and read.  Each round divides the rows inside by some
thousand: two for a million rows, four for a trillion.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ranking import stored

#: Values inside a bracket that are counted one by one, and the accuracy of the sketches that guide.
FEW, ACCURACY = 2_000, 5_000


@dataclass
class _Bracket:
    column: str
    place: int
    low: float | None = None
    high: float | None = None
    open_low: bool = False
    open_high: bool = False
    below: int = 0
    inside: int = 0
    slack: float = 2 / ACCURACY

    def holds(self, x: Column) -> Column:
        out = x.isNotNull()
        if self.low is not None:
            out &= x > self.low if self.open_low else x >= self.low
        if self.high is not None:
            out &= x < self.high if self.open_high else x <= self.high
        return out


def numbers(df: DataFrame, columns: dict[str, Column], name: str = "numbers") -> DataFrame:
    """The columns as doubles, NaN as null, in a narrow stored table: each round reads them once."""
    return stored(df.select(*[F.nanvl(c.cast("double"), F.lit(None)).alias(k) for k, c in columns.items()]), name)


def values_at(table: DataFrame, places: Iterable[tuple[str, int]], counts: dict[str, int]) -> dict[tuple[str, int], tuple[float, int]]:
    """For each column and place, from 0 in ascending order: the value there, and how many are below it.

    ``table`` holds doubles and nulls, ``counts`` the number of values of each column.
    """
    done: dict[tuple[str, int], tuple[float, int]] = {}
    open_ones = [_Bracket(c, k, inside=counts[c]) for c, k in dict.fromkeys(places)]
    while open_ones:
        small = [b for b in open_ones if b.inside <= FEW or (b.low is not None and b.low == b.high and not b.open_low)]
        if small:
            for b, rows in zip(small, _counted(table, small), strict=True):
                below = b.below
                for value, n in rows:
                    if b.place < below + n:
                        done[b.column, b.place] = (value, below)
                        break
                    below += n
            open_ones = [b for b in open_ones if (b.column, b.place) not in done]
        if open_ones:
            _narrow(table, open_ones)
    return done


def _counted(table: DataFrame, brackets: list[_Bracket]) -> list[list[tuple[float, int]]]:
    """Distinct values inside each bracket, ascending, with their numbers."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.when(b.holds(F.col(f"`{b.column}`")), F.col(f"`{b.column}`")).alias("v")) for k, b in enumerate(brackets)])
    out: list[list[tuple[float, int]]] = [[] for _ in brackets]
    for r in table.select(F.inline(cells)).where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n")).collect():
        out[r["k"]].append((r["v"], r["n"]))
    return [sorted(x) for x in out]


def _narrow(table: DataFrame, brackets: list[_Bracket]) -> None:
    """Tighten the brackets in two passes: two values inside from sketches, then the counts below and
    between them, which say in which of three parts the place is.  A part as large as the whole has the
    next round divide at one value, which always leaves less."""
    sketches = []
    for k, b in enumerate(brackets):
        x = F.col(f"`{b.column}`")
        at = (b.place - b.below + 0.5) / b.inside
        ends = [max(0.0, at - b.slack), min(1.0, at + b.slack)]
        sketches.append(F.percentile_approx(F.when(b.holds(x), x), ends, ACCURACY).alias(f"e{k}"))
    found = table.agg(*sketches).first()
    sums = []
    for k, b in enumerate(brackets):
        x, (low, high) = F.col(f"`{b.column}`"), found[k]
        sums += [F.count_if(x < low).alias(f"b{k}"), F.count_if(x.between(low, high)).alias(f"i{k}")]
    counted = table.agg(*sums).first()
    for k, b in enumerate(brackets):
        (low, high), below, inside = found[k], counted[2 * k], counted[2 * k + 1]
        if b.place < below:
            b.high, b.open_high, b.inside = low, True, below - b.below
        elif b.place >= below + inside:
            b.low, b.open_low, b.inside, b.below = high, True, b.below + b.inside - below - inside, below + inside
        else:
            if inside == b.inside:
                b.slack = 0.0
            b.low, b.high, b.open_low, b.open_high, b.below, b.inside = low, high, False, False, below, inside


def quantiles(table: DataFrame, wanted: dict[str, dict[str, float]], counts: dict[str, int]) -> dict[str, dict[str, float]]:
    """Quantiles by name of each column, interpolated between neighbours; columns without values have none."""
    places = {(c, s): q * (counts[c] - 1) for c, own in wanted.items() if counts[c] for s, q in own.items()}
    found = values_at(table, {(c, k) for (c, _), at in places.items() for k in (math.floor(at), math.ceil(at))}, counts)
    out: dict[str, dict[str, float]] = {}
    for (c, s), at in places.items():
        low, high = found[c, math.floor(at)][0], found[c, math.ceil(at)][0]
        out.setdefault(c, {})[s] = low + (high - low) * (at - math.floor(at)) if low != high else low
    return out


def smallest(table: DataFrame, order: list[str], ties: list[str], n: int) -> Column | None:
    """A condition on ``order`` and ``ties`` that just the ``n`` smallest rows of ``table`` meet.

    ``order`` are columns of doubles, compared one after the other; rows that agree in all of them,
    which should be few, go by ``ties``, which should name a row: rows that repeat the last one's are
    all in.  None if ``n`` is 0 or less.
    """
    if n <= 0:
        return None
    total = table.count()
    if n >= total:
        return F.lit(True)
    left, rows, condition, equal = n, table, F.lit(False), F.lit(True)
    for c in order:
        value, below = values_at(rows, [(c, left - 1)], {c: rows.count()})[c, left - 1]
        condition, equal = condition | (equal & (F.col(c) < value)), equal & (F.col(c) == value)
        rows, left = rows.where(F.col(c) == value), left - below
    tied = rows.groupBy(*ties).agg(F.count("*").alias("__n")).orderBy(*ties)
    last = None
    for r in tied.limit(left).collect():
        if left <= 0:
            break
        last, left = r, left - r["__n"]
    literal = F.struct(*[F.lit(last[c]).cast(table.schema[c].dataType).alias(c) for c in ties])
    return condition | (equal & (F.struct(*ties) <= literal))
