"""Imputation, encoding, scaling and assembly with statistics learned on the training frame.

A fit computes only the statistics that its plan asks for, and writes its tables of levels and target
means, so that a fitted state never changes.  Sums take one aggregation for all numeric columns;
exact quantiles come from narrowing brackets, modes and level numbers from counts of distinct values,
so that no task holds or sorts a whole column.  A transform is expressions and lookups of known size: it starts
no job, and also works on a stream.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.expressions import MISSING, level
from panelspark.functions.ranking import discard, global_rank, stored
from panelspark.functions.selection import numbers, quantiles

#: Up to so many rows a lookup table is broadcast; they are counted first.
BROADCAST_LEVELS = 100_000
#: Up to so many levels are found by an expression, more by a lookup.
FEW_LEVELS = 64
#: Without ``max_one_hot``, names of up to so many levels of a column are on the driver.
MOST_NAMES = 200_000
# Names of the strategies.
IMPUTATIONS = ("mean", "median", "mode", "constant", "none")
SCALINGS = ("standard", "minmax", "robust", "none")
ENCODINGS = ("label", "ordinal", "one_hot", "target", "native", "none")
DTYPES = ("numeric", "categorical", "boolean")
SUMS = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}
NEEDS = {"mean": {"mean"}, "median": {"median"}, "mode": {"mode"}, "standard": {"mean", "sd"}, "minmax": {"min", "max"}, "robust": {"median", "q25", "q75"}}


def numeric_stats(df: DataFrame, wanted: dict[str, set[str]], approximate: bool = False) -> dict[str, dict[str, float | None]]:
    """For each column those asked for of mean, sd, min, max, median, q25, q75 and mode, and ``missing``.

    NaN counts as null.  A column without values has None.  Ties of the mode go to the smallest value.
    Quantiles are exact, or sketches if ``approximate``.
    """
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in wanted}
    sums = {(c, s): SUMS[s](clean[c]) for c in wanted for s in sorted(wanted[c] & set(SUMS))}
    if approximate:
        sums |= {(c, s): F.percentile_approx(clean[c], q, 10_000) for c in wanted for s, q in QUANTILES.items() if s in wanted[c]}
    sums |= {(c, "missing"): F.count("*") - F.count(clean[c]) for c in wanted}
    out: dict[str, dict[str, float | None]] = {c: dict.fromkeys(wanted[c]) for c in wanted}
    if wanted:
        row = df.agg(*[v.alias(f"s{k}") for k, v in enumerate(sums.values())], F.count("*").alias("rows")).first()
        for k, (c, s) in enumerate(sums):
            out[c][s] = row[k]
    exact = {} if approximate else {c: {s: QUANTILES[s] for s in wanted[c] & set(QUANTILES)} for c in wanted if wanted[c] & set(QUANTILES)}
    modes = [c for c in wanted if "mode" in wanted[c]]
    if modes:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), clean[c].alias("value")) for c in modes])
        counts = df.select(F.inline(cells)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
        for r in counts.groupBy("column").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("mode")).collect():
            out[r["column"]]["mode"] = r["mode"]
    if exact:
        table = numbers(df, {c: clean[c] for c in exact})
        for c, found in quantiles(table, exact, {c: row[len(sums)] - out[c]["missing"] for c in exact}).items():
            out[c] |= found
        discard(table)
    return out


def level_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(column, value, n)``: the levels of all columns in one aggregation.  A null is no level."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), v.cast("string").alias("value")) for c, v in columns.items()])
    return df.select(F.inline(pairs)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def category_levels(df: DataFrame, columns: list[str], order: str = "by_frequency") -> DataFrame:
    """``(column, value, n, <order>)``: levels with indices from 0, the most frequent first and ties by
    name (``by_frequency``), or by name (``by_name``)."""
    return numbered_levels(level_counts(df, {c: F.col(c) for c in columns}), order)


def numbered_levels(counts: DataFrame, order: str) -> DataFrame:
    by = {"by_frequency": [F.desc("n"), F.col("value")], "by_name": [F.col("value")]}[order]
    return global_rank(counts, by, order, ["column"]).withColumn(order, (F.col(order) - 1).cast("int"))


def target_means(df: DataFrame, column: str, label: str, smoothing: float = 10.0) -> DataFrame:
    """``(value, target_mean)``: the label's mean at each level, drawn to the overall mean."""
    overall = df.agg(F.avg(F.col(label).cast("double")).alias("__prior"))
    sums = df.groupBy(level(F.col(column)).alias("value")).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count(label).alias("n"))
    return sums.join(F.broadcast(overall)).select("value", ((F.col("s") + smoothing * F.col("__prior")) / (F.col("n") + smoothing)).alias("target_mean"))


def lookup(df: DataFrame, column: Column, table: DataFrame, value: str, name: str, default: Column, rows: int | None = None) -> DataFrame:
    """``df`` with ``name``: the table's ``value`` at the column's text, else ``default``.

    ``rows`` is the table's known size; it is counted if it isn't given.
    """
    right = table.select(F.col("value").alias("__value"), F.col(value).alias("__found"))
    if (right.count() if rows is None else rows) <= BROADCAST_LEVELS:
        right = F.broadcast(right)
    return df.join(right, column.cast("string") == F.col("__value"), "left").withColumn(name, F.coalesce("__found", default)).drop("__value", "__found")


def encode_index(df: DataFrame, column: str, levels: DataFrame, order: str = "by_frequency", unknown: str = "keep", name: str | None = None, rows: int | None = None) -> DataFrame:
    """Index of the column's level.

    Levels that were not learned, and nulls, get an extra index (``keep``), -1 (``minus``), make
    their rows go (``skip``) or make the query fail when it runs (``error``).  ``rows`` is the number
    of the column's levels; it is counted if it isn't given.
    """
    own = levels.where(F.col("column") == column)
    rows = own.count() if rows is None else rows
    name = name or f"{column}_index"
    out = lookup(df, F.col(column), own, order, name, unknown_value(column, unknown, F.lit(rows)).cast("int"), rows)
    return out.where(F.col(name).isNotNull()) if unknown == "skip" else out


def unknown_value(column: str, policy: str, kept: Column) -> Column:
    """What a level that wasn't learned becomes: ``kept``, -1, null (for rows that go) or an error."""
    values = {"keep": kept, "minus": F.lit(-1), "skip": F.lit(None), "error": F.raise_error(F.concat(F.lit(f"unknown level of {column}: "), level(F.col(column))))}
    if policy not in values:
        raise ValueError(f"unknown policy {policy!r}; one of {', '.join(values)}")
    return values[policy]


def one_hot(df: DataFrame, column: str, values: list[str], drop_last: bool = False) -> DataFrame:
    """A 0/1 column for each listed level; other levels and nulls are 0 in all."""
    used = values[:-1] if drop_last else values
    return df.select("*", *[F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0)).alias(f"{column}={v}") for v in used])


def imputed(column: Column, strategy: str, stats: dict[str, float], value: float | None = None) -> Column:
    if strategy not in IMPUTATIONS:
        raise ValueError(f"unknown imputation {strategy!r}; one of {', '.join(IMPUTATIONS)}")
    clean = F.nanvl(column.cast("double"), F.lit(None))
    if strategy == "none":
        return column.cast("double")
    fill = (0.0 if value is None else float(value)) if strategy == "constant" else stats[strategy]
    return F.coalesce(clean, F.lit(fill).cast("double"))


def scaled(column: Column, strategy: str, stats: dict[str, float], with_mean: bool = True) -> Column:
    """Sample-sd, range or quartile scaling; without spread 0, in range scaling 0.5."""
    if strategy not in SCALINGS:
        raise ValueError(f"unknown scaling {strategy!r}; one of {', '.join(SCALINGS)}")
    if strategy == "none":
        return column
    if strategy == "minmax":
        spread = (stats["max"] or 0.0) - (stats["min"] or 0.0)
        return (column - stats["min"]) / spread if spread else F.when(column.isNotNull(), F.lit(0.5))
    centre, spread = (stats["mean"] if with_mean else 0.0, stats["sd"] or 0.0) if strategy == "standard" else (stats["median"], (stats["q75"] or 0.0) - (stats["q25"] or 0.0))
    return (column - centre) / spread if spread else F.when(column.isNotNull(), F.lit(0.0))


@dataclass
class ColumnPlan:
    """Treatment of one column; unset fields take the preprocessor's defaults.

    ``dtype`` (numeric, categorical or boolean) moves the column to that list, whichever it came in.
    """

    imputation: str | None = None
    value: float | str | None = None
    encoding: str | None = None
    scaling: str | None = None
    dtype: str | None = None


@dataclass
class Preprocessor:
    """Numeric block first, then the categorical block; every column by its own plan.

    A numeric column that isn't imputed and had missing values in the fit also gets a 0/1 column
    ``<column>_missing``, as a tree's bins can be too coarse to part a few missing values from the rest.
    One-hot encoding has a feature for every learned level.  ``assemble`` makes sparse vectors of them
    from the levels' numbers; ``transform``, which makes a column of each, raises an error beyond
    ``max_columns`` levels of a column, and ``fit`` beyond ``max_one_hot``, as names and coefficients
    are on the driver.  With ``max_one_hot=None`` there may be any number: beyond ``MOST_NAMES`` the names
    stay in the table of levels, and ``places`` takes the place of ``assemble``.

    ``unknown`` says what becomes of levels that the fit didn't see, null included: ``keep`` (an own
    index of label and native encoding, -1 of ordinal encoding, no feature of one-hot encoding, the
    label's overall mean of target encoding), ``minus`` (-1; one-hot and target as with keep), ``skip``
    (the row goes) or ``error``.
    """

    numeric: list[str]
    categorical: list[str]
    label: str | None = None
    boolean: list[str] = field(default_factory=list)
    imputation: str = "median"
    scaling: str = "standard"
    encoding: str = "one_hot"
    categorical_imputation: str = "level"
    unknown: str = "keep"
    smoothing: float = 10.0
    max_one_hot: int | None = 200_000
    max_columns: int = 1000
    approximate: bool = False
    plans: dict[str, ColumnPlan] = field(default_factory=dict)
    stats: dict[str, dict[str, float]] = field(default_factory=dict)
    fills: dict[str, str] = field(default_factory=dict)
    hot: dict[str, list[str]] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    priors: dict[str, float] = field(default_factory=dict)
    levels: dict[str, DataFrame] = field(default_factory=dict)
    targets: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        lists = {"numeric": self.numeric, "categorical": self.categorical, "boolean": self.boolean}
        for c, plan in self.plans.items():
            if plan.dtype and plan.dtype not in lists:
                raise ValueError(f"unknown dtype {plan.dtype!r}; one of {', '.join(DTYPES)}")
            if plan.dtype and c not in lists[plan.dtype] and any(c in x for x in lists.values()):
                lists = {kind: [x for x in own if x != c] + [c] * (kind == plan.dtype) for kind, own in lists.items()}
        self.numeric, self.categorical, self.boolean = lists["numeric"], lists["categorical"], lists["boolean"]

    def _plan(self, column: str) -> ColumnPlan:
        own = self.plans.get(column, ColumnPlan())
        return ColumnPlan(own.imputation or (self.imputation if column in self.numeric else self.categorical_imputation), own.value, own.encoding or self.encoding, own.scaling or self.scaling, own.dtype)

    def _filled(self, column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(self.fills[column]))

    def _order(self, column: str) -> str | None:
        """How the levels of a column are numbered, if they are."""
        return {"label": "by_frequency", "native": "by_frequency", "ordinal": "by_name", "one_hot": "by_name"}.get(self._plan(column).encoding)

    def fit(self, df: DataFrame) -> Preprocessor:
        """Learn and write everything a transform needs.

        Scaling statistics are those of the imputed column: a second pass computes them for columns
        that are imputed, scaled and have missing values.
        """
        self._fit_numeric(df)
        if self.categorical:
            self._fit_categorical(df)
        return self

    def _fit_numeric(self, df: DataFrame) -> None:
        plans = {c: self._plan(c) for c in self.numeric}
        raw = numeric_stats(df, {c: NEEDS.get(p.imputation, set()) | NEEDS.get(p.scaling, set()) for c, p in plans.items()}, self.approximate)
        again = {c: NEEDS[p.scaling] for c, p in plans.items() if p.scaling != "none" and p.imputation != "none" and raw[c]["missing"]}
        ready = df.select(*[imputed(F.col(c), plans[c].imputation, raw[c], plans[c].value).alias(c) for c in again])
        full = numeric_stats(ready, again, self.approximate) if again else {}
        self.stats = {c: full.get(c, raw[c]) | {f"raw_{s}": v for s, v in raw[c].items()} for c in self.numeric}

    def _fit_categorical(self, df: DataFrame) -> None:
        plans = {c: self._plan(c) for c in self.categorical}
        if self.unknown == "minus" and (native := [c for c in plans if plans[c].encoding == "native"]):
            raise ValueError(f"native categories have no number below 0, as the policy 'minus' needs: {native}")
        most: dict[str, str] = {}
        if wanting := [c for c, p in plans.items() if p.imputation == "most_frequent"]:
            counts = level_counts(df, {c: F.col(c) for c in wanting})
            tops = counts.groupBy("column").agg(F.max("n").alias("top")).withColumnRenamed("column", "c")
            best = counts.join(F.broadcast(tops), (F.col("column") == F.col("c")) & (F.col("n") == F.col("top"))).groupBy("column").agg(F.min("value").alias("value"))
            most = {r["column"]: r["value"] for r in best.collect()}
        for c, plan in plans.items():
            self.fills[c] = {"level": MISSING, "most_frequent": most.get(c, MISSING), "constant": str(plan.value or "missing")}[plan.imputation]
        orders = {c: self._order(c) for c in self.categorical if self._order(c)}
        if orders:
            counts = stored(level_counts(df, {c: self._filled(c) for c in orders}), "levels")
            self.sizes = dict.fromkeys(orders, 0) | {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}
            if self.max_one_hot is not None and (beyond := {c: self.sizes[c] for c in self._hot_columns() if self.sizes[c] > self.max_one_hot}):
                raise ValueError(f"more than max_one_hot = {self.max_one_hot} levels: {beyond}; raise it or choose another encoding")
            for order in sorted(set(orders.values())):
                own = [c for c in orders if orders[c] == order]
                table = stored(numbered_levels(counts.where(F.col("column").isin(own)), order), "numbered-levels")
                self.levels |= dict.fromkeys(own, table)
            self._name_levels()
        wanted = [c for c in self.categorical if plans[c].encoding == "target"]
        overall = df.agg(F.avg(F.col(self.label).cast("double"))).first()[0] if wanted else None
        for c in wanted:
            self.targets[c] = stored(target_means(df.withColumn(c, self._filled(c)), c, self.label, self.smoothing), "target-means")
            self.priors[c], self.sizes[c] = overall, self.targets[c].count()

    def _name_levels(self) -> None:
        """Names of the features of one-hot columns, which their levels' tables have; not those of too many."""
        most = MOST_NAMES if self.max_one_hot is None else self.max_one_hot
        hot = [c for c in self._hot_columns() if self.sizes[c] <= most]
        self.hot = {c: [] for c in hot}
        for table in {id(self.levels[c]): self.levels[c] for c in hot}.values():
            for r in table.where(F.col("column").isin(hot)).select("column", "value").orderBy("column", "by_name").collect():
                self.hot[r["column"]].append(r["value"])

    def _hot_columns(self) -> list[str]:
        return [c for c in self.categorical if self._plan(c).encoding == "one_hot"]

    def _all_named(self) -> None:
        if wide := {c: self.sizes[c] for c in self._hot_columns() if c not in self.hot}:
            raise ValueError(f"too many levels for names on the driver: {wide}; n_features counts them and places numbers them")

    def _gapped(self) -> list[str]:
        return [c for c in self.numeric if self._plan(c).imputation == "none" and self.stats[c]["raw_missing"]]

    def names(self) -> list[str]:
        """Output columns in the order of the vector."""
        self._all_named()
        out = [*self.numeric, *[f"{c}_missing" for c in self._gapped()], *self.boolean]
        for c in self.categorical:
            encoding = self._plan(c).encoding
            if encoding == "one_hot":
                out += [f"{c}={v}" for v in self.hot.get(c, [])]
            elif encoding != "none":
                out.append(f"{c}_{'mean' if encoding == 'target' else 'index'}")
        return out

    def n_features(self) -> int:
        """The number of output columns, named or not."""
        sizes = [self.sizes[c] if self._plan(c).encoding == "one_hot" else 1 for c in self.categorical if self._plan(c).encoding != "none"]
        return self._width() + sum(sizes)

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """``keep`` and the output columns."""
        self._all_named()
        if wide := {c: len(v) for c, v in self.hot.items() if len(v) > self.max_columns}:
            raise ValueError(f"more than max_columns = {self.max_columns} levels: {wide}; assemble makes vectors of them")
        out = self._encoded(df, keep)
        for c, values in self.hot.items():
            at = F.col(f"{c}_index")
            out = out.select("*", *[(at == k).cast("int").alias(f"{c}={v}") for k, v in enumerate(values)])
        return out.select(*keep, *self._numbers(), *[F.col(f"`{c}`") for c in self.names()[self._width() :]])

    def _width(self) -> int:
        return len(self.numeric) + len(self._gapped()) + len(self.boolean)

    def _encoded(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``df`` with an index or mean of every categorical column; unknown levels by the policy."""
        out = df.select(*keep, *[c for c in [*self.numeric, *self.boolean, *self.categorical] if c not in keep])
        for c in self.categorical:
            out = out.withColumn(c, self._filled(c))
        for c in self.categorical:
            encoding, name = self._plan(c).encoding, f"{c}_index"
            if encoding == "target":
                prior = F.lit(self.priors[c]).cast("double")
                default = prior if self.unknown == "minus" else unknown_value(c, self.unknown, prior).cast("double")
                out, name = lookup(out, F.col(c), self.targets[c], "target_mean", f"{c}_mean", default, self.sizes[c]), f"{c}_mean"
            elif encoding != "none":
                policy = "minus" if encoding == "ordinal" and self.unknown == "keep" else "keep" if encoding == "one_hot" and self.unknown == "minus" else self.unknown
                values = self.hot.get(c, [])
                if c in self.hot and len(values) <= FEW_LEVELS:
                    at = F.array_position(F.array(*map(F.lit, values)), F.col(c)) if values else F.lit(0)
                    out = out.withColumn(name, F.when(at > 0, at - 1).otherwise(unknown_value(c, policy, F.lit(len(values)))).cast("int"))
                else:
                    out = encode_index(out, c, self.levels[c], self._order(c), policy, rows=self.sizes[c])
            if encoding != "none" and self.unknown == "skip":
                out = out.where(F.col(name).isNotNull())
        return out

    def _numbers(self) -> list[Column]:
        numbers = []
        for c in self.numeric:
            plan, stats = self._plan(c), self.stats[c]
            raw = {s[4:]: v for s, v in stats.items() if s.startswith("raw_")}
            numbers.append(scaled(imputed(F.col(c), plan.imputation, raw, plan.value), plan.scaling, stats).alias(c))
        numbers += [(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double").alias(f"{c}_missing") for c in self._gapped()]
        return numbers + [F.col(c).cast("double").alias(c) for c in self.boolean]

    def assemble(self, df: DataFrame, keep: list[str] = (), output: str = "features", missing: float = math.nan) -> DataFrame:
        """``keep`` and a vector of the output columns, sparse where that is shorter.

        A missing value is NaN in it, or the number ``missing``.  The vector's attributes tell a tree
        which features are native categories and how many each has, the one for unknown levels
        included; the metadata says ``filled`` if no feature can be NaN.
        """
        self._all_named()
        out = self._encoded(df, keep)
        number = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(None)), F.lit(missing))
        columns, parts, width, nominal = [], [], self._width(), []
        for k, c in enumerate(self._numbers()):
            columns.append(number(c).alias(f"__f{k}"))
            parts.append(f"__f{k}")
        for k, c in enumerate(x for x in self.categorical if self._plan(x).encoding != "none"):
            encoding = self._plan(c).encoding
            if encoding == "one_hot":
                if not self.hot[c]:
                    continue
                columns.append(F.col(f"{c}_index").cast("double").alias(f"__i{k}", metadata={"ml_attr": {"type": "nominal", "num_vals": len(self.hot[c])}}))
                parts.append(f"__v{k}")
            else:
                if encoding == "native":
                    nominal.append({"idx": width, "name": c, "num_vals": self.sizes[c] + 1})
                columns.append(number(F.col(f"{c}_mean" if encoding == "target" else f"{c}_index")).alias(f"__f_{k}"))
                parts.append(f"__f_{k}")
            width += len(self.hot[c]) if encoding == "one_hot" else 1
        ready = out.select(*keep, *columns)
        if hot := [p for p in parts if p.startswith("__v")]:
            # The index behind the last level is that of unknown ones: dropped, it leaves all zero.
            encoder = OneHotEncoder(inputCols=[p.replace("__v", "__i") for p in hot], outputCols=hot, handleInvalid="keep", dropLast=True)
            ready = encoder.fit(ready).transform(ready)
        vectors = VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="keep").transform(ready)
        attributes = {"ml_attr": {"num_attrs": width} | ({"attrs": {"nominal": nominal}} if nominal else {}), "filled": not math.isnan(missing)}
        return vectors.select(*keep, F.col(output).alias(output, metadata=attributes))

    def places(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """``keep`` and ``<column>_place`` for each one-hot column: where its part of the vector has the 1,
        null if nowhere.  This is that part's sparse vector without a width or names, for any number of levels."""
        out = self._encoded(df, keep)
        at = {c: F.col(f"{c}_index") for c in self._hot_columns()}
        return out.select(*keep, *[F.when(i < self.sizes[c], i).alias(f"{c}_place") for c, i in at.items()])

    def save(self, spark: SparkSession, path: str) -> None:
        """Parquet tables: settings, levels and target means."""
        settings = {k: v for k, v in self.__dict__.items() if k not in ("levels", "targets", "plans", "hot")} | {"plans": {c: p.__dict__ for c, p in self.plans.items()}}
        spark.createDataFrame([(json.dumps(settings),)], "settings string").write.mode("overwrite").parquet(f"{path}/settings")
        for c, table in self.levels.items():
            table.where(F.col("column") == c).write.mode("overwrite").parquet(f"{path}/levels-{self.categorical.index(c)}")
        if self.targets:
            tables = [t.select(F.lit(c).alias("column"), "value", "target_mean") for c, t in self.targets.items()]
            reduce(DataFrame.unionByName, tables).write.mode("overwrite").parquet(f"{path}/targets")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessor:
        settings = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
        out = cls(**settings | {"plans": {c: ColumnPlan(**p) for c, p in settings["plans"].items()}})
        for k, c in enumerate(out.categorical):
            encoding = out._plan(c).encoding
            if encoding in ("label", "native", "ordinal", "one_hot"):
                out.levels[c] = spark.read.parquet(f"{path}/levels-{k}")
            elif encoding == "target":
                out.targets[c] = spark.read.parquet(f"{path}/targets").where(F.col("column") == c).drop("column")
        out._name_levels()
        return out


def pca(df: DataFrame, k: int, features: str = "features", output: str = "components", keep: list[str] = ()) -> DataFrame:
    """The first components of centred vectors; ``k`` is at most their width.

    Each component's sign makes its largest loading positive.
    """
    import numpy as np
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = len(df.select(vector_to_array(F.col(features)).alias("v")).first()["v"])
    centred = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="__centred").fit(df).transform(df)
    model = PCA(k=min(k, width), inputCol="__centred", outputCol="__raw").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    raw = vector_to_array(F.col("__raw"))
    turned = F.array(*[raw[j] * float(s or 1.0) for j, s in enumerate(signs)])
    return model.transform(centred).select(*keep, array_to_vector(turned).alias(output))
