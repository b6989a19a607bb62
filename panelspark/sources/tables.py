"""Scans of tables and files, a registry of named sources, and hand-offs to modelling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.hashing import unit_hash

FORMATS = ("table", "parquet", "delta", "csv", "frame")


@dataclass
class Source:
    """A named input.

    ``kind`` is one of ``FORMATS``; ``paths`` holds file paths, or the one- to three-part name of a
    table; ``where`` is SQL text that filters at load; ``fraction`` keeps a sample of what passes:
    by a hash of ``keys`` if they are given, else by Spark's own sampler.  Null, 0 and fractions of
    1 or more keep all rows.  An existing frame is passed through as it is.
    """

    name: str
    kind: str
    paths: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    schema: T.StructType | str | None = None
    where: str | None = None
    fraction: float | None = None
    keys: list[str] = field(default_factory=list)
    seed: int = 42
    frame: DataFrame | None = None
    _loaded: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.kind not in FORMATS:
            raise ValueError(f"unknown kind {self.kind!r}; one of {', '.join(FORMATS)}")
        if self.kind == "frame" and self.frame is None:
            raise ValueError("a source of kind 'frame' needs a frame")
        if self.kind != "frame" and not self.paths:
            raise ValueError(f"source {self.name!r} has no path")

    def _scan(self, spark: SparkSession) -> DataFrame:
        if self.kind == "table":
            return spark.table(self.paths[0])
        reader = spark.read.schema(self.schema) if self.schema is not None else spark.read
        if self.kind == "csv":
            defaults = {"header": "true", "inferSchema": str(self.schema is None).lower()}
            return reader.options(**defaults | self.options).csv(self.paths)
        if self.kind == "delta":
            return reader.format("delta").options(**self.options).load(self.paths[0])
        return reader.options(**self.options).parquet(*self.paths)

    def load(self, spark: SparkSession) -> DataFrame:
        if self.kind == "frame":
            return self.frame
        if self._loaded is None:
            out = self._scan(spark)
            if self.where:
                out = out.where(F.expr(self.where))
            if self.fraction and 0 < self.fraction < 1:
                out = out.where(unit_hash(self.keys, self.seed) < self.fraction) if self.keys else out.sample(fraction=self.fraction, seed=self.seed)
            self._loaded = out
        return self._loaded

    def cache(self, spark: SparkSession) -> DataFrame:
        return self.load(spark).persist(StorageLevel.MEMORY_AND_DISK)

    def unpersist(self) -> None:
        if self._loaded is not None:
            self._loaded.unpersist()

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row: name, kind, path, columns, cached, n_rows."""
        df = self.load(spark)
        return df.agg(F.count("*").alias("n_rows")).select(
            F.lit(self.name).alias("name"),
            F.lit(self.kind).alias("kind"),
            F.lit(",".join(self.paths)).alias("path"),
            F.lit(",".join(df.columns)).alias("columns"),
            F.lit(df.is_cached).alias("cached"),
            "n_rows",
        )


class Registry:
    """Sources by name; loading one also makes it a temporary view for SQL."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    @classmethod
    def from_dicts(cls, configs: dict[str, dict]) -> Registry:
        out = cls()
        for name, config in configs.items():
            out.register(Source(name=name, **config))
        return out

    def register(self, source: Source) -> None:
        self._sources[source.name] = source

    def get(self, name: str) -> Source:
        if name not in self._sources:
            raise KeyError(f"no source {name!r}; there are {', '.join(self.names()) or 'none'}")
        return self._sources[name]

    def names(self) -> list[str]:
        return sorted(self._sources)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        df = self.get(name).load(spark)
        df.createOrReplaceTempView(name)
        return df


def numeric_handoff(df: DataFrame, features: list[str], label: str, weight: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Keys as they are, then features, label and weight as doubles; stays a DataFrame."""
    columns = [*features, label, *([weight] if weight else [])]
    return df.select(*(keys or []), *[F.col(c).cast("double").alias(c) for c in columns])


def limited_handoff(df: DataFrame, order_by: list[str], limit_rows: int = 10_000, fraction: float | None = None, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """A sample by key hash if ``fraction`` is given, else the first ``limit_rows`` in order."""
    if fraction is not None:
        return df.where(unit_hash(keys or order_by, seed) < fraction)
    return df.orderBy(*order_by).limit(limit_rows)


def capped_sample(df: DataFrame, max_rows: int, keys: list[str], seed: int = 42) -> DataFrame:
    """About ``max_rows`` rows by key hash; all of a smaller frame."""
    n = df.count()
    return df if n <= max_rows else df.where(unit_hash(keys, seed) < max_rows / n)
