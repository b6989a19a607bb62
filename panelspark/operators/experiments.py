"""Pipelines of preprocessing, model and threshold; grids of runs and their table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from panelspark.functions.ranking import discard, stored
from panelspark.operators.metrics import metric_row
from panelspark.operators.models import BELOW, TREES, Classifier
from panelspark.operators.panel import time_split
from panelspark.operators.prep import Preprocessor
from panelspark.operators.sampling import add_weights, for_mode
from panelspark.operators.threshold import tune

#: Samplings that read the label, the keys and the columns that their settings name, and no others.
NARROW = {"none", "random", "stratified", "undersample", "oversample", "neg_frac"}
RUN_SCHEMA = "run_name string, kind string, key string, value string"


@dataclass
class Pipeline:
    prep: Preprocessor
    classifier: Classifier
    keys: list[str] = field(default_factory=list)

    def fit(self, train: DataFrame, valid: DataFrame | None = None, threshold: str | None = None, **options) -> Pipeline:
        """Fit on ``train``; boosting stops on ``valid``, and a threshold strategy is tuned on it.

        The used columns of ``train``, then its vectors, are kept for the passes of the fit; the perceptron
        keeps blocks of its own.
        """
        used = [c for c in dict.fromkeys([*self.keys, *self.prep.numeric, *self.prep.boolean, *self.prep.categorical, self.classifier.label, self.classifier.weight]) if c]
        train = train.select(*used).persist(StorageLevel.MEMORY_AND_DISK)
        self.prep.fit(train)
        self.classifier.names = self.prep.names()
        held = self._vectors(valid) if valid is not None else None
        vectors = self._vectors(train)
        if self.classifier.kind != "mlp":
            vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
        self.classifier.fit(vectors, held, self.keys or None)
        vectors.unpersist()
        train.unpersist()
        if threshold and valid is not None:
            self.tune_threshold(valid, threshold, **options)
        return self

    def _vectors(self, df: DataFrame) -> DataFrame:
        extra = [c for c in [*self.keys, self.classifier.label, self.classifier.weight] if c and c in df.columns]
        return self.prep.assemble(df, keep=extra, **({"missing": BELOW} if self.classifier.kind in TREES else {}))

    def predict(self, df: DataFrame) -> DataFrame:
        """Keys, label if there is one, p1 and predicted."""
        return self.classifier.predict(self._vectors(df)).drop(self.classifier.features)

    def tune_threshold(self, valid: DataFrame, strategy: str = "f1", **options) -> float:
        self.classifier.set_threshold(tune(self.predict(valid), self.classifier.label, "p1", strategy, **options))
        return self.classifier.threshold

    def save(self, spark: SparkSession, path: str) -> None:
        self.prep.save(spark, f"{path}/prep")
        self.classifier.save(spark, f"{path}/classifier")
        spark.createDataFrame([(self.keys,)], "keys array<string>").write.mode("overwrite").parquet(f"{path}/keys")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Pipeline:
        return cls(Preprocessor.load(spark, f"{path}/prep"), Classifier.load(spark, f"{path}/classifier"), list(spark.read.parquet(f"{path}/keys").first()["keys"]))


def quick_train(df: DataFrame, numeric: list[str], categorical: list[str], label: str, kind: str = "lr", keys: list[str] = (), **params) -> Pipeline:
    return Pipeline(Preprocessor(numeric, categorical, label), Classifier(kind, label, params=params), list(keys)).fit(df)


def prepare(df: DataFrame, label: str, keys: list[str], data: dict, sampling: dict[str, dict], mode: str, weight_cap: float | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Splits, the training one sampled for the mode and weighted if a cap is given."""
    train, valid, test = time_split(df, data["train"], data["test"], data.get("valid"), data.get("year", "year"))
    train = for_mode(train, label, keys, sampling, mode)
    return (add_weights(train, label, cap=weight_cap) if weight_cap else train), valid, test


def run_experiments(
    df: DataFrame,
    label: str,
    keys: list[str],
    runs: list[dict],
    overrides: list[dict] | None = None,
    mode: str = "tune",
    threshold: str = "f1",
    fit: bool = True,
    parallel: int = 3,
    log: str | None = None,
) -> DataFrame:
    """A long table ``(run_name, kind, key, value)`` of parameters and metrics of all runs.

    Only one-row metrics reach the driver.  A run is a dict: name, data (ranges of years), sampling (by mode), prep (lists and settings),
    model (kind and params) and weight_cap.  Each run is made with every set of ``overrides`` of the
    model's params, and named by both.  The preprocessing of a run is fitted once, and its vectors serve
    all overrides, of which ``parallel`` are fitted side by side, each in a scheduler pool of its own.
    With ``log``, a path, each one is logged when it is done, and those that are logged already aren't
    made again.  The columns that the runs read are written once for all of them, so that what makes
    ``df`` is not done again for each split of each run.  Without ``fit``, the prepared training frames are returned under one another.
    """
    spark, out, rows = df.sparkSession, None, []
    made = {r["run_name"] for r in read_runs(spark, log).select("run_name").distinct().collect()} if log and fit else set()
    wanted, kept = [], None
    for run in runs:
        if not fit:
            splits = prepare(df, label, keys, run["data"], run.get("sampling", {}), mode, run.get("weight_cap"))
            part = splits[0].withColumn("run_name", F.lit(run["name"]))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
            continue
        named = {run["name"] + "".join(f"|{k}={v}" for k, v in sorted(extra.items())): extra for extra in overrides or [{}]}
        wanted += list(named)
        if todo := {name: extra for name, extra in named.items() if name not in made}:
            kept = kept or stored(df.select(*_read(df, label, keys, runs, mode)), "experiment-rows")
            splits = prepare(kept, label, keys, run["data"], run.get("sampling", {}), mode, run.get("weight_cap"))
            rows += _run(spark, label, keys, run, splits, todo, mode, threshold, parallel, log)
    if kept:
        discard(kept)
    if not fit:
        return out
    return read_runs(spark, log).where(F.col("run_name").isin(wanted)) if log else spark.createDataFrame(rows, RUN_SCHEMA)


def _read(df: DataFrame, label: str, keys: list[str], runs: list[dict], mode: str) -> list[str]:
    """The columns of ``df`` that the runs read; all, if a sampling may read any."""
    named: set[str] = {label, *keys}

    def add(x: object) -> None:
        if isinstance(x, str):
            named.add(x)
        elif isinstance(x, dict):
            add([*x, *x.values()])
        elif isinstance(x, list | tuple | set):
            for y in x:
                add(y)

    for run in runs:
        sampling = run.get("sampling", {}).get(mode, {"strategy": "none"})
        if sampling.get("strategy") not in NARROW:
            return df.columns
        named.add(run["data"].get("year", "year"))
        add([run["prep"], sampling])
    return [c for c in df.columns if c in named]


def _run(spark: SparkSession, label: str, keys: list[str], run: dict, splits: tuple, todo: dict[str, dict], mode: str, threshold: str, parallel: int, log: str | None) -> list[tuple]:
    """Rows of the run table for one run under all overrides: one fit of its preprocessing."""
    train = splits[0].persist(StorageLevel.MEMORY_AND_DISK)  # its sample and weights serve all statistics
    kept = [train, *splits[1:]]  # the others are read once, for their vectors
    model = run.get("model", {"kind": "lr"})
    weight = "weight" if run.get("weight_cap") else None
    fitted = Preprocessor(label=label, **run["prep"]).fit(kept[0])
    shared = Pipeline(fitted, Classifier(model["kind"], label, weight=weight, names=fitted.names()), keys)
    vectors = [None if x is None else shared._vectors(x).persist(StorageLevel.MEMORY_AND_DISK) for x in kept]

    def one(item: tuple[str, dict]) -> list[tuple]:
        name, extra = item
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        params = model.get("params", {}) | extra
        classifier = Classifier(model["kind"], label, weight=weight, params=params, names=fitted.names()).fit(vectors[0], vectors[1])
        tuned = vectors[1] is not None
        if tuned:
            classifier.set_threshold(tune(classifier.predict(vectors[1]), label, "p1", threshold))
        facts = {"kind": model["kind"], "mode": mode, "threshold": classifier.threshold, "threshold_tuned": tuned} | {f"override_{k}": v for k, v in extra.items()} | {f"sampling_{k}": v for k, v in run.get("sampling", {}).get(mode, {"strategy": "none"}).items()} | {"weight_cap": run.get("weight_cap")} | {f"param_{k}": v for k, v in params.items()}
        rows = [(name, "param", k, str(v)) for k, v in facts.items()]
        for part, frame in zip(("train", "valid", "test"), vectors, strict=True):
            if frame is not None:
                scored = classifier.predict(frame).select(label, "p1").persist(StorageLevel.MEMORY_AND_DISK)
                metrics = metric_row(scored, label, "p1", classifier.threshold).first().asDict()
                rows += [(name, "metric", f"{part}_{k}", None if v is None else str(v)) for k, v in metrics.items()]
                scored.unpersist()
        if log:
            log_runs(spark.createDataFrame(rows, RUN_SCHEMA), log)
        return rows

    with ThreadPoolExecutor(max(1, min(parallel, len(todo)))) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(one), todo.items()))
    for frame in [*vectors, train]:
        if frame is not None:
            frame.unpersist()
    return [row for rows in found for row in rows]


def log_runs(table: DataFrame, path: str) -> None:
    """Write the runs of ``table``, a part of the log for each; a run that is logged again replaces its record."""
    table.write.mode("overwrite").partitionBy("run_name").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run table of a log; a log that doesn't exist yet has no runs."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).parquet(path).select("run_name", "kind", "key", "value")


def leaderboard(table: DataFrame, key: str = "test_auc_roc") -> DataFrame:
    """``(place, run_name, value)`` by a metric, best first; a row for each run."""
    best = table.where((F.col("kind") == "metric") & (F.col("key") == key)).select("run_name", F.col("value").cast("double").alias("value"))
    return best.select(F.row_number().over(Window.orderBy(F.desc("value"), "run_name")).alias("place"), "run_name", "value")
