"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.scratch import scratch_path as fresh_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing will read any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(df: DataFrame) -> DataFrame:
    """``(all, file, index)``: each row of ``df`` as a struct, and a key that every read of it gives again.

    The key is a hash of the file's path and the row's number in it.  A frame that isn't a plain read of
    Parquet files, with filters and projections at most, is stored first.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    keyed = lambda x: x.select(F.struct(*x.columns).alias("all"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))
    if plan.nodeName() == "LogicalRelation":
        try:
            return keyed(df)
        except AnalysisException:
            pass
    return keyed(stored(df, "rows"))


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, as ``--py-files`` would; once for a context."""
    context = spark.sparkContext
    if getattr(context, "_panelspark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "panelspark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._panelspark_shipped = True
