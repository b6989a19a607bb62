"""Fitted pipelines on streams: transforms are expressions, broadcast lookups and ML models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from panelspark.operators.experiments import Pipeline


def score_stream(stream: DataFrame, pipeline: Pipeline, path: str, checkpoint: str) -> StreamingQuery:
    """Append predictions for a stream's rows as Parquet; restarts go on from ``checkpoint``."""
    return pipeline.predict(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
