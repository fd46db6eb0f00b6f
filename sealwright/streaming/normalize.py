"""normalize() over streams: the same stateless transform, and windowed counts of its statuses."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import normalize


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def normalize_stream(stream: DataFrame, contract: Any, **options: Any) -> DataFrame:
    """As normalize(); no state is kept, so no watermark is needed."""
    return normalize(stream, contract, **options)


def status_windows(artifacts: DataFrame, time: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts by event-time window and status; rows later than `late` are not counted."""
    return artifacts.withWatermark(time, late).groupBy(F.window(time, size), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "status", "n")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append to Parquet, once for all that is there now."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
