"""Streams of samples and frames: arriving files, online statistics, sessions, and pairs of two streams.

Gaps, attitudes and nearest pairs, whose state ends, are in `ordered`.

Monotonic nanoseconds are no wall clock. Where a watermark needs a timestamp, one is derived from them; the long stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.operators import asof


def chunk_files(spark: SparkSession, path: str, pattern: str, per_trigger: int = 100) -> DataFrame:
    """Files as they arrive, with their content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)


def with_event_time(rows: DataFrame, ts_ns: str = "ts_ns", late: str = "10 seconds") -> DataFrame:
    """Rows with event_time and its watermark."""
    return rows.withColumn("event_time", F.timestamp_micros(asof.floor_div(ts_ns, 1000))).withWatermark("event_time", late)


def windowed(rows: DataFrame, key: str, value: str, length: str = "1 second", slide: str | None = None) -> DataFrame:
    """Count, mean and extremes by key and window; rows later than the watermark are left out."""
    return rows.groupBy(key, F.window("event_time", length, slide)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def sessions(rows: DataFrame, key: str, pause: str) -> DataFrame:
    """Runs of rows without a pause longer than that."""
    return rows.groupBy(key, F.session_window("event_time", pause)).agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def paired(left: DataFrame, right: DataFrame, key: str, gate_ms: int) -> DataFrame:
    """Pairs of two watermarked streams within the gate, which bounds their state; `ordered.nearest_stream` chooses the nearest."""
    a, b = left.alias("a"), right.alias("b")
    span = F.expr(f"b.event_time between a.event_time - interval {gate_ms} milliseconds and a.event_time + interval {gate_ms} milliseconds")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & span)
