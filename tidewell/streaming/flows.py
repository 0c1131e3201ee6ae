"""Streams of flow rows: sessions by idle time, counts by window, rows once each. State is bounded by a watermark.

A row that comes later than the watermark allows is dropped from the state and counted nowhere else; ``late`` says how late
a row may be. Results leave once the watermark has passed them (append mode), so each is final.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_flows(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first of the rows of an id that come within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def idle_sessions(rows: DataFrame, keys: list[str], time: str, gap: str, late: str, size: str) -> DataFrame:
    """``keys, start, end, n, total`` of sessions that end when a key is idle for ``gap``."""
    s = rows.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(size).alias("total"))
    return s.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def windowed(rows: DataFrame, keys: list[str], time: str, width: str, slide: str, late: str, size: str) -> DataFrame:
    """``keys, start, n, total`` of sliding windows."""
    w = rows.withWatermark(time, late).groupBy(*keys, F.window(time, width, slide).alias("w")).agg(F.count("*").alias("n"), F.sum(size).alias("total"))
    return w.select(*keys, F.col("w.start").alias("start"), "n", "total")


def run(rows: DataFrame, to: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Take in all that is there and stop; a later run goes on from ``checkpoint``. Batches go to a table, or to ``each``.

    A batch that is repeated after a failure replaces its own files, so no row is written twice.
    """
    out = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (out.foreachBatch(each).start() if each else out.format("parquet").start(to)).awaitTermination()
