"""Flow rows from the event table: the columns that a flow record has, under its names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flow_id, start_ms, end_ms, src, dst, dport, bytes, packets, label`` of ``events``.

    Times are milliseconds since the epoch, in UTC whatever the session's zone.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    start = F.floor(micros / 1000).cast("long")
    return e.select(
        F.col("event_id").cast("long").alias("flow_id"),
        start.alias("start_ms"),
        (start + F.floor(F.col("value") * 1000).cast("long")).alias("end_ms"),
        F.col("user_id").cast("long").alias("src"),
        (F.col("event_id") % 97).cast("long").alias("dst"),
        (F.col("event_id") % 13).cast("int").alias("dport"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes"),
        (1 + F.col("event_id") % 16).cast("long").alias("packets"),
        F.col("event_type").alias("label"),
    )


#: The same rows for the oracle.
FLOWS_SQL = """(select cast(event_id as bigint) flow_id, cast(floor(epoch_us(ts) / 1000) as bigint) start_ms,
 cast(floor(epoch_us(ts) / 1000) as bigint) + cast(floor(value * 1000) as bigint) end_ms, cast(user_id as bigint) src,
 cast(event_id % 97 as bigint) dst, cast(event_id % 13 as integer) dport, cast(floor(value * 100) as bigint) bytes,
 cast(1 + event_id % 16 as bigint) packets, event_type as label from events)"""
