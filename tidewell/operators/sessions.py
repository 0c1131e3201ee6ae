"""Sessions by idle gap, activity groups and chronological or hashed splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(rows: DataFrame, keys: list[str], start: str, end: str, gap: int, tie: str) -> DataFrame:
    """``session`` numbers from 0 for each key: a row opens one if it starts over ``gap`` after all before it ended."""
    order = Window.partitionBy(*keys).orderBy(start, tie)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull(), 0).when(F.col(start) - before > gap, 1).otherwise(0)
    return rows.withColumn("_o", opens).withColumn("session", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_o")


def gap_groups(rows: DataFrame, keys: list[str], time: str, ordinal: str, gap: int) -> DataFrame:
    """``episode`` numbers in the given order of rows: a step of over ``gap`` opens one, a step back never does."""
    order = Window.partitionBy(*keys).orderBy(ordinal)
    opens = F.when(F.col(time) - F.lag(time).over(order) > gap, 1).otherwise(0)
    return rows.withColumn("_o", opens).withColumn("episode", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_o")


def unordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def activity_group(time: str, a: str, b: str, width: int = 300_000) -> Column:
    """A digest of the time block and the unordered pair."""
    return F.sha2(F.concat_ws("|", F.floor(F.col(time) / width).cast("long"), F.least(a, b), F.greatest(a, b)), 256)


def bucket(digest: Column, n: int) -> Column:
    """A hash bucket of hex text: its first 15 digits modulo ``n``."""
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def hash_split(digest: Column) -> Column:
    """70/15/15 by group digest."""
    b = bucket(digest, 100)
    return F.when(b < 70, "train").when(b < 85, "validation").otherwise("test")


def chronological_split(start: str, end: str, low: Column, high: Column, gap: int) -> Column:
    """70/15/15 by time within ``[low, high]``: whole rows inside a part, half a gap from its edges, else quarantine."""
    span = high - low
    a, b, half = low + span * 0.70, low + span * 0.85, gap / 2
    s, e = F.col(start), F.col(end)
    return F.when(e <= a - half, "train").when((s >= a + half) & (e <= b - half), "validation").when(s >= b + half, "test").otherwise("quarantine")


def embargo_split(start: str, end: str, first: Column, second: Column, embargo: int) -> Column:
    """By two boundaries with an embargo about each; rows that touch an embargo are quarantined."""
    half = embargo / 2
    s, e = F.col(start), F.col(end)
    return F.when(e <= first - half, "train").when((s >= first + half) & (e <= second - half), "validation").when(s >= second + half, "test").otherwise("quarantine")
