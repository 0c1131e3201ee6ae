"""Strictly-past context of rows on a timeline: what has happened to the same key before a row, and not at its time.

All windows are RANGE frames over whole milliseconds that end one before the row, so rows of one time never see each
other, and a contributor exactly a horizon old counts. Nothing here joins a table with itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def past(keys: list[str], time: str, horizon: int | None = None):
    """The window of the rows of ``keys`` in ``[time - horizon, time)``; all past without a horizon."""
    w = Window.partitionBy(*keys).orderBy(time)
    return w.rangeBetween(Window.unboundedPreceding if horizon is None else -horizon, -1)


def distinct_over(column: str, window) -> Column:
    return F.size(F.collect_set(column).over(window)).cast("long")


def last_seen_gap(keys: list[str], time: str, seen: str | None = None, none: int | None = -1) -> Column:
    """Time since the latest past ``seen`` of the key, however long ago; ``none`` if there is no past row."""
    gap = F.col(time) - F.max(seen or time).over(past(keys, time))
    return F.coalesce(gap, F.lit(none).cast("long")) if none is not None else gap


def timeline(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Each row twice: as a contributor at its ``end`` and as a target at its ``start`` (``is_target``, ``at``)."""
    events = F.array(F.struct(F.lit(False).alias("is_target"), F.col(end).alias("at")), F.struct(F.lit(True).alias("is_target"), F.col(start).alias("at")))
    return rows.withColumn("_e", F.explode(events)).select("*", "_e.is_target", "_e.at").drop("_e")


def completed_history(rows: DataFrame, keys: list[str], start: str, end: str, horizon: int, sums: Mapping[str, Column], prefix: str) -> DataFrame:
    """Sums over contributors of the key that ended in ``[start - horizon, start)`` and the gap since the latest end."""
    line = timeline(rows, start, end)
    recent, ever = past(keys, "at", horizon), past(keys, "at")
    given = lambda c: F.when(~F.col("is_target"), c)
    cols = {f"{prefix}_{n}": F.coalesce(F.sum(given(c)).over(recent), F.lit(0)).cast("long") for n, c in sums.items()}
    cols[f"{prefix}_gap"] = F.coalesce(F.col("at") - F.max(given(F.col(end))).over(ever), F.lit(-1)).cast("long")
    return line.withColumns(cols).where("is_target").drop("is_target", "at")


def delta_history(rows: DataFrame, keys: list[str], time: str, horizon: int, value: str, prefix: str) -> DataFrame:
    """Count and sum as ``past(keys, time, horizon)`` gives them, for dense keys: each row enters at its time and leaves
    after the horizon, and running totals replace frames, so the cost does not grow with the rows in a frame."""
    kinds = F.array(
        F.struct(F.lit(True).alias("is_target"), F.col(time).alias("at"), F.lit(1).alias("sign")),
        F.struct(F.lit(False).alias("is_target"), (F.col(time) + horizon).alias("at"), F.lit(-1).alias("sign")),
    )
    line = rows.withColumn("_e", F.explode(kinds)).select("*", "_e.is_target", "_e.at", "_e.sign").drop("_e")
    w = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    line = line.withColumns({f"{prefix}_count": F.coalesce(F.sum("sign").over(w), F.lit(0)).cast("long"), f"{prefix}_sum": F.coalesce(F.sum(F.col("sign") * F.col(value)).over(w), F.lit(0)).cast("long")})
    return line.where("is_target").drop("is_target", "at", "sign")


def intervals(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Gap of each row to the one before it in its key (null for the first)."""
    return rows.withColumn("gap", F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time, tie)))
