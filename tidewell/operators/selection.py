"""Deterministic sampling: ranks by hash, quotas, rounds and nested choices, as window ranks that stay bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: str, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)


def representative(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r")


def head(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def round_robin(rows: DataFrame, scope: list[str], cell: list[str], order: list, cell_order: list, n: int) -> DataFrame:
    """``n`` rows of each scope, one of each cell a round: by (round, cell), with ``round`` and ``pick``."""
    rounds = rows.withColumn("round", F.row_number().over(Window.partitionBy(*scope, *cell).orderBy(*order))).where(F.col("round") <= n)
    return rounds.withColumn("pick", F.row_number().over(Window.partitionBy(*scope).orderBy("round", *cell_order))).where(F.col("pick") <= n)


def largest_remainder(counts: DataFrame, count: str, total: int, order: list) -> DataFrame:
    """``quota`` of each row of a small table, in proportion to ``count``: floors, then one each to the largest remainders."""
    everything = Window.partitionBy()
    share = F.col(count) * total
    floor = F.floor(share / F.sum(count).over(everything))
    rest = share - floor * F.sum(count).over(everything)
    ranked = counts.withColumns({"_f": floor, "_r": rest}).withColumns({"_left": total - F.sum("_f").over(everything), "_k": F.row_number().over(Window.partitionBy().orderBy(F.desc("_r"), *order))})
    return ranked.withColumn("quota", (F.col("_f") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_f", "_r", "_left", "_k")
