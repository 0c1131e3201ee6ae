"""Connected components of an edge table by alternating large-star and small-star steps, in Spark joins only.

Every step's table is written to the shared folder: lineage stays short and a lost executor costs one step. Neither
edges nor components go to the driver, only a count and a checksum of each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import delete, written


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _tidy(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root``: the smallest node reachable from each node of an edge. Nodes without edges are not listed.

    Self-loops and repeated edges count for nothing; an edge with a null end is no edge; no edges give no rows.
    """
    spark = edges.sparkSession
    now, path = written(_tidy(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).dropna()), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        after, at = written(_small(_large(now)), "edges")
        delete(spark, path)
        now, path = after, at
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
