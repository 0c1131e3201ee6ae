"""Sinks and keyed stores on Spark's writers: what a reader sees is complete, and a second run replaces the first.

Writers commit by Spark's protocol; readers skip what is not committed. Small documents, such as manifests, are written by
the driver to a new name and then renamed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a row's digest by which a table's logical hash groups rows; a bucket's digests are one string of a task.
BUCKETS = 1 << 16


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all share: the session's checkpoint folder, in local mode else its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, at: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_document(spark: SparkSession, at: str, value) -> None:
    """A small JSON document, as a whole or not at all."""
    (p, fs), (draft, _) = _path(spark, at), _path(spark, f"{at}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(draft, p):
        raise OSError(f"{at} was not written")


def row_digest(rows: DataFrame) -> Column:
    """A digest of a row's columns by name."""
    return F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)


def logical_hash(rows: DataFrame) -> DataFrame:
    """``rows, logical_sha256``: a digest of a table's rows, with repeats, whatever their order and files.

    Rows' digests are sorted and digested by bucket, then the buckets' digests, so no task holds more than a bucket's.
    """
    d = rows.select(row_digest(rows).alias("d")).groupBy("d").agg(F.count("*").alias("c"))
    line = F.concat_ws(" ", "d", "c")
    buckets = d.groupBy(F.substring("d", 1, 4).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"), F.sum("c").alias("n"))
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "b", "h"))), "\n")
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(lines, 256).alias("logical_sha256"))


def write_shards(rows: DataFrame, at: str, keys: list[str], max_rows: int = 100_000, compression: str = "zstd") -> None:
    """A partitioned table in shards of at most ``max_rows`` rows; of a key's rows in as many tasks as have them.

    A table without rows leaves ``_EMPTY.json``, so that an empty result differs from none.
    """
    out = rows.write.mode("overwrite").option("maxRecordsPerFile", max_rows).option("compression", compression)
    (out.partitionBy(*keys) if keys else out).parquet(at)
    if rows.sparkSession.read.schema(rows.schema).parquet(at).isEmpty():
        write_document(rows.sparkSession, f"{at}/_EMPTY.json", {"rows": 0})


def replace_partitions(rows: DataFrame, at: str, keys: list[str]) -> None:
    """Rows of some keys in place of all earlier rows of the same keys; other keys' rows stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(at)


def delete_partition(spark: SparkSession, at: str, **keys) -> None:
    p, fs = _path(spark, "/".join([at, *(f"{k}={v}" for k, v in keys.items())]))
    fs.delete(p, True)


def write_text(rows: DataFrame, at: str, kind: str) -> None:
    """JSON lines or CSV with a header, committed as a whole."""
    if kind == "json":
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(at)
    else:
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(at)


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """Of an append-only store the last record of each key."""
    cols = records.columns
    return records.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select("r.*")


def still_to_do(asked: DataFrame, records: DataFrame, key: str, order: str, same: list[str], status: str = "status", valid: str = "VALID") -> DataFrame:
    """The requests without a valid last record that agrees with them in ``same`` (model, prompt digest)."""
    done = latest(records, key, order).where(F.col(status) == valid).select(key, *same)
    return asked.join(done, [key, *same], "left_anti")


def request_digest(*columns: str) -> Column:
    """The address of a request in a result cache: a digest of all that identifies it."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def cached(asked: DataFrame, cache: DataFrame, identity: list[str], output: str) -> DataFrame:
    """The requests with ``output`` from the cache, null where it has none; a digest that meets another identity is none."""
    found = cache.select(F.col("digest").alias("_d"), F.struct(*identity).alias("_same"), output).dropDuplicates(["_d"])
    rows = asked.withColumn("digest", request_digest(*identity)).join(found, F.col("digest") == F.col("_d"), "left")
    return rows.select(*asked.columns, "digest", F.when(F.col("_same") == F.struct(*[asked[c] for c in identity]), F.col(output)).alias(output))


def same_schema(rows: DataFrame, columns: set[str]) -> DataFrame:
    """The rows, if they have exactly these columns (a guard before a partition is read)."""
    if set(rows.columns) != set(columns):
        raise ValueError(f"unexpected {sorted(set(rows.columns) - columns)}, missing {sorted(columns - set(rows.columns))}")
    return rows


def partition_path(root: str, **keys: str) -> str:
    """The path of one partition; a value that would leave the root is refused."""
    for k, v in keys.items():
        if not v or v in (".", "..") or "/" in v or "\\" in v:
            raise ValueError(f"{k} is no name of a partition")
    return "/".join([root.rstrip("/"), *(f"{k}={v}" for k, v in keys.items())])
