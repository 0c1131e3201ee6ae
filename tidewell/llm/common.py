"""What the corpus operators share: bounded Arrow batches, shared folders, input projection."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Whole texts travel in it, so it bounds a Python worker's memory.
BATCH_ROWS = 256


def _ship(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package. On a cluster it is installed, or given by ``--py-files``."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":")
    if root not in known:
        env["PYTHONPATH"] = ":".join([root, *filter(None, known)])


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Set what the operators need of a session: small Arrow batches, for rows hold whole texts."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, with a null text as the empty one; other columns are not read."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until no column has it."""
    out = []
    for w in wanted:
        while w in {n.lower() for n in [*names, *out]}:
            w = "_" + w
        out.append(w)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where the session has none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Of each ``settled`` call that is under way, the tables written within it.
_within: list[list[str]] = []


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder and its path: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    if _within:
        _within[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settled(spark: SparkSession, what: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build()`` returns, as a table in the shared folder; the tables that it wrote on the way are deleted."""
    _within.append([])
    try:
        df, path = build(), scratch(spark, what)
        df.write.parquet(path)
    finally:
        for at in _within.pop():
            delete(spark, at)
    if _within:
        _within[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a worker's freed memory to the system: workers outlive their tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    prepare(df.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL schema, without a session (usable in executors)."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(kinds[k]) for k in ("long", "int", "double")}
    return pa.schema([pa.field(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def batch_of(columns: dict[str, list], ddl: str) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def partition_number() -> int:
    from pyspark import TaskContext

    at = TaskContext.get()
    return at.partitionId() if at else 0
