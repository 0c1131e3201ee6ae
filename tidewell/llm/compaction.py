"""Size-tiered compaction of a table kept as immutable shards, in DataFrame operations and file-system calls.

A store is a folder. ``data/`` holds runs, each a folder of its own name with Parquet files that never change;
``lists/`` holds tables of live files; ``versions/`` one small file for each version, which names its list. A version is
committed by giving a finished file its number, which fails if the number is taken (a hard link on a local file system, a
rename without overwriting elsewhere). So readers see the old version or the new one, and of two writers of one number
exactly one succeeds; the other takes up the newer version and tries the next number. Files that no list names are not
data: what a crashed writer leaves behind hinders no later one, and goes with ``vacuum``.

``append`` writes arrivals as small shards without a shuffle. ``compact`` merges files of one size tier (a power of
``FACTOR`` times the least size) to files of about the target size, by reading a tier's small files with as few tasks as
there are targets; sizes within a tier differ by less than ``FACTOR``, so tasks are even. It repeats, a bounded number
of files at a time, until no tier below the target has ``FANOUT`` files; each file is rewritten about once a tier.

Rows are kept as they are: nulls, repeats and all columns, whatever their names. An empty arrival commits a version; an
empty store reads as no rows of the schema it was made with.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTOR, FANOUT = 4, 4
#: Files that one merge of a tier takes at most: the driver holds that many paths at once.
MERGE_FILES = 10_000
#: Times that a commit takes up a newer version of another writer.
TRIES = 50
#: Seconds that what no kept version names stays at least: longer than any writer or reader needs it.
AGE = 7 * 24 * 3600

LIVE_DDL = "path string, bytes long, rows long, tier int, run string"


class Stale(RuntimeError):
    """Another writer removed a file that a commit builds on."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema, target_bytes: int = 128 << 20, least_bytes: int = 1 << 16):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.least = target_bytes, least_bytes

    def _path(self, at: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list:
        p, fs = self._path(f"{self.root}/{folder}")
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed("versions")]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _list_of(self, version: int) -> str:
        p, fs = self._path(f"{self.root}/versions/v{version}")
        stream = fs.open(p)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """``path, bytes, rows, tier, run`` of a version's live files, of the newest if none is given."""
        at = self.version() if version is None else version
        if not at:
            return self.spark.createDataFrame([], LIVE_DDL)
        return self.spark.read.schema(LIVE_DDL).parquet(f"{self.root}/lists/{self._list_of(at)}")

    def _publish(self, version: int, name: str) -> bool:
        """Give the list ``name`` the number ``version``; False if it is taken."""
        jvm = self.spark.sparkContext._jvm
        draft, fs = self._path(f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        final, _ = self._path(f"{self.root}/versions/v{version}")
        stream = fs.create(draft, False)
        stream.writeUTF(name)
        stream.close()
        local = fs.makeQualified(draft).toUri().getScheme() == "file"
        try:
            if local:  # its rename overwrites; a link does not
                at = [jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri()) for p in (final, draft)]
                jvm.java.nio.file.Files.createLink(*at)
            else:
                conf = self.spark.sparkContext._jsc.hadoopConfiguration()
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, final, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(draft, False)
        return True

    def _commit(self, after: Callable[[DataFrame], DataFrame]) -> int:
        """Commit what ``after`` makes of the newest version's files as the next version."""
        for _ in range(TRIES):
            version, name = self.version(), uuid.uuid4().hex
            after(self.manifest(version)).coalesce(1 + version // 1000).write.parquet(f"{self.root}/lists/{name}")
            if self._publish(version + 1, name):
                return version + 1
            self._delete(f"lists/{name}")
        raise RuntimeError("other writers committed all the while")

    def _delete(self, at: str) -> None:
        p, fs = self._path(f"{self.root}/{at}")
        fs.delete(p, True)

    def _tier(self, size: Column) -> Column:
        return F.greatest(F.lit(0), F.floor(F.log(float(FACTOR), size / self.least))).cast("int")

    def _files(self, run: str) -> DataFrame:
        """The files of a run, by its footers' counts."""
        read = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{run}")
        named = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        counted = named.groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        return counted.select("path", "bytes", "rows", self._tier(F.col("bytes")).alias("tier"), F.lit(run).alias("run"))

    def append(self, arrivals: DataFrame, shard_rows: int = 2000) -> int:
        """Write ``arrivals`` as shards of ``shard_rows`` rows at most and commit them; returns the version."""
        run = f"arrivals-{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", shard_rows).parquet(f"{self.root}/data/{run}")
        return self._commit(lambda live: live.unionByName(self._files(run)))

    def compact(self) -> int:
        """Merge until no tier below the target has ``FANOUT`` files; returns the version."""
        while True:
            version = self.version()
            small = self.manifest(version).where(F.col("bytes") * 2 <= self.target)
            tiers = small.groupBy("tier").agg(F.count("*").alias("files")).where(F.col("files") >= FANOUT).orderBy("tier").limit(1).collect()
            if not tiers:
                return version
            tier = tiers[0]["tier"]
            some = small.where(F.col("tier") == tier).orderBy("path").limit(MERGE_FILES).select("path", "bytes").collect()
            merged = max(1, round(sum(r["bytes"] for r in some) / self.target))
            run = f"tier{tier}-{uuid.uuid4().hex}"
            paths = [r["path"] for r in some]
            self.spark.read.schema(self.schema).parquet(*paths).coalesce(merged).write.parquet(f"{self.root}/data/{run}")
            gone = self.spark.createDataFrame([(p,) for p in paths], "path string")

            def after(live: DataFrame) -> DataFrame:
                if live.join(gone, "path", "left_semi").count() < len(paths):
                    raise Stale("another writer merged these files")
                return live.join(gone, "path", "left_anti").unionByName(self._files(run))

            try:
                self._commit(after)
            except Stale:  # that writer did the work
                self._delete(f"data/{run}")

    def vacuum(self, age: float = AGE, keep: int = 1) -> None:
        """Delete old versions, and runs and lists that none of the newest ``keep`` versions name, if older than ``age`` seconds.

        The age protects runs that a writer has not committed yet, and files that a reader of an older version still reads.
        """
        kept = self.versions()[-keep:]
        lists = {self._list_of(v) for v in kept}
        runs = {r["run"] for v in kept for r in self.manifest(v).select("run").distinct().collect()}
        before = (time.time() - age) * 1000
        for folder, names in (("versions", {f"v{v}" for v in kept}), ("lists", lists), ("data", runs)):
            for s in self._listed(folder):
                name = s.getPath().getName()
                if name not in names and s.getModificationTime() <= before:
                    self._delete(f"{folder}/{name}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the newest if none is given."""
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def placed(self, *columns: Column) -> DataFrame:
        """The given columns of the live rows, and ``run, tier, file_bytes`` of the file that holds each."""
        rows = self.read()
        if not self.version() or not rows.inputFiles():
            return rows.select(*columns, F.lit("").alias("run"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("file_bytes"))
        run = F.element_at(F.split("_metadata.file_path", "/"), -2)
        size = F.col("_metadata.file_size")
        return rows.select(*columns, run.alias("run"), self._tier(size).alias("tier"), size.alias("file_bytes"))


def store_and_compact(docs: DataFrame, root: str, waves: int = 4, target_bytes: int = 128 << 20, shard_rows: int = 2000) -> ShardStore:
    """``docs`` in ``waves`` arrivals, by hash of the id, each appended; then compacted. No other writer is at work, so all else goes at once."""
    store = ShardStore(docs.sparkSession, root, docs.schema, target_bytes)
    for wave in range(waves):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(waves)) == wave), shard_rows)
    store.compact()
    store.vacuum(age=0)
    return store
