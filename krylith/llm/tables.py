"""Tables between the steps of an operator, written to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark remove the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a temporary folder of this machine, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="krylith-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Writes DataFrames as Parquet tables, which cuts lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/krylith-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, frame: DataFrame, row_check: int | None = None) -> DataFrame:
        """row_check: look at the size of a Parquet row group after so many rows, for tables of few large rows."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        writer = frame.write.option("compression", "zstd")
        if row_check:
            writer = writer.option("parquet.block.size.row.check.min", row_check).option("parquet.page.size.row.check.min", row_check)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        saved = self.spark.read.schema(frame.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def save_sorted(self, frame: DataFrame, key: str, buckets: int, path: str | None = None) -> DataFrame:
        """A table in buckets of the hash of key, each sorted by it: joins on key neither exchange nor sort it again.

        frame should come out of a grouping by key over as many partitions as there are buckets: each is then one file.
        """
        self.n += 1
        path = path or f"{self.folder}/{self.n}"
        name = f"krylith_{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            frame.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        finally:
            self.spark.conf.set(CLEANUP, before)
        saved = self.spark.table(name)
        saved.scratch_path, saved.scratch_table = path, name
        return saved

    def open_sorted(self, path: str, schema: str, key: str, buckets: int) -> DataFrame:
        """A table that save_sorted wrote, in this session or an earlier one."""
        name = f"krylith_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        saved = self.spark.table(name)
        saved.scratch_path, saved.scratch_table = path, name
        return saved

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, in order; nothing if it isn't there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(folder)
        system = where.getFileSystem(conf)
        return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []

    def drop(self, *frames: DataFrame | None) -> None:
        """Removes tables that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            if path := getattr(frame, "scratch_path", None):
                if name := getattr(frame, "scratch_table", None):
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)

    def release(self) -> None:
        """Lets Spark's cleaner remove shuffle files whose frames are gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
