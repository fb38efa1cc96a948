"""Access to the given tables and to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, local runs take a new local one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The session's setting by which Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bound what goes to a Python worker at once, unless the application set a bound itself.

    Spark's own bounds (10,000 rows, or some tens of MB) stand several times side by side in each task's JVM and worker.
    """
    given = spark.sparkContext.getConf()
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not given.contains(key):
            spark.conf.set(key, value)


class Scratch:
    """Written tables that cut lineage, in the shared folder.

    A table that is written and read again survives lost executors, and its rows do not change when a later
    stage is computed anew. `drop` deletes tables that nothing reads any more (the rounds of an iteration).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def keep(self, frame: DataFrame) -> DataFrame:
        """Write a table and read it again. The shuffle files behind it go at once: nothing but the table is read later."""
        path, before = self.path(), self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            frame.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, frame: DataFrame | None) -> None:
        """Delete the files of a table that `keep` returned."""
        for file in frame.inputFiles() if frame is not None else []:
            if self.root.rpartition("/")[2] in file:
                self._delete(file.rpartition("/")[0])
                return

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
