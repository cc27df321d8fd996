"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it again.
The files stand in ``spark.checkpoint.dir``, so the loss of an executor never
costs more than the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster
    session gets a folder in the warehouse, never a machine-local one.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        folder = f"file://{tempfile.mkdtemp(prefix='skein-')}"
    else:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_skein_scratch"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables of one operator call, removed when the session's JVM ends or with ``drop``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._path(self.root)[1].deleteOnExit(self._path(self.root)[0])

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str, by: str | None = None, clean: bool = False, compression: str | None = None) -> DataFrame:
        """Write ``df`` once, in a folder per value of ``by``, and return the table read back, without lineage.

        With ``clean`` its shuffle files go as soon as it is written; ``df`` is
        not to be used again then.
        """
        writer = df.write.mode("overwrite").options(**({"compression": compression} if compression else {}))
        old = self.spark.conf.get(CLEANUP, "false")
        try:
            if clean:
                self.spark.conf.set(CLEANUP, "true")
            (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, old)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def uri(self, name: str) -> str:
        """The table's folder, as tasks open it without Spark."""
        path, system = self._path(f"{self.root}/{name}")
        found = system.makeQualified(path).toString()
        return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        path, fs = self._path(f"{self.root}/{name}")
        fs.delete(path, True)
