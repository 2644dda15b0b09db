"""Written tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where it is unset on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quadloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """A folder of this run's intermediate tables.

    A written table is read back with a fresh plan, so a lost executor costs a re-read and never a
    recomputation of the rounds before. ``drop`` removes what later rounds no longer need, ``close`` all of it; what is left
    when the driver ends goes with it.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        if self._n == 1:
            at, files = self._at(self.root)
            files.deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quadloom_path = path
        return out

    def counted(self, df: DataFrame, condition: str, name: str = "t") -> tuple[DataFrame, int]:
        """A written table and the number of its rows for which the condition holds, counted while writing."""
        seen = Observation()
        out = self.table(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), name)
        return out, seen.get["n"] or 0

    def _at(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables written here that nothing will read again."""
        for t in tables:
            path = getattr(t, "_quadloom_path", None)
            if path and path.startswith(self.root):
                at, files = self._at(path)
                files.delete(at, True)

    def close(self) -> None:
        """Deletes all tables written here; results that read them can't be used any more."""
        at, files = self._at(self.root)
        files.delete(at, True)
