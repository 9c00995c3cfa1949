"""Intermediate tables: lineage is cut by writing to the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: After so many tables the driver collects its garbage: only then does Spark remove the shuffle files and broadcasts of
#: finished jobs from the executors, which otherwise stay until the driver's heap happens to fill.
RELEASE_EVERY = 3


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, one of our own if driver and executors are one machine
    (a local master, as in tests); on a cluster an error, as executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lexigraph-")
        atexit.register(_remove_local, _OWN[app])
    return _OWN[app]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Tables of one run of an operator. ``keep`` writes one, ``drop`` removes those no longer read.

    A table that the returned DataFrame still reads must stay until the session ends; then all that is left of the run is removed.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lexigraph-{operator}-{uuid.uuid4().hex}"
        self._kept = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)  # when the driver's JVM ends

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self._kept += 1
        if self._kept % RELEASE_EVERY == 0:
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def size(self, name: str) -> int:
        """Bytes on disk."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(conf).getContentSummary(path).getLength()
