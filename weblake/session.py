"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Joins carry no broadcast hint: Spark broadcasts a side only when its measured size is under the
# threshold, and AQE cuts the partitions of a hot key into several tasks when it is not.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

_local_root: str | None = None


def work_root(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``).

    Only a local session may go without it and gets a temporary folder; on a cluster such a folder
    would be lost with its machine.
    """
    global _local_root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="weblake-")
    return _local_root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below :func:`work_root`."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


class Work:
    """A folder of intermediate tables under ``work_root``.

    ``table`` writes a DataFrame and reads it back, which cuts its lineage in a way that outlives a
    lost executor. ``drop`` frees a table early; what is left goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
        path, files = self._files(self.folder)
        files.mkdirs(path)  # only a path that exists can be marked for deletion
        files.deleteOnExit(path)

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._files(self.path(name))
            files.delete(path, True)
