"""Table sets kept as versions: a version is a folder that readers see once it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_READY = "_READY"


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern."""
    path, files = _place(spark, pattern)
    return [status.getPath().toString() for status in files.globStatus(path) or ()]


def put_mark(spark: SparkSession, path: str) -> None:
    """An empty file that says that something is complete."""
    path, files = _place(spark, path)
    files.create(path).close()


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        path, files = _place(spark, path)
        files.delete(path, True)


def _numbers(spark: SparkSession, root: str, below: str = "") -> list[int]:
    return [int(path.split("/version=")[1].split("/")[0]) for path in listed(spark, f"{root}/version=*{below}")]


def write_version(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write all tables as the next version and mark it ready when the last one is written.

    Tables may be derived from :func:`read_version`: no folder is written to that another version
    reads. A run that fails leaves a folder without its mark, which nobody reads. One writer at a time.
    """
    number = max(_numbers(spark, root), default=0) + 1
    for name, df in tables.items():
        df.write.parquet(f"{root}/version={number}/{name}")
    put_mark(spark, f"{root}/version={number}/{_READY}")
    return number


def read_version(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version by name, of the latest ready one by default; none: no tables."""
    ready = _numbers(spark, root, f"/{_READY}")
    number = max(ready, default=None) if number is None else number
    if number not in ready:
        return {}
    names = [path.rsplit("/", 1)[1] for path in listed(spark, f"{root}/version={number}/[!_]*")]
    return {name: spark.read.parquet(f"{root}/version={number}/{name}") for name in names}
