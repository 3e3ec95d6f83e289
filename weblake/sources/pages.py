"""Raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """pages(page_id, url, html) without those that came back empty.

    Parsing costs far more than reading: where few splits feed many cores, make the splits smaller
    (``spark.sql.files.maxPartitionBytes``), which shuffles nothing.
    """
    return (spark.read.parquet(path).select("page_id", "url", "html")
            .filter(F.col("html").isNotNull() & (F.col("html") != "")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Stored image files below shard folders: photo_sha1, path, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([0-9a-f]{40})\.jpg$", 1).alias("photo_sha1"),
                        "path", "length", "content")
