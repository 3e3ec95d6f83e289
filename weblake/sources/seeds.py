"""Seed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weblake.config import BLOG, PRODUCT
from weblake.functions.text import remove_space
from weblake.functions.urls import url_sha1


def read_seeds(seeds: DataFrame, kind: str = "blog") -> DataFrame:
    """Live seeds of one kind as frontier items of depth 1.

    ``seed_url`` is what scope tests and the hash use. For product seeds it is the URL without white
    space, while the item keeps the URL as written.
    """
    live = seeds.filter(F.col("deleted") == 0)
    if kind == "blog":
        live = live.filter(F.col("photosourcetype_id") == BLOG)
        seed_url, extra = F.col("url"), [F.lit(None).cast("string").alias(c) for c in ("category", "category_1")]
    else:
        live = live.filter((F.col("photosourcetype_id") == PRODUCT) & (F.col("webkit") == 0)
                           & (F.col("url") != "") & F.col("id").isNotNull())
        seed_url, extra = remove_space(F.col("url")), ["category", "category_1"]
    return live.select(
        F.col("id").alias("seed_id"), "url", seed_url.alias("seed_url"), url_sha1(seed_url).alias("url_sha1"),
        F.lit(1).alias("depth"), F.col("photosourcetype_id").cast("int").alias("pagetype"), *extra)
