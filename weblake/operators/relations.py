"""Existence checks and relations between pages, photos and seeds, by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from weblake.functions import urls as U
from weblake.operators.frontier import first_seen


def exists_flag(df: DataFrame, target: DataFrame, on: Sequence[str] | str, out: str = "found") -> DataFrame:
    """1 where the key is in the target, else 0."""
    keys = [on] if isinstance(on, str) else list(on)
    present = target.select(*keys).dropDuplicates().withColumn(out, F.lit(1))
    return df.join(present, keys, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def relation_exists(pairs: DataFrame, relation: DataFrame, left: DataFrame, right: DataFrame,
                    keys=("page_sha1", "photo_sha1"), out: str = "found") -> DataFrame:
    """1 where the pair is related and both sides are stored."""
    stored = link_by_hash(relation.select(*keys).dropDuplicates(), left, right, keys)
    return exists_flag(pairs, stored.filter(F.col("linked") == 1), keys, out)


def link_by_hash(pairs: DataFrame, left: DataFrame, right: DataFrame,
                 keys=("page_sha1", "photo_sha1")) -> DataFrame:
    """Pairs with linked = 1 when both sides exist; the others are the failures."""
    both = exists_flag(exists_flag(pairs, left, keys[0], "_left"), right, keys[1], "_right")
    return both.withColumn("linked", F.col("_left") * F.col("_right")).drop("_left", "_right")


def pairs_from_json(df: DataFrame, column: str = "pair_json") -> DataFrame:
    """JSON [image_url, page_url] → photo_sha1, page_sha1; rejected = 1 for anything else."""
    items = df.withColumn("_pair", F.from_json(column, "array<string>"))
    image, page = F.get("_pair", F.lit(0)), F.get("_pair", F.lit(1))
    good = F.coalesce(image.isNotNull() & page.isNotNull(), F.lit(False))
    return items.select(
        *df.columns, F.when(good, U.url_sha1(image)).alias("photo_sha1"),
        F.when(good, U.url_sha1(U.strip_slash(page))).alias("page_sha1"),
        F.when(good, 0).otherwise(1).alias("rejected")).drop(column)


def _last(updates: DataFrame, order_by) -> DataFrame:
    """The last update of each page; without an order column the whole row decides."""
    order = [c for c in order_by if c in updates.columns] or updates.columns
    return first_seen(updates, ["pageurlhash"], [F.col(c).desc() for c in order])


def enrich_main_image(products: DataFrame, photos: DataFrame, updates: DataFrame,
                      order_by=("ts", "event_id")) -> DataFrame:
    """Update products by hash, each with its last update, and set their main image where its photo is stored.

    An update without a product is inserted, then without main image. products: pageurlhash, title,
    price, size, productid, pagetext, mainimage_sha1, daterefresh; updates: the same with ts.
    """
    known = exists_flag(_last(updates, order_by), photos.select(F.col("photourlhash").alias("mainimage_sha1")),
                        "mainimage_sha1", "_stored")
    names = ("title", "price", "size", "productid", "pagetext")
    news = known.select(
        "pageurlhash", *(F.col(c).alias(f"_{c}") for c in names), F.col("ts").alias("_ts"),
        F.when(F.col("_stored") == 1, F.col("mainimage_sha1")).alias("_image"))
    had = F.col("_had").isNotNull()
    joined = products.withColumn("_had", F.lit(1)).join(news, "pageurlhash", "full_outer")
    return joined.select(
        "pageurlhash", *(F.coalesce(f"_{c}", c).alias(c) for c in names),
        F.when(had, F.coalesce("_image", "mainimage_sha1")).alias("mainimage_sha1"),
        F.when(had, F.coalesce("_ts", "daterefresh")).alias("daterefresh"))


def set_main_image(products: DataFrame, photos: DataFrame, updates: DataFrame,
                   order_by=("ts", "event_id")) -> DataFrame:
    """Set main image and image count of products whose photo is stored, from the last such update of
    each; the others stay as they are."""
    stored = photos.select(F.col("photourlhash").alias("_image"))
    order = [c for c in order_by if c in updates.columns]
    news = updates.select("pageurlhash", F.col("mainimage_sha1").alias("_image"), F.col("imageamount").alias("_amount"), *order)
    news = _last(news.join(stored, "_image", "left_semi"), order_by).drop(*order)
    return products.join(news, "pageurlhash", "left").select(
        *(c for c in products.columns if c not in ("mainimage_sha1", "imageamount")),
        F.coalesce("_image", "mainimage_sha1").alias("mainimage_sha1"),
        F.coalesce("_amount", "imageamount").alias("imageamount"))
