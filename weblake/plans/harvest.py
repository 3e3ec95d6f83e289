"""From a crawl to the page, product, photo and relation tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weblake.config import BLOG, PRODUCT, PRODUCT_DETAIL
from weblake.functions.text import decode_entities, erase_marks
from weblake.functions.urls import url_sha1
from weblake.operators import images as I
from weblake.operators.links import detail_outcome, page_kind
from weblake.operators.nodes import page_text, parse
from weblake.operators.rules import DETAIL_FIELDS, extract_fields, parse_for_rules, with_rules
from weblake.operators.upsert import BLOG_PAGE, BLOG_PHOTO, PRODUCT_PAGE, PRODUCT_PHOTO, insert_ignore, upsert
from weblake.plans.expand import fetched_at, page_key
from weblake.sources.buckets import BucketStore, Change

#: Order in which a harvest at time ``ts`` brings its rows: as the crawl met their pages.
_ORDER = ("ts", "level", "ord", "page_id")
MERGES = {
    "blog": {"blogpage": replace(BLOG_PAGE, order_by=_ORDER),
             "photocache": replace(BLOG_PHOTO, order_by=(*_ORDER, "node_no"))},
    "product": {"productpage": replace(PRODUCT_PAGE, order_by=_ORDER),
                "photocache": replace(PRODUCT_PHOTO, order_by=_ORDER)},
}


def _fetched(crawl: DataFrame, pages: DataFrame, blog: bool, columns) -> DataFrame:
    # The test of the URL, which no item fails, lets Spark send a Bloom filter of the keys to the page scan.
    keyed = crawl.filter(F.col("url") != "").select(page_key(F.col("url"), blog).alias("page_key"), *columns)
    return pages.withColumn("page_key", page_key(F.col("url"), blog)).join(keyed, "page_key").drop("page_key")


def _items(crawl: DataFrame) -> DataFrame:
    """The crawl with each item's URL and key as those of its page row: the stored page's may differ by a "/"."""
    return crawl.withColumn("pageurl", F.col("url")).withColumn("pageurlhash", F.col("url_sha1"))


def first_title(nodes: Column) -> Column:
    found = F.filter(nodes, lambda n: (n["kind"] == "text") & (n["tag"] == "title"))
    return F.coalesce(decode_entities(F.get(F.transform(found, lambda n: n["text"]), F.lit(0))), F.lit(""))


def blog_pages(crawl: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per reached page: page columns plus its dates and images, in one pass over the html.

    Write it before building several tables from it.
    """
    kept = ("seed_id", "level", "ord", "pageurl", "pageurlhash")
    parsed = parse(_fetched(_items(crawl), pages, True, kept), ("page_id", "url", *kept))
    texts = page_kind(page_text(parsed))
    return texts.select(
        "page_id", "url", *kept, "detailed",
        erase_marks(first_title(F.col("nodes"))).alias("title"), erase_marks(F.col("pagetext")).alias("pagetext"),
        I.dates_of(F.col("nodes")).alias("dates"), I.images_of(F.col("nodes")).alias("images"))


def blog_tables(extracted: DataFrame, sizes: DataFrame | None = None, mode: str = "first",
                at: Column | None = None) -> dict[str, DataFrame]:
    """The four blog tables as input of :func:`merged`, for a harvest at time ``at`` (now, if not given).

    ``sizes(photo_sha1, width, height)`` switches the gate on.
    """
    at = (F.lit(datetime.now(timezone.utc)) if at is None else at).alias("ts")  # one time for all tables, however often they are written
    dated = I.dated_images(extracted, F.col("images"), F.col("dates"), ("page_id", "url", "pageurlhash", "level", "ord"))
    photos = I.first_page_of_image(dated, ["level", "ord", "page_id", "node_no"], mode)  # in crawl order
    if sizes is not None:
        photos = I.image_gate(photos.join(sizes, "photo_sha1"))
    return {
        "blogpage": extracted.select("pageurlhash", "pageurl", "title", "pagetext", "detailed", at, "level", "ord", "page_id"),
        "blogpageseedrelation": extracted.select(F.col("pageurlhash").alias("page_sha1"), "seed_id").distinct(),
        "photocache": photos.select(
            F.col("photo_sha1").alias("photourlhash"), F.col("src").alias("photourl"),
            erase_marks(F.col("alt")).alias("title"), F.col("postdate").alias("datepost"),
            F.lit(BLOG).alias("photosourcetype_id"), at, "level", "ord", "page_id", "node_no"),
        "blogphotopagerelation": photos.select(F.col("pageurlhash").alias("page_sha1"), "photo_sha1").distinct(),
    }


def product_pages(crawl: DataFrame, pages: DataFrame, by_seed: DataFrame, at: str | None = None) -> DataFrame:
    """One row per reached detail page with its fields and outcome (store, retry, drop).

    With ``at``, the column of ``pages`` that says when a page was fetched, ``by_seed`` is a history (of
    ``rule_history``) and each page is read by the rules in force then.
    """
    kept = ("seed_id", "depth", "category", "category_1", "level", "ord", "pageurl", "pageurlhash")
    details = _items(crawl).filter(F.col("pagetype") == PRODUCT_DETAIL)
    fetched = _fetched_ruled(details, pages, by_seed, at, kept)
    return product_fields(parse_for_rules(fetched, ("page_id", "url", *kept), DETAIL_FIELDS), kept)


def _fetched_ruled(items: DataFrame, pages: DataFrame, by_seed: DataFrame, at: str | None, kept) -> DataFrame:
    if at is None:
        return _fetched(with_rules(items, by_seed), pages, False, (*kept, "rules"))
    return fetched_at(items.select("url", *kept), pages, by_seed, at)


def product_fields(parsed: DataFrame, kept) -> DataFrame:
    """Fields and outcome of detail pages (parsed, with ``rules`` or ``found``), beside page_id, url and the ``kept`` columns."""
    fields = extract_fields(page_text(parsed, squeeze=False))
    # The outcome looks at how many matches a rule had, not at the joined text.
    hits = F.array_repeat(F.lit(1), F.col("title_hits")), F.array_repeat(F.lit(1), F.col("price_hits"))
    cleaned = ("title", "brand", "description", "price", "color", "size", "pagetext")
    return fields.select(
        "page_id", "url", *kept,
        *(erase_marks(F.col(c)).alias(c) for c in cleaned), "productid", "mainimageurl", "image_urls",
        detail_outcome(F.col("main_images"), *hits).alias("outcome"))


def _retry(items: DataFrame) -> DataFrame:
    return items.select(F.col("pageurl").alias("url"), F.col("pageurlhash").alias("url_sha1"), "seed_id", "depth", "pagetype",
                        "category", "category_1", "ord", F.lit(1).alias("attempt"))


def not_stored(crawl: DataFrame, pages: DataFrame, blog: bool) -> DataFrame:
    """Items that the crawl reached but whose page is not there, lists too, ready for ``requeue``."""
    keys = pages.select(page_key(F.col("url"), blog).alias("_key"))
    missing = _items(crawl).withColumn("_key", page_key(F.col("url"), blog)).join(keys, "_key", "left_anti")
    return _retry(missing)


def product_tables(extracted: DataFrame, at: Column | None = None) -> dict[str, DataFrame]:
    """Product tables as input of :func:`merged`, for a harvest at time ``at`` (now, if not given), and
    the items to retry, ready for ``requeue``."""
    at = (F.lit(datetime.now(timezone.utc)) if at is None else at).alias("ts")  # one time for all tables, however often they are written
    order = (at, "level", "ord", "page_id")
    stored = extracted.filter(F.col("outcome") == "store")
    photo = url_sha1(F.col("mainimageurl"))
    return {
        "productpage": stored.select(
            "pageurlhash", "pageurl", "title", "brand", "description", "price", "color", "size",
            "productid", "pagetext", F.lit(-1).alias("imageamount"), "category", "category_1", *order),
        "productpageseedrelation": stored.select(F.col("pageurlhash").alias("page_sha1"), "seed_id").distinct(),
        "photocache": stored.select(
            photo.alias("photourlhash"), F.col("mainimageurl").alias("photourl"), "pageurl",
            F.lit(PRODUCT).alias("photosourcetype_id"), at.alias("datepost"), *order),
        "productphotopagerelation": stored.select(
            F.col("pageurlhash").alias("page_sha1"), photo.alias("photo_sha1")).distinct(),
        "retry": _retry(extracted.filter(F.col("outcome") == "retry").withColumn("pagetype", F.lit(PRODUCT_DETAIL))),
    }


def merged(stored: dict[str, DataFrame], tables: dict[str, DataFrame], kind: str) -> dict[str, DataFrame]:
    """The stored tables after a harvest: pages and photos by keyed upsert, relations by insert-ignore.

    ``stored`` may lack tables, as before the first harvest. What is no table of the store (retry) is left out.
    """
    out = {}
    for name, df in tables.items():
        old = stored.get(name)
        if name in MERGES[kind]:
            out[name] = upsert(old, df, MERGES[kind][name])
        elif name.endswith("relation"):
            new = insert_ignore(df.limit(0) if old is None else old, df, df.columns)
            out[name] = new if old is None else old.select(*df.columns).unionByName(new)
    return out


def changes(tables: dict[str, DataFrame], kind: str) -> dict[str, Change]:
    """What a harvest changes in a :class:`BucketStore`: pages and photos by their key, relations by their page."""
    out = {}
    for name, df in tables.items():
        if name in MERGES[kind]:
            merge = MERGES[kind][name]
            out[name] = Change(df, [merge.key], lambda old, new, merge=merge: upsert(old, new, merge))
        elif name.endswith("relation"):
            out[name] = Change(df, df.columns[:1], lambda old, new: insert_ignore(new.limit(0) if old is None else old, new, new.columns),
                               appends=True)
    return out


def store_harvest(spark: SparkSession, root: str, tables: dict[str, DataFrame], kind: str, buckets: int = 64) -> dict[str, DataFrame]:
    """Merge a harvest into the latest version below ``root``; the next one is returned.

    Only the buckets that the harvest's keys fall into are read and written, and relations only grow, so
    a harvest costs what it changes.
    """
    store = BucketStore(spark, root, buckets)
    store.merge(changes(tables, kind))
    return store.tables()
