"""Links: extraction, canonical form, validity, scope, page kind, depth, routing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from weblake.config import (DENY_EXTENSIONS, DENY_HOSTS, LISTING_DATE, LISTING_MARKS, LISTING_MONTHS,
                            PRODUCT_DETAIL, PRODUCT_LIST)
from weblake.functions import html as H, urls as U


def hrefs(html: Column) -> Column:
    """All a/@href values in document order."""
    return F.filter(H.attributes(H.start_tags(html, "a"), "href"), lambda v: v.isNotNull())


def links(pages: DataFrame, keep=("page_id", "url")) -> DataFrame:
    """One row per a/@href: the kept columns, pos, href. Only the kept columns travel with it."""
    return pages.select(*keep, F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))


def canonical(base: Column, ref: Column, blog: bool = True) -> Column:
    """Absolute form of a link. Blog: "http://" links stay as written, one trailing "/" is dropped."""
    resolved = U.resolve(base, ref)
    if blog:
        resolved = U.strip_slash(F.when(ref.startswith("http://"), ref).otherwise(resolved))
    return F.when(ref != "", resolved)


def canonicalize(df: DataFrame, base: str = "url", ref: str = "href", out: str = "link",
                 blog: bool = True) -> DataFrame:
    """Add the absolute form of a link.

    A one-element explode computes it once per row: as a plain projection, predicate pushdown would
    copy the whole expression into each later filter.
    """
    return df.select("*", F.explode(F.array(canonical(F.col(base), F.col(ref), blog))).alias(out))


def valid_link(link: Column, deny_extensions=DENY_EXTENSIONS, deny_hosts=DENY_HOSTS) -> Column:
    """True for a link to follow: no fragment, no script or mail link, no denied part."""
    denied = "|".join(re.escape(part) for part in (*deny_extensions, *deny_hosts))
    bad = r"^$|#[0-9a-zA-Z_-]*$|^javascript:|^mailto:" + (f"|{denied}" if denied else "")
    return ~link.rlike(bad)


def filter_links(df: DataFrame, link: str = "link", deny_extensions=DENY_EXTENSIONS,
                 deny_hosts=DENY_HOSTS) -> DataFrame:
    return df.filter(valid_link(F.col(link), deny_extensions, deny_hosts))


def scope_test(link: Column, seed_url: Column, scope: str = "prefix") -> Column:
    if scope == "prefix":
        return link.startswith(seed_url)
    if scope == "host":
        return U.domain(link) == U.domain(seed_url)
    return F.lit(True)


def in_scope(df: DataFrame, seeds: DataFrame, scope: str = "prefix") -> DataFrame:
    """Keep links that start with the URL of their seed; links of an unknown seed are dropped.

    ``seeds(seed_id, seed_url)`` has one row per seed. A seed that owns most links is a hot join
    key: without broadcast AQE splits its partition.
    """
    return (df.join(seeds.select("seed_id", "seed_url"), "seed_id")
            .filter(scope_test(F.col("link"), F.col("seed_url"), scope)))


def listing_pattern() -> str:
    marks = "|".join(re.escape(mark) for mark in LISTING_MARKS)
    return rf"{marks}|(?:{'|'.join(LISTING_MONTHS)})/?$|{LISTING_DATE}"


def page_kind(df: DataFrame, url: str = "url", pattern: str | None = None) -> DataFrame:
    """detailed = 0 for archive and listing URLs, else 1."""
    return df.withColumn("detailed", F.when(F.col(url).rlike(pattern or listing_pattern()), 0).otherwise(1))


def below_depth(df: DataFrame, limit: int | None) -> DataFrame:
    """Pages whose links may still be followed."""
    return df if limit is None else df.filter(F.col("depth") < limit)


def route(df: DataFrame) -> DataFrame:
    """route = list, detail or ignore by pagetype."""
    return df.withColumn("route", F.when(F.col("pagetype") == PRODUCT_LIST, "list")
                         .when(F.col("pagetype") == PRODUCT_DETAIL, "detail").otherwise("ignore"))


def detail_outcome(main_images: Column, titles: Column, prices: Column) -> Column:
    """store when a main image matched; retry when title and price matched without one; else drop."""
    return (F.when(F.size(main_images) > 0, "store")
             .when((F.size(titles) > 0) & (F.size(prices) > 0), "retry").otherwise("drop"))


def link_counts(df: DataFrame) -> DataFrame:
    """Detail and list links found per page."""
    return df.groupBy("page_id").agg(
        F.count_if(F.col("pagetype") == PRODUCT_DETAIL).alias("detail_links"),
        F.count_if(F.col("pagetype") == PRODUCT_LIST).alias("list_links"))
