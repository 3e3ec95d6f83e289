"""Per-site extraction rules kept as data."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from weblake.config import PRODUCT_DETAIL, PRODUCT_LIST
from weblake.functions import html as H, selectors, urls as U
from weblake.functions.text import decode_all, first_nonempty, first_quoted, ordered_distinct, trim_space
from weblake.operators import selection, treepass
from weblake.operators.links import canonicalize, filter_links
from weblake.operators.nodes import parse

# Workers get the selectors with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(selectors)
cloudpickle.register_pickle_by_value(selection)

# The per-seed settings that go into the rule table.
RULE_FIELDS = (
    "seller_url", "category", "title_xpath", "detailurl_xpath", "detailurlheader", "nextpage_xpath",
    "nextpageheader", "imagesource", "imageurl_xpath", "imageurlheader", "brand_xpath",
    "description_xpath", "productid_xpath", "color_xpath", "price_xpath", "size_xpath",
    "mainimageurl_xpath",
)
TEXT_FIELDS = {
    "title": "title_xpath", "brand": "brand_xpath", "description": "description_xpath",
    "productid": "productid_xpath", "color": "color_xpath", "price": "price_xpath",
    "size": "size_xpath",
}
#: What :func:`extract_fields` and :func:`extract_list_links` look at.
DETAIL_FIELDS = (*TEXT_FIELDS.values(), "mainimageurl_xpath", "imageurl_xpath")
LIST_FIELDS = ("detailurl_xpath", "nextpage_xpath")


def rules_from_seeds(seeds: DataFrame) -> DataFrame:
    """Wide seed settings → rules(seed_id, field, selector); unset ones are left out."""
    present = [c for c in RULE_FIELDS if c in seeds.columns]
    return (seeds.select(F.col("id").alias("seed_id"), *present)
            .unpivot("seed_id", present, "field", "selector").filter(F.col("selector").isNotNull()))


def selector_problem(selector) -> Column:
    """Why a selector is not understood; null where it is, or where there is none."""
    @F.pandas_udf("string")
    def problem(found: pd.Series) -> pd.Series:
        return pd.Series([selectors.compile_selector(s)[1] if s else None for s in found], dtype="object")

    return problem(selector)


def _checked(rules: DataFrame) -> DataFrame:
    """The selectors among ``rules`` with an error where one is not understood."""
    wanted = rules.filter(F.col("field").endswith("_xpath") & (F.col("selector") != ""))
    return wanted.select("seed_id", "field", "selector", selector_problem("selector").alias("error"))


def rejected_rules(rules: DataFrame) -> DataFrame:
    """Selectors that are not understood, with their seed and the reason."""
    return _checked(rules).filter(F.col("error").isNotNull())


def seed_rules(rules: DataFrame) -> DataFrame:
    """One row per seed: rules map<field, selector>, of the selectors that are understood."""
    return (_checked(rules).filter(F.col("error").isNull()).groupBy("seed_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("field", "selector"))).alias("rules")))


def parse_for_rules(pages: DataFrame, keep, fields: Sequence[str] = (), nodes: bool = True) -> DataFrame:
    """Pages parsed. With ``fields``, whose selectors are in ``rules``, also what these take (``found``, as of
    :func:`selected`), in the same pass; then ``nodes`` may be left out."""
    if not fields:
        return parse(pages, keep)
    fields = list(fields)
    wanted = F.array(*(F.try_element_at("rules", F.lit(f)) for f in fields))
    shredded = pages.select(*keep, wanted.alias("wanted"), H.tokens(F.col("html")).alias("tokens"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in shredded.schema.fields[:-2]]
    schema += [f"nodes {treepass.NODE_DDL}"] * nodes + ["found map<string, array<string>>"]

    def run(batches):
        return selection.page_arrays(batches, fields, nodes)

    return shredded.mapInArrow(run, ", ".join(schema))


def with_rules(items: DataFrame, by_seed: DataFrame) -> DataFrame:
    """Give each item the rules of its seed (from :func:`seed_rules`); without rules all fields are "".

    Join them to frontier items, or to pages before they are parsed: then neither html nor node
    arrays are shuffled by seed, and a seed that owns most pages is a hot key of narrow rows only.
    """
    return items.join(by_seed, "seed_id", "left")


def selected(ruled: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Pages (``nodes``, ``rules``) with ``found`` map<field, array<string>> in their place: what the selector of
    each of ``fields`` takes, in document order.

    A page's elements become number arrays once and all its rules run on them, a step for all its nodes
    at a time. Pages without rules find nothing. Nothing is shuffled. Pages that have ``found`` keep it.
    """
    if "found" in ruled.columns:
        return ruled.drop("nodes", "rules")
    kept = [c for c in ruled.columns if c not in ("nodes", "rules")]
    schema = ", ".join(f"`{c}` {ruled.schema[c].dataType.simpleString()}" for c in kept)
    fields = list(fields)

    def run(batches):
        return selection.found_arrays(batches, fields)

    wanted = F.array(*(F.try_element_at("rules", F.lit(f)) for f in fields))
    cut = F.expr("transform(nodes, n -> named_struct('ord', n.ord, 'elem', n.kind = 'elem', 'parent_no', n.parent_no, 'tag', n.tag, "
                 "'attrs', n.attrs, 'text', case when n.kind = 'text' then n.text end))")
    rows = ruled.select(*(F.col(f"`{c}`") for c in kept), wanted.alias("wanted"), cut.alias("nodes"))
    return rows.mapInArrow(run, ", ".join([*filter(None, [schema]), "found map<string, array<string>>"]))


def matches(field: str) -> Column:
    """What the selector of a field takes from a page (column ``found`` of :func:`selected`), decoded."""
    found = F.expr(f"try_element_at(found, '{field}')")
    return F.coalesce(decode_all(found), F.array().cast("array<string>"))


def clean_main_image(base: Column, values: Column) -> Column:
    """First non-empty value, trimmed, absolute, without one trailing "/": array of at most one."""
    return F.transform(F.transform(first_nonempty(values), trim_space),
                       lambda v: U.strip_slash(U.resolve(base, v)))


def clean_image_list(base: Column, values: Column) -> Column:
    """Quoted part of each value, distinct in order, trimmed, absolute."""
    parts = F.array_distinct(F.transform(ordered_distinct(values), first_quoted))
    return F.transform(F.transform(parts, trim_space), lambda v: U.strip_slash(U.resolve(base, v)))


def extract_fields(ruled: DataFrame) -> DataFrame:
    """Product fields of detail pages (pages with ``nodes`` and ``rules``): a projection, no shuffle."""
    wanted = {**TEXT_FIELDS, "_main": "mainimageurl_xpath", "_images": "imageurl_xpath"}
    kept = [c for c in ruled.columns if c not in ("nodes", "rules", "found")]
    found = selected(ruled, DETAIL_FIELDS).select(*kept, F.explode(F.array(F.struct(*(
        matches(field).alias(name) for name, field in wanted.items())))).alias("m"))
    return found.select(
        *kept,
        *(F.array_join(ordered_distinct(F.col(f"m.{name}")), "").alias(name) for name in TEXT_FIELDS),
        F.size("m.title").alias("title_hits"), F.size("m.price").alias("price_hits"),
        clean_main_image(F.col("url"), ordered_distinct(F.col("m._main"))).alias("main_images"),
        clean_image_list(F.col("url"), F.col("m._images")).alias("image_urls"),
    ).withColumn("mainimageurl", F.array_join("main_images", ""))


def extract_list_links(ruled: DataFrame, deny_extensions=None, deny_hosts=None) -> DataFrame:
    """Links of list pages: detail links (pagetype 31) come before next-list links (pagetype 3)."""
    kept = [c for c in ruled.columns if c not in ("nodes", "rules", "found", "pagetype")]

    def tagged(field, pagetype, priority):
        return F.transform(matches(field), lambda v, i: F.struct(
            F.lit(pagetype).alias("pagetype"), F.lit(priority).alias("priority"),
            i.alias("pos"), v.alias("href")))

    found = F.concat(tagged("detailurl_xpath", PRODUCT_DETAIL, 0), tagged("nextpage_xpath", PRODUCT_LIST, 1))
    picked = selected(ruled, LIST_FIELDS)
    rows = picked.select(*kept, F.explode(found).alias("l")).select(*kept, "l.*")
    lists = {k: v for k, v in (("deny_extensions", deny_extensions), ("deny_hosts", deny_hosts))
             if v is not None}
    return filter_links(canonicalize(rows, blog=False), **lists)
