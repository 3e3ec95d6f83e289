"""Seeds, rules, pages, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx, query
from weblake.config import HarvestConfig
from weblake.functions.text import erase_marks
from weblake.functions.urls import add_www, domain, url_sha1
from weblake.operators import images as I, upsert as UP
from weblake.operators.frontier import first_seen, status
from weblake.operators.rules import rejected_rules, rules_from_seeds
from weblake.session import Work
from weblake.sources.pages import read_pages
from weblake.sources.seeds import read_seeds
from weblake.sources.state import load_state


@query("seed_source_blog", fx.sql("""
select id as seed_id, url, url as seed_url, sha1(url) as url_sha1, 1 as depth, photosourcetype_id as pagetype
from fx_seeds where deleted = 0 and photosourcetype_id = 2""", "fx_seeds"))
def seed_source_blog(spark, d):
    return read_seeds(fx.fx_seeds(spark, d), "blog").drop("category", "category_1")


@query("seed_source_product", fx.sql("""
select id as seed_id, url, regexp_replace(url, '[ \\t\\n\\f\\r]', '', 'g') as seed_url,
 sha1(regexp_replace(url, '[ \\t\\n\\f\\r]', '', 'g')) as url_sha1, 1 as depth, photosourcetype_id as pagetype,
 category, category_1
from fx_seeds where deleted = 0 and photosourcetype_id = 3 and webkit = 0 and url <> '' and id is not null""",
    "fx_seeds"))
def seed_source_product(spark, d):
    return read_seeds(fx.fx_seeds(spark, d), "product")


@query("seed_rules_unpivot", fx.sql("""
select seed_id, field, selector from (
 select id as seed_id, unnest(['category', 'title_xpath', 'detailurl_xpath', 'nextpage_xpath', 'imageurl_xpath',
   'brand_xpath', 'description_xpath', 'color_xpath', 'price_xpath', 'mainimageurl_xpath']) as field,
  unnest([category, title_xpath, detailurl_xpath, nextpage_xpath, imageurl_xpath, brand_xpath,
   description_xpath, color_xpath, price_xpath, mainimageurl_xpath]) as selector from fx_seeds) r
where selector is not null""", "fx_seeds"))
def seed_rules_unpivot(spark, d):
    return rules_from_seeds(fx.fx_seeds(spark, d))


_ODD_RULES = """case when length(host) % 2 = 0 then '//div[lang("de")]/p/text()' else '//title' end"""


@query("rules_rejected", fx.sql(f"""
select id as seed_id, unnest(['title_xpath', 'price_xpath']) as field,
 unnest([{_ODD_RULES}, '//b/following::i/text()']) as selector
from fx_seeds""", "fx_seeds"))
def rules_rejected(spark, d):
    """Selectors outside the supported subset, per seed."""
    seeds = fx.fx_seeds(spark, d).withColumn("title_xpath", F.expr(_ODD_RULES)).withColumn(
        "price_xpath", F.lit("//b/following::i/text()"))
    return rejected_rules(rules_from_seeds(seeds)).select("seed_id", "field", "selector")


@query("url_add_www", r"""
select page_id, case when starts_with(url, 'http://www') or starts_with(url, 'https://www') or starts_with(url, 'wwww') then url
 else regexp_replace(url, '^(.*?)//', '\1//www.') end as url from pages""")
def url_add_www(spark, d):
    return fx.table(spark, d, "pages").select("page_id", add_www(F.col("url")).alias("url"))


@query("page_source", "select page_id, url, html from pages where html is not null and html <> ''")
def page_source(spark, d):
    return read_pages(spark, f"{d}/pages.parquet")


# Columns of a product page that the log does not have, the same text for both engines.
_MORE = {"description": "concat('about ', title)", "color": "concat('c', cast(event_id % 5 as string))",
         "size": "case when event_id % 3 > 0 then cast(event_id % 7 as string) end",
         "productid": "concat('p', cast(event_id as string))", "imageamount": "cast(event_id % 4 as int)"}

# The log of views is the stored table, all other successful fetches are the updates.

def _updates(spark, d, stored):
    log = fx.fx_fetch_log(spark, d).filter("failed = 0")
    log = log.filter("event_type = 'view'") if stored else log.filter("event_type <> 'view'")
    return log.select(
        "event_id", "ts", F.col("url").alias("pageurl"), url_sha1(F.col("url")).alias("pageurlhash"),
        erase_marks(F.col("title")).alias("title"), F.col("pagetext"), "price",
        F.col("event_type").alias("brand"), F.lit(1).alias("detailed"), *(F.expr(sql).alias(name) for name, sql in _MORE.items()))


_MARKS = "translate({}, '`~!@#$%^&*()_+-={{[}}]|:;''\"<,>./\\•', '" + " " * 32 + "')"
_LOG = f"""log as (
 select event_id, ts, url as pageurl, sha1(url) as pageurlhash, {_MARKS.format('title')} as title, pagetext, price,
  event_type as brand, 1 as detailed, {', '.join(f'{sql} as {name}' for name, sql in _MORE.items())},
  row_number() over (partition by url order by case when event_type = 'view' then 0 else 1 end, ts, event_id) as n_all,
  row_number() over (partition by url order by case when event_type = 'view' then 0 else 1 end desc, ts desc,
   event_id desc) as n_back,
  row_number() over (partition by url order by ts, event_id) as n,
  row_number() over (partition by url order by ts desc, event_id desc) as n_rev,
  count(*) over (partition by url) as writes
 from fx_fetch_log where failed = 0)"""
_UPSERTED = """select f.pageurlhash, f.pageurl, {first} l.title, l.pagetext, cast(f.ts as varchar) as dateinsert,
 cast(case when f.writes > 1 then l.ts end as varchar) as daterefresh
from log f join log l on f.pageurlhash = l.pageurlhash where f.n_all = 1 and l.n_back = 1"""


def _as_text(df):
    return df.withColumn("dateinsert", F.col("dateinsert").cast("string")).withColumn(
        "daterefresh", F.col("daterefresh").cast("string"))


@query("blog_upsert", fx.sql(_UPSERTED.format(first="f.detailed,"), "fx_fetch_log", more=(_LOG,)))
def blog_upsert(spark, d):
    target = UP.upsert(None, _updates(spark, d, True), UP.BLOG_PAGE)
    return _as_text(UP.upsert(target, _updates(spark, d, False), UP.BLOG_PAGE))


@query("product_upsert", fx.sql(_UPSERTED.format(first="".join(f"f.{c}, " for c in ("brand", "price", *_MORE))),
                               "fx_fetch_log", more=(_LOG,)))
def product_upsert(spark, d):
    target = UP.upsert(None, _updates(spark, d, True), UP.PRODUCT_PAGE)
    return _as_text(UP.upsert(target, _updates(spark, d, False), UP.PRODUCT_PAGE))


@query("first_last_merge", fx.sql(_UPSERTED.format(first="f.price,").replace("n_all", "n").replace("n_back", "n_rev"),
                                  "fx_fetch_log", more=(_LOG,)))
def first_last_merge(spark, d):
    log = fx.fx_fetch_log(spark, d).filter("failed = 0").select(
        "event_id", "ts", F.col("url").alias("pageurl"), url_sha1(F.col("url")).alias("pageurlhash"),
        erase_marks(F.col("title")).alias("title"), "pagetext", "price")
    return _as_text(UP.upsert(None, log, UP.Merge("pageurlhash", ("pageurl", "price"), ("title", "pagetext"))))


def _photos(spark, d, stored):
    sizes = fx.fx_images(spark, d)
    sizes = sizes.filter("url like 'https:%'") if stored else sizes.filter("url not like 'https:%'")
    return sizes.select(
        url_sha1(F.col("src")).alias("photourlhash"), F.col("src").alias("photourl"), F.col("url").alias("pageurl"),
        F.concat(F.lit("pic "), F.col("page_id").cast("string")).alias("title"),
        F.concat(F.lit("2012-03-"), F.lpad((F.lit(1) + F.col("page_id") % 28).cast("string"), 2, "0")).alias("datepost"),
        F.lit(2).alias("photosourcetype_id"), "page_id", F.col("page_id").alias("ts"))


_PHOTOS = """photos as (
 select sha1(src) as photourlhash, src as photourl, url as pageurl, concat('pic ', cast(page_id as varchar)) as title,
  concat('2012-03-', lpad(cast(1 + page_id % 28 as varchar), 2, '0')) as datepost, 2 as photosourcetype_id,
  row_number() over (partition by src order by case when url like 'https:%' then 0 else 1 end, page_id) as n,
  row_number() over (partition by src order by case when url like 'https:%' then 0 else 1 end desc, page_id desc) as n_back
 from fx_images)"""


@query("photo_upsert_blog", fx.sql("""select f.photourlhash, f.photourl, f.datepost, f.photosourcetype_id, l.title
from photos f join photos l on f.photourlhash = l.photourlhash where f.n = 1 and l.n_back = 1""",
    "fx_images", more=(_PHOTOS,)))
def photo_upsert_blog(spark, d):
    merge = UP.Merge("photourlhash", UP.BLOG_PHOTO.keep_first, UP.BLOG_PHOTO.keep_last, "ts", ("page_id",), None, None)
    target = UP.upsert(None, _photos(spark, d, True), merge)
    return UP.upsert(target, _photos(spark, d, False), merge)


@query("photo_upsert_product", fx.sql("""select f.photourlhash, f.photourl, f.pageurl, f.photosourcetype_id, l.datepost
from photos f join photos l on f.photourlhash = l.photourlhash where f.n = 1 and l.n_back = 1""",
    "fx_images", more=(_PHOTOS,)))
def photo_upsert_product(spark, d):
    merge = UP.Merge("photourlhash", UP.PRODUCT_PHOTO.keep_first, UP.PRODUCT_PHOTO.keep_last, "ts", ("page_id",),
                     None, None)
    target = UP.upsert(None, _photos(spark, d, True), merge)
    return UP.upsert(target, _photos(spark, d, False), merge)


@query("relation_insert_ignore", fx.sql("""
select distinct sha1(url) as page_sha1, seed_id from fx_items
where walked = 0 and seed_id <> 0 and not exists (
 select 1 from fx_items o where o.walked = 1 and o.url = fx_items.url and o.seed_id = fx_items.seed_id)""",
    "fx_items"))
def relation_insert_ignore(spark, d):
    pairs = fx.fx_items(spark, d).select(F.col("url_sha1").alias("page_sha1"), "seed_id", "walked")
    return UP.insert_ignore(pairs.filter("walked = 1"), pairs.filter("walked = 0"), ["page_sha1", "seed_id"])


@query("image_shard_layout", fx.sql("""
select page_id, sha1(src) as photo_sha1, substr(sha1(src), 1, 3) as shard,
 substr(sha1(src), 1, 3) || '/' || sha1(src) || '.jpg' as path from fx_images""", "fx_images"))
def image_shard_layout(spark, d):
    keyed = fx.fx_images(spark, d).select("page_id", url_sha1(F.col("src")).alias("photo_sha1"))
    return I.store_layout(keyed)


@query("state_reset_levels", fx.sql("""
select level, cast(case when level >= 1 then 0 else f end as bigint) as frontier_rows,
 cast(case when level >= 2 then 0 else v end as bigint) as visited_rows,
 cast(case when level >= 3 then 0 else i end as bigint) as image_rows
from (select unnest([0, 1, 2, 3]) as level) l,
 (select count(distinct url_sha1) as f from fx_items) a, (select count(*) as v from fx_visited) b,
 (select count(distinct src) as i from fx_images) c""", "fx_visited", "fx_images"))
def state_reset_levels(spark, d):
    items = fx.fx_items(spark, d)
    tables = {
        "frontier": first_seen(items, ["url_sha1"], ["ord"]).select("url_sha1"),
        "visited": fx.fx_visited(spark, d),
        "images": fx.fx_images(spark, d).select(url_sha1(F.col("src")).alias("url_sha1")).distinct(),
    }
    stored = Work(spark, "state")
    tables = {name: stored.table(name, df) for name, df in tables.items()}
    counts = None
    for level in range(4):
        for name, df in load_state(tables, HarvestConfig(init_level=level)).items():
            n = df.agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), F.lit(name).alias("name"), "n")
            counts = n if counts is None else counts.unionByName(n)
    return counts.groupBy("level").agg(*(F.sum(F.when(F.col("name") == name, F.col("n")).otherwise(0)).alias(f"{out}_rows")
                                         for name, out in (("frontier", "frontier"), ("visited", "visited"), ("images", "image"))))


@query("harvest_status", fx.sql("""
select 'seeds' as metric, -1 as seed_id, count(*) as n from fx_seeds
where deleted = 0 and photosourcetype_id = 2
union all select 'queued', seed_id, count(*) from fx_items group by seed_id
union all select 'visited', -1, count(*) from fx_visited""", "fx_seeds", "fx_visited"))
def harvest_status(spark, d):
    counts = status(read_seeds(fx.fx_seeds(spark, d), "blog"), fx.fx_items(spark, d), fx.fx_visited(spark, d))
    return counts.fillna(-1, "seed_id")


@query("host_pages", fx.sql("""
select host, count(*) as pages, count(distinct url) as urls from fx_pages group by host""", "fx_pages"))
def host_pages(spark, d):
    urls = fx.fx_urls(spark, d).select(domain(F.col("url")).alias("host"), "url")
    return urls.groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct("url").alias("urls"))
