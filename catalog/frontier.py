"""Frontier, visited set, relations, retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx, query
from weblake.config import HarvestConfig
from weblake.functions.urls import url_sha1
from weblake.operators import frontier as FR, images as I, links as L, relations as RL
from weblake.operators.upsert import insert_ignore
from weblake.session import Work
from weblake.sources.seeds import read_seeds

_FIRST = """first_items as (
 select url, url_sha1, seed_id, depth, ord, attempt, walked from (
  select *, row_number() over (partition by url_sha1 order by ord) as n from fx_items) t where n = 1)"""
_NEW = """new_items as (
 select * from first_items f where not exists (select 1 from fx_visited v where v.url_sha1 = f.url_sha1))"""
_OLD = """old_items as (
 select url, url_sha1, seed_id, depth, ord, attempt from (
  select *, row_number() over (partition by url_sha1 order by ord) as n from fx_items where walked = 1) t where n = 1)"""


def _items(spark, d):
    return fx.fx_items(spark, d)


def _first(items):
    return FR.first_seen(items, ["url_sha1"], ["ord"])


def _new(spark, d):
    return FR.unseen(_first(_items(spark, d)), fx.fx_visited(spark, d)).drop("walked")


def _old(spark, d):
    return _first(_items(spark, d).filter("walked = 1")).drop("walked")


@query("first_seen_url", fx.sql("select url, url_sha1, seed_id, depth, ord from first_items", "fx_items", more=(_FIRST,)))
def first_seen_url(spark, d):
    return _first(_items(spark, d)).drop("attempt", "walked")


@query("url_distinct", fx.sql("select distinct url_sha1, url from fx_items", "fx_items"))
def url_distinct(spark, d):
    return _items(spark, d).select("url_sha1", "url").dropDuplicates(["url_sha1"])


@query("frontier_anti_join", fx.sql("select url, url_sha1, seed_id, depth, ord from new_items", "fx_visited",
                                    more=(_FIRST, _NEW)))
def frontier_anti_join(spark, d):
    return _new(spark, d).drop("attempt")


@query("unseen_links_per_host", fx.sql("""
select regexp_extract(url, '^https?://([^/?#]*)', 1) as host, count(*) as unseen from new_items group by 1""",
    "fx_visited", more=(_FIRST, _NEW)))
def unseen_links_per_host(spark, d):
    hosts = _new(spark, d).select(FR.U.domain(F.col("url")).alias("host"))
    return hosts.groupBy("host").agg(F.count("*").alias("unseen"))


@query("link_scope_join", fx.sql("""
select v.page_id, v.pos, v.link, s.id as seed_id from fx_valid v join fx_seeds s on v.host = s.host
where starts_with(v.link, trim(s.url))""", "fx_valid", "fx_seeds"))
def link_scope_join(spark, d):
    found = L.filter_links(L.canonicalize(fx.fx_links(spark, d))).withColumn("seed_id", fx.seed_id(F.col("host")))
    seeds = fx.fx_seeds(spark, d).select(F.col("id").alias("seed_id"), F.trim("url").alias("seed_url"))
    return L.in_scope(found, seeds).select("page_id", "pos", "link", "seed_id")


@query("depth_limit", fx.sql("select url, depth, ord from fx_items where depth < 4", "fx_items"))
def depth_limit(spark, d):
    return L.below_depth(_items(spark, d), 4).select("url", "depth", "ord")


@query("politeness_schedule", fx.sql("""
select url, regexp_extract(url, '^https?://([^/?#]*)', 1) as host, ord,
 cast((row_number() over (partition by regexp_extract(url, '^https?://([^/?#]*)', 1) order by ord) - 1) * 0.25
  as double) as start_at from first_items""", "fx_items", more=(_FIRST,)))
def politeness_schedule(spark, d):
    queue = Work(spark, "politeness").table("queue", _first(_items(spark, d)).select("url", "ord"))
    return FR.fetch_plan(queue, HarvestConfig.blog().delay_seconds, chunk=F.floor(F.col("ord") / 4096000000))


@query("frontier_take_fifo", fx.sql("select url, ord from first_items order by ord limit 100", "fx_items", more=(_FIRST,)))
def frontier_take_fifo(spark, d):
    return FR.take(_first(_items(spark, d)), 100).select("url", "ord")


@query("frontier_take_lifo", fx.sql("select url, ord from first_items order by ord desc limit 100", "fx_items",
                                    more=(_FIRST,)))
def frontier_take_lifo(spark, d):
    return FR.take(_first(_items(spark, d)), 100, "lifo").select("url", "ord")


@query("frontier_remainder", fx.sql("""
select url, ord from first_items where ord not in (select ord from first_items order by ord limit 100)""",
    "fx_items", more=(_FIRST,)))
def frontier_remainder(spark, d):
    queue = _first(_items(spark, d)).select("url", "ord")
    return FR.remainder(queue, FR.take(queue, 100))


@query("frontier_union", fx.sql("""
select url, url_sha1, seed_id, depth, attempt, ord from old_items union all
select url, url_sha1, seed_id, depth, attempt,
 (select max(ord) from old_items) + 1 + ord - (select min(ord) from new_items) from new_items""",
    "fx_visited", more=(_FIRST, _NEW, _OLD)))
def frontier_union(spark, d):
    stored = Work(spark, "frontier")  # a queue is a table; its ends are read from there
    return FR.enqueue(stored.table("old", _old(spark, d)), stored.table("new", _new(spark, d)))


@query("visited_union", fx.sql("select url_sha1 from fx_visited union select url_sha1 from fx_items where walked = 0",
                               "fx_visited"))
def visited_union(spark, d):
    return FR.visited_union(fx.fx_visited(spark, d), _items(spark, d).filter("walked = 0"))


@query("visited_except", fx.sql("select url_sha1 from fx_items where walked = 0 except select url_sha1 from fx_visited",
                                "fx_visited"))
def visited_except(spark, d):
    return FR.visited_except(_items(spark, d).filter("walked = 0"), fx.fx_visited(spark, d))


@query("retry_requeue", fx.sql("""
select url, url_sha1, seed_id, depth, attempt, ord from old_items union all
select url, url_sha1, seed_id, depth, attempt + 1,
 (select max(ord) from old_items) + 1 + ord - (select min(ord) from failed) from failed""",
    "fx_items", more=(_OLD, """failed as (
 select * from (select url, url_sha1, seed_id, depth, ord, cast(1 + length(url) % 5 as integer) as attempt
 from old_items) t where attempt < 4)""")))
def retry_requeue(spark, d):
    queue = Work(spark, "retry").table("queue", _old(spark, d))
    failed = queue.withColumn("attempt", (F.lit(1) + F.length("url") % 5).cast("int"))
    return FR.requeue(queue, failed, HarvestConfig.blog().max_attempts)


@query("retry_dead_letters", fx.sql("""
select url, url_sha1, seed_id, depth, ord, cast(1 + length(url) % 5 as integer) as attempt
from old_items where 1 + length(url) % 5 >= 4""", "fx_items", more=(_OLD,)))
def retry_dead_letters(spark, d):
    """What :func:`retry_requeue` does not take back."""
    return FR.spent(_old(spark, d).withColumn("attempt", (F.lit(1) + F.length("url") % 5).cast("int")))


@query("seed_refresh", fx.sql("""
select id as seed_id, url, sha1(url) as url_sha1 from fx_seeds s
where deleted = 0 and photosourcetype_id = 2 and sha1(url) not in (
 select sha1(regexp_replace(url, '/[^/]*/[^/]*$', '')) from fx_pages where url like 'http:%')""", "fx_seeds"))
def seed_refresh(spark, d):
    """Seeds of hosts with a page under http were visited before."""
    visited = fx.fx_urls(spark, d).filter("url like 'http:%'").select(
        url_sha1(F.regexp_replace("url", "/[^/]*/[^/]*$", "")).alias("url_sha1")).distinct()
    return FR.unseen(read_seeds(fx.fx_seeds(spark, d)), visited).select("seed_id", "url", "url_sha1")


# Relations: photos of pages under http are stored, pages of the detail kind are stored.

_PAIRS = """pairs as (
 select page_id, sha1(url) as page_sha1, sha1(src) as photo_sha1 from fx_images)"""
_STORED = r"""stored_pages as (select distinct sha1(url) as page_sha1 from fx_images where url not like '%#top'),
stored_photos as (select distinct sha1(src) as photo_sha1 from fx_images where src like 'http:%')"""


def _pairs(spark, d):
    return fx.fx_images(spark, d).select("page_id", "url", "src", url_sha1(F.col("url")).alias("page_sha1"),
                                         url_sha1(F.col("src")).alias("photo_sha1"))


def _stored(spark, d):
    pairs = _pairs(spark, d)
    return (pairs.filter("url not like '%#top'").select("page_sha1"),
            pairs.filter("src like 'http:%'").select("photo_sha1"))


@query("exists_semi_join", fx.sql("""
select page_id, page_sha1, case when page_sha1 in (select page_sha1 from stored_pages) then 1 else 0 end as found
from pairs""", "fx_images", more=(_PAIRS, _STORED)))
def exists_semi_join(spark, d):
    return RL.exists_flag(_pairs(spark, d).select("page_id", "page_sha1"), _stored(spark, d)[0], "page_sha1")


_LINKED = """select page_id, page_sha1, photo_sha1, case when page_sha1 in (select page_sha1 from stored_pages)
 and photo_sha1 in (select photo_sha1 from stored_photos) then 1 else 0 end as {} from {}"""


@query("relation_by_hash", fx.sql(_LINKED.format("linked", "pairs"), "fx_images", more=(_PAIRS, _STORED)))
def relation_by_hash(spark, d):
    return RL.link_by_hash(_pairs(spark, d).drop("url", "src"), *_stored(spark, d))


@query("relation_exists", fx.sql(_LINKED.format("found", "pairs"), "fx_images", more=(_PAIRS, _STORED)))
def relation_exists(spark, d):
    pairs = _pairs(spark, d).drop("url", "src")
    return RL.relation_exists(pairs, pairs, *_stored(spark, d))


@query("relation_from_json", fx.sql("""
select page_id, case when ok then sha1(image) end as photo_sha1, case when ok then sha1(page) end as page_sha1,
 case when ok then 0 else 1 end as rejected, case when ok and sha1(page) in (select page_sha1 from stored_pages)
 and sha1(image) in (select photo_sha1 from stored_photos) then 1 else 0 end as linked
from (select page_id, pair_json->>0 as image, regexp_replace(pair_json->>1, '/$', '') as page,
 coalesce(pair_json->>1, '') <> '' as ok from (select page_id, cast(pair_json as json) as pair_json from fx_pairs) j) t""",
    "fx_images", "fx_pairs", more=(_STORED,)))
def relation_from_json(spark, d):
    return RL.link_by_hash(RL.pairs_from_json(fx.fx_pairs(spark, d)), *_stored(spark, d))


@query("relation_new_pairs", fx.sql("""
select distinct page_sha1, photo_sha1 from pairs p where page_sha1 not in (select page_sha1 from stored_pages)""",
    "fx_images", more=(_PAIRS, _STORED)))
def relation_new_pairs(spark, d):
    pairs = _pairs(spark, d)
    return insert_ignore(pairs.filter("url not like '%#top'"), pairs, ["page_sha1", "photo_sha1"])


@query("product_main_image", fx.sql("""
select coalesce(p.page_sha1, u.page_sha1) as pageurlhash, coalesce(u.title, p.title) as title,
 coalesce(u.price, p.price) as price, coalesce(u.size, p.size) as size,
 coalesce(u.productid, p.productid) as productid, coalesce(u.pagetext, p.pagetext) as pagetext,
 case when p.page_sha1 is not null then case when u.photo_sha1 in (select photo_sha1 from stored_photos)
  then u.photo_sha1 end end as mainimage_sha1,
 cast(case when p.page_sha1 is not null then u.at end as varchar) as daterefresh
from (select sha1(url) as page_sha1, 'old' as title, '1' as price, 's' as size, url as productid, 'text' as pagetext
  from fx_images where url not like '%#top') p
full outer join (select sha1(url) as page_sha1, sha1(src) as photo_sha1, 'new' as title, cast(width as varchar) as price,
  cast(height as varchar) as size, url as productid, 'news' as pagetext, page_id as at from fx_images
  where url not like '%/') u on p.page_sha1 = u.page_sha1""", "fx_images", more=(_STORED,)))
def product_main_image(spark, d):
    sizes = fx.fx_images(spark, d)
    key = url_sha1(F.col("url")).alias("pageurlhash")
    products = sizes.filter("url not like '%#top'").select(
        key, F.lit("old").alias("title"), F.lit("1").alias("price"), F.lit("s").alias("size"),
        F.col("url").alias("productid"), F.lit("text").alias("pagetext"),
        F.lit(None).cast("string").alias("mainimage_sha1"), F.lit(None).cast("bigint").alias("daterefresh"))
    updates = sizes.filter("url not like '%/'").select(
        key, F.lit("new").alias("title"), F.col("width").cast("string").alias("price"),
        F.col("height").cast("string").alias("size"), F.col("url").alias("productid"), F.lit("news").alias("pagetext"),
        url_sha1(F.col("src")).alias("mainimage_sha1"), F.col("page_id").alias("ts"))
    photos = _stored(spark, d)[1].select(F.col("photo_sha1").alias("photourlhash"))
    enriched = RL.enrich_main_image(products, photos, updates)
    return enriched.withColumn("daterefresh", F.col("daterefresh").cast("string"))


@query("product_main_image_simple", fx.sql("""
select sha1(url) as pageurlhash, case when src like 'http:%' then sha1(src) end as mainimage_sha1,
 case when src like 'http:%' then width else -1 end as imageamount from fx_images""", "fx_images"))
def product_main_image_simple(spark, d):
    sizes = fx.fx_images(spark, d)
    key = url_sha1(F.col("url")).alias("pageurlhash")
    products = sizes.select(key, F.lit(None).cast("string").alias("mainimage_sha1"),
                            F.lit(-1).cast("bigint").alias("imageamount"))
    updates = sizes.select(key, url_sha1(F.col("src")).alias("mainimage_sha1"), F.col("width").alias("imageamount"))
    photos = _stored(spark, d)[1].select(F.col("photo_sha1").alias("photourlhash")).distinct()
    return RL.set_main_image(products, photos, updates)


# Image attempts: one log row per event, images named after users; purchases are the successes.

_ATTEMPTS = """numbered as (
 select sha1(url) as photo_sha1, event_type = 'purchase' as ok,
  row_number() over (partition by url order by ts, event_id) as n from fx_fetch_log),
outcomes as (
 select photo_sha1, cast(coalesce(min(case when ok then n end), max(n)) as integer) as attempts,
  case when bool_or(ok) then 'stored' when max(n) >= 4 then 'dead' else 'pending' end as status
 from numbered where n <= 4 group by photo_sha1)"""


def _outcomes(spark, d):
    log = fx.fx_fetch_log(spark, d).select(url_sha1(F.col("url")).alias("photo_sha1"), "ts", "event_id",
                                           (F.col("event_type") == "purchase").alias("ok"))
    return I.retry_budget(log)


@query("image_retry_budget", fx.sql("select photo_sha1, attempts, status from outcomes", "fx_fetch_log", more=(_ATTEMPTS,)))
def image_retry_budget(spark, d):
    return _outcomes(spark, d)


@query("image_dead_letter", fx.sql("select photo_sha1, attempts from outcomes where status = 'dead'", "fx_fetch_log",
                                   more=(_ATTEMPTS,)))
def image_dead_letter(spark, d):
    return I.dead_letter(_outcomes(spark, d))
