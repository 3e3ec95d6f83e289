"""Whole harvests and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx, query
from catalog.frontier import _FIRST
from catalog.pages import _FIELDS, _LISTING
from catalog.sources_sinks import _LOG, _MARKS, _UPSERTED
from weblake.config import HarvestConfig
from weblake.functions.text import erase_marks
from weblake.functions.urls import url_sha1
from weblake.operators.frontier import first_seen
from weblake.operators.rule_history import rule_history
from weblake.operators.rules import rules_from_seeds, seed_rules
from weblake.operators.upsert import Merge
from weblake.plans.expand import blog_edges, expand, reach
from weblake.plans.harvest import blog_pages, blog_tables, product_pages, product_tables, store_harvest
from weblake.session import work_dir
from weblake.sources.seeds import read_seeds
from weblake.streaming import streams as ST


@query("bfs_frontier", fx.sql("""
select page_id, min(depth) as depth from (
 with recursive f(page_id, depth) as (
  select page_id, 1 from fx_ranked where rk = 1
  union select e.dst, f.depth + 1 from f join fx_edges e on f.page_id = e.src
  where f.depth <= (select max(rk) from fx_ranked))
 select * from f) t group by page_id""", "fx_edges"))
def bfs_frontier(spark, d):
    edges = fx.fx_edges(spark, d)
    starts = fx.fx_urls(spark, d).groupBy("host").agg(F.min("page_id").alias("node")).select("node")
    return reach(spark, starts, edges.select("src", "dst"), None, work_dir(spark, "bfs")).withColumnRenamed("node", "page_id")


# Walkable pages: each page also links to its neighbours in the page graph, marked as item or next list.

_ITEM = "dst_url like '%.html' or dst_url like '%?%'"
_TAG = f"""concat('<li class="', case when {_ITEM} then 'item' else 'next' end, '"><a href="',
 regexp_replace(dst_url, '#top$', ''), '">n</a></li>')"""


def fx_linked(spark, d):
    tags = fx.fx_edges(spark, d).selectExpr("src as page_id", "dst_url", f"{_TAG} as tag").groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst_url", "tag"))), lambda t: t["tag"]), "").alias("tags"))
    pages = fx.fx_web(spark, d).join(tags, "page_id", "left")
    return pages.select("page_id", F.regexp_replace("url", "#top$", "").alias("url"), "host",
                        F.replace(F.col("html"), F.lit("</ul>"), F.concat(F.coalesce("tags", F.lit("")), F.lit("</ul>"))).alias("html"))


_LINKED = (f"""fx_nei as (
 select src as page_id, string_agg({_TAG}, '' order by dst_url) as tags from fx_edges group by src)""",
    """fx_linked as (
 select p.page_id, regexp_replace(p.url, '#top$', '') as url, p.host,
  replace(p.html, '</ul>', coalesce(n.tags, '') || '</ul>') as html
 from fx_web p left join fx_nei n on p.page_id = n.page_id)""",
    fx.tag_scan("walk_tags", "fx_linked", "a", "page_id, url, host"),
    f"walk_hrefs as (select page_id, url, host, pos, t, {fx.attr('t', 'href')} as href from walk_tags)")


def _origin_seeds(spark, d, kind):
    """One seed per site: the first page of each host; its scope is the origin."""
    first = fx.fx_urls(spark, d).groupBy("host").agg(F.min_by("url", "page_id").alias("url"))
    url = F.regexp_replace("url", "#top$", "")
    return first.select(
        fx.seed_id(F.col("host")).alias("seed_id"), url.alias("url"),
        F.regexp_extract("url", "^(https?://[^/?#]*)", 1).alias("seed_url"),
        url_sha1(F.regexp_replace(url, "/$", "") if kind == 2 else url).alias("url_sha1"), F.lit(1).alias("depth"),
        F.lit(kind).alias("pagetype"), F.lit("c").alias("category"), F.lit("all").alias("category_1"))


_BLOG_WALK = (*_LINKED, fx.resolve_ctes("walk", "walk_hrefs", "url", "href", "link", True), f"""
walk_edges as (
 select distinct regexp_replace(url, '/$', '') as src, link as dst,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) as page_root from walk
 where not regexp_matches(link, '{fx._VALID}'))""", f"""
walk_starts as (
 select {fx._host_id('host')} as seed_id, regexp_replace(url, '#top$|/(#top)?$', '') as url,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) as seed_url from fx_ranked where rk = 1)""")
_BLOG_SELECT = """
select url, seed_id, min(depth) as depth from (
 with recursive w(url, seed_id, seed_url, depth) as (
  select url, seed_id, seed_url, 1 from walk_starts
  union select e.dst, w.seed_id, w.seed_url, w.depth + 1 from w join walk_edges e on w.url = e.src
  where w.depth <= (select max(rk) from fx_ranked) and starts_with(e.dst, w.seed_url))
 select * from w) t group by url, seed_id"""


@query("harvest_blog", fx.sql(_BLOG_SELECT, "fx_edges", "fx_web", more=_BLOG_WALK))
def harvest_blog(spark, d):
    pages = fx_linked(spark, d).select("page_id", "url", "html")
    config = HarvestConfig.blog()
    crawl = expand(spark, _origin_seeds(spark, d, 2), pages, config, work_dir(spark, "blog"))
    return crawl.select(F.regexp_replace("url", "/$", "").alias("url"), "seed_id", "depth")


@query("harvest_resumed", fx.sql(_BLOG_SELECT, "fx_edges", "fx_web", more=_BLOG_WALK))
def harvest_resumed(spark, d):
    """A walk that is stopped after its second level, then after two more, and goes on to the end."""
    pages, seeds, folder = fx_linked(spark, d).select("page_id", "url", "html"), _origin_seeds(spark, d, 2), work_dir(spark, "resumed")
    for levels in (2, 2, None):
        crawl = expand(spark, seeds, pages, HarvestConfig.blog(), folder, resume=True, levels=levels)
    return crawl.select(F.regexp_replace("url", "/$", "").alias("url"), "seed_id", "depth")


_REACHED = (f"reached as ({_BLOG_SELECT})", """got as (
 select p.page_id, p.url, r.seed_id from fx_linked p join reached r on regexp_replace(p.url, '/$', '') = r.url)""",
    "seen as (select count(distinct src) as n from fx_shown where page_id in (select page_id from got))")


@query("harvest_blog_tables", fx.sql("""
select 'blogpage' as name, count(*) as n from got union all
select 'blogpageseedrelation', count(*) from (select distinct url, seed_id from got) pairs
union all select 'photocache', n from seen union all select 'blogphotopagerelation', n from seen""",
    "fx_edges", "fx_web", "fx_shown", more=(*_BLOG_WALK, *_REACHED)))
def harvest_blog_tables(spark, d):
    """Row counts of the four tables a blog harvest fills."""
    tables = blog_tables(_blog_extract(spark, d, work_dir(spark, "blog")))
    counts = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return counts


def _blog_extract(spark, d, folder):
    pages = fx_linked(spark, d).select("page_id", "url", "html")
    crawl = expand(spark, _origin_seeds(spark, d, 2), pages, HarvestConfig.blog(), folder)
    blog_pages(crawl, pages).write.parquet(f"{folder}/extracted")
    return spark.read.parquet(f"{folder}/extracted")


# Two harvests of the same pages: the second adds no row and moves the refresh time only.
_FIRST_AT, _AGAIN_AT = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def _stored_twice(spark, root, tables_at, kind):
    for at in (_FIRST_AT, _AGAIN_AT):
        stored = store_harvest(spark, root, tables_at(F.to_timestamp(F.lit(at))), kind, buckets=8)
    return stored


def _times(df):
    return df.withColumn("dateinsert", F.col("dateinsert").cast("string")).withColumn(
        "daterefresh", F.col("daterefresh").cast("string"))


_TITLE = _MARKS.format(fx.unescape("regexp_extract(p.html, '(?is)<title[^>]*>([^<]+)', 1)"))


@query("harvest_blog_stored", fx.sql(f"""
select sha1(r.url) as pageurlhash, r.url as pageurl, arg_max({_TITLE}, p.page_id) as title,
 max(case when regexp_matches(p.url, '{_LISTING}') then 0 else 1 end) as detailed,
 '{_FIRST_AT}' as dateinsert, '{_AGAIN_AT}' as daterefresh
from fx_linked p join reached r on regexp_replace(p.url, '/$', '') = r.url group by r.url""",
    "fx_edges", "fx_web", more=(*_BLOG_WALK, _REACHED[0])))
def harvest_blog_stored(spark, d):
    """The page table after a blog harvest and its repetition, as stored versions."""
    folder = work_dir(spark, "blog")
    extracted = _blog_extract(spark, d, folder)
    pages = _stored_twice(spark, f"{folder}/store", lambda at: blog_tables(extracted, at=at), "blog")["blogpage"]
    return _times(pages).select("pageurlhash", F.regexp_replace("pageurl", "/$", "").alias("pageurl"), "title",
                                "detailed", "dateinsert", "daterefresh")


_PRODUCT_WALK = (*_LINKED, f"""
prod_edges as (
 select p.url as src_url, regexp_replace(e.dst_url, '#top$', '') as dst, {_ITEM} as item
 from fx_edges e join fx_linked p on e.src = p.page_id)""", f"""
prod_starts as (
 select {fx._host_id('host')} as seed_id, regexp_replace(url, '#top$', '') as url from fx_ranked where rk = 1)""", """
prod_lists as (
 select url, seed_id, min(depth) as depth from (
  with recursive w(url, seed_id, depth) as (
   select url, seed_id, 1 from prod_starts
   union select e.dst, w.seed_id, w.depth + 1 from w join prod_edges e on w.url = e.src_url
   where not e.item and w.depth <= (select max(rk) from fx_ranked))
  select * from w) t group by url, seed_id)""", """
prod_items as (
 select e.dst as url, l.seed_id, min(l.depth) + 1 as depth from prod_lists l join prod_edges e on l.url = e.src_url
 where e.item and e.dst not in (select url from prod_starts) group by e.dst, l.seed_id)""")


@query("harvest_product", fx.sql(f"""
select p.page_id, i.seed_id, i.depth, {_MARKS.format(fx.unescape("regexp_extract(p.html, '(?is)<title[^>]*>([^<]+)', 1)"))}
  as title, cast(10 + p.page_id % 90 as varchar) || ' 50 EUR' as price,
 regexp_extract(p.url, '^https?://[^/?#]*') || '/img/' || cast(p.page_id % 37 as varchar) || '.jpg' as mainimageurl,
 'store' as outcome
from prod_items i join fx_linked p on p.url = i.url""", "fx_edges", "fx_web", more=_PRODUCT_WALK))
def harvest_product(spark, d):
    """Product harvest: lists are walked by rule, detail pages give product rows with their outcome."""
    found = _product_extract(spark, d, work_dir(spark, "product"))
    return found.select("page_id", "seed_id", "depth", "title", "price", "mainimageurl", "outcome")


def _product_extract(spark, d, folder):
    fx_linked(spark, d).select("page_id", "url", "html").write.parquet(f"{folder}/pages")  # each level reads its list pages
    pages = spark.read.parquet(f"{folder}/pages")
    rules = rules_from_seeds(fx.fx_seeds(spark, d).withColumn(
        "detailurl_xpath", F.lit('//li[@class="item"]/a/@href')).withColumn(
        "nextpage_xpath", F.lit('//nav//li[@class="next"]/a/@href')))
    crawl = expand(spark, _origin_seeds(spark, d, 3), pages, HarvestConfig.product(), folder, rules)
    return product_pages(crawl, pages, spark.read.parquet(f"{folder}/rules"))


@query("harvest_product_stored", fx.sql(f"""
select sha1(i.url) as pageurlhash, i.url as pageurl, arg_max({_TITLE}, p.page_id) as title,
 arg_min(cast(10 + p.page_id % 90 as varchar) || ' 50 EUR', p.page_id) as price, -1 as imageamount,
 '{_FIRST_AT}' as dateinsert, '{_AGAIN_AT}' as daterefresh
from prod_items i join fx_linked p on p.url = i.url group by i.url""", "fx_edges", "fx_web", more=_PRODUCT_WALK))
def harvest_product_stored(spark, d):
    """The product table after a product harvest and its repetition, as stored versions."""
    folder = work_dir(spark, "product")
    _product_extract(spark, d, folder).write.parquet(f"{folder}/extracted")
    extracted = spark.read.parquet(f"{folder}/extracted")
    stored = _stored_twice(spark, f"{folder}/store", lambda at: product_tables(extracted, at), "product")
    return _times(stored["productpage"]).select("pageurlhash", "pageurl", "title", "price", "imageamount", "dateinsert", "daterefresh")


@query("stream_url_dedup", fx.sql("""
select distinct sha1(url) as url_sha1, url from fx_fetch_log""", "fx_fetch_log"))
def stream_url_dedup(spark, d):
    folder = work_dir(spark, "dedup")
    log = _log_stream(spark, d).select("url", url_sha1(F.col("url")).alias("url_sha1"))
    return ST.run_url_dedup(spark, log, f"{folder}/out", f"{folder}/checkpoint")


def _stream(spark, d, name):
    """A given table as a stream: the glob takes its one file, or its folder on a cluster."""
    return spark.readStream.schema(fx.table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def _web_stream(spark, d):
    pages = _stream(spark, d, "pages").filter("html <> ''").selectExpr("*", f"{fx.HOST} as host", f"{fx.ORIGIN} as origin")
    return pages.selectExpr("page_id", "url", "host", f"{fx.WEB_HTML} as html").withColumn("seed_id", fx.seed_id(F.col("host")))


def _log_stream(spark, d):
    return _stream(spark, d, "events").selectExpr(*fx._split_columns(fx.FETCH_LOG))


@query("stream_page_upsert", fx.sql(
    _UPSERTED.format(first="f.price,").replace("n_all", "n").replace("n_back", "n_rev"), "fx_fetch_log", more=(_LOG,)))
def stream_page_upsert(spark, d):
    folder = work_dir(spark, "upsert")
    merge = Merge("pageurlhash", ("pageurl", "price"), ("title", "pagetext"))
    updates = _log_stream(spark, d).filter("failed = 0").select(
        "event_id", "ts", F.col("url").alias("pageurl"), url_sha1(F.col("url")).alias("pageurlhash"),
        erase_marks(F.col("title")).alias("title"), "pagetext", "price")
    ST.run_upsert(updates, merge, f"{folder}/log", f"{folder}/checkpoint")
    rows = ST.read_upserted(spark, merge, f"{folder}/log")
    return rows.withColumn("dateinsert", F.col("dateinsert").cast("string")).withColumn(
        "daterefresh", F.col("daterefresh").cast("string"))


@query("stream_links", fx.sql(f"""
select l.page_id, l.pos, l.link, l.seed_id, sha1(l.link) as url_sha1 from (
 select *, {fx._host_id('host')} as seed_id from canon) l join fx_seeds s on s.id = l.seed_id
where not regexp_matches(link, '{fx._VALID}') and starts_with(link, trim(s.url))""", "fx_seeds", "raw_links",
    more=(fx.resolve_ctes("canon", "raw_links", "url", "href", "link", True),)))
def stream_links(spark, d):
    folder = work_dir(spark, "links")
    pages = _stream(spark, d, "pages").withColumn("seed_id", fx.seed_id(F.expr(fx.HOST)))
    seeds = fx.fx_seeds(spark, d).select(F.col("id").alias("seed_id"), F.trim("url").alias("seed_url"))
    found = ST.page_links(pages, seeds).select("page_id", "pos", "link", "seed_id", "url_sha1")
    ST.run_append(found, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query("stream_product_rows", fx.sql(f"""
select page_id, {fx._host_id('host')} as seed_id, {_MARKS.format('title')} as title, {_MARKS.format('brand')} as brand,
 {_MARKS.format('price')} as price, coalesce(full_srcs[1], '') as mainimageurl,
 case when full_srcs[1] <> '' then 'store' when title <> '' and price <> '' then 'retry' else 'drop' end as outcome
from absolute""", "fx_web", more=(_FIELDS,)))
def stream_product_rows(spark, d):
    folder = work_dir(spark, "rows")
    seed_rules(rules_from_seeds(fx.fx_seeds(spark, d))).write.parquet(f"{folder}/rules")
    rows = ST.product_rows(_web_stream(spark, d), spark.read.parquet(f"{folder}/rules"))
    found = rows.select("page_id", "seed_id", "title", "brand", "price", "mainimageurl", "outcome")
    ST.run_append(found, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query("stream_rule_as_of", fx.sql(f"""
select page_id, {_MARKS.format("case when day between 20 and 79 then title else '' end")} as title,
 {_MARKS.format("case when day between 40 and 99 then brand when day >= 100 then title else '' end")} as brand,
 {_MARKS.format("case when day between 0 and 59 then price when day >= 60 then brand else '' end")} as price
from (select *, (page_id * 13) % 150 - length(host) % 7 as day from fields) f""", "fx_web", more=(_FIELDS,)))
def stream_rule_as_of(spark, d):
    """Detail pages of a stream, each read by the rules in force when it was fetched."""
    folder = work_dir(spark, "as-of")
    rule_history(fx.fx_rule_changes(spark, d)).write.parquet(f"{folder}/history")
    pages = _web_stream(spark, d).withColumn("fetched", F.expr(fx.FETCHED))
    found = ST.product_rows(pages, spark.read.parquet(f"{folder}/history"), "fetched").select("page_id", "title", "brand", "price")
    ST.run_append(found, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query("stream_politeness", fx.sql("""
select url, regexp_extract(url, '^https?://([^/?#]*)', 1) as host, ord,
 cast((row_number() over (partition by regexp_extract(url, '^https?://([^/?#]*)', 1) order by ord) - 1) * 0.25
  as double) as start_at from first_items""", "fx_items", more=(_FIRST,)))
def stream_politeness(spark, d):
    """The queue replayed: what the stream lets go, and when, is what the batch plan says."""
    folder, begin = work_dir(spark, "polite"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    queue = first_seen(fx.fx_items(spark, d), ["url_sha1"], ["ord"]).select("url", "ord", F.lit(1).alias("attempt"), begin.alias("at"))
    queue.write.parquet(f"{folder}/queue")
    queue = spark.read.parquet(f"{folder}/queue")
    # The clock goes on until the last request of a queue that has one host only.
    clock = queue.agg(F.timestamp_seconds(F.unix_timestamp(begin) + F.count("*")).alias("at"))
    clock.select(F.lit(None).cast("string").alias("url"), F.lit(0).cast("bigint").alias("ord"), F.lit(1).alias("attempt"), "at").write.mode(
        "append").parquet(f"{folder}/queue")
    released = ST.run_polite(spark, ST.read_folder(spark, f"{folder}/queue", queue.schema), f"{folder}/out", f"{folder}/checkpoint",
                             delay=HarvestConfig.blog().delay_seconds)
    return released.select("url", "host", "ord", ((F.unix_millis("start_at") - F.unix_millis(begin)) / 1000).alias("start_at"))


@query("stream_seed_refresh", fx.sql(_BLOG_SELECT, "fx_edges", "fx_web", more=_BLOG_WALK))
def stream_seed_refresh(spark, d):
    """Seeds come in two lots, the first lot comes again with the second; each lot is a round when the one before is idle."""
    folder = work_dir(spark, "refresh")
    pages, seeds = fx_linked(spark, d).select("page_id", "url", "html"), _origin_seeds(spark, d, 2)
    blog_edges(pages, HarvestConfig.blog()).write.parquet(f"{folder}/edges")
    edges = spark.read.parquet(f"{folder}/edges")  # for the rounds of both lots
    for part in (seeds.filter("seed_id % 2 = 0"), seeds):
        part.write.mode("append").parquet(f"{folder}/arrived")
        arrived = ST.read_folder(spark, f"{folder}/arrived", seeds.schema)
        items = ST.run_refresh(spark, arrived, pages, HarvestConfig.blog(), f"{folder}/state", f"{folder}/checkpoint", edges=edges)
    return items.select(F.regexp_replace("url", "/$", "").alias("url"), "seed_id", "depth")


@query("stream_retry", fx.sql("""
select event_id, url, cast(least(user_failures + 1, 4) as integer) as attempt,
 case when user_failures < 4 then 'done' else 'dead' end as status
from (select event_id, url, event_id % 6 as user_failures from fx_fetch_log) t""", "fx_fetch_log"))
def stream_retry(spark, d):
    """Each item fails a number of times that its id gives, then succeeds."""
    folder = work_dir(spark, "retry")
    items = fx.fx_fetch_log(spark, d).select("event_id", "url", (F.col("event_id") % 6).alias("failures"),
                                             F.lit(1).alias("attempt"))
    items.write.parquet(f"{folder}/frontier/start")
    ended = ST.run_retries(spark, f"{folder}/frontier", lambda: F.col("attempt") <= F.col("failures"),
                           f"{folder}/ended", f"{folder}/checkpoint")
    return ended.select("event_id", "url", "attempt", "status")
