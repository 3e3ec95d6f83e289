"""Tables derived from the given ones: the same text serves Spark and the oracle wherever possible.

The given pages hold no images, dates, seeds or links to one another; these views add them to every
page, so that each query still grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblake.functions.urls import url_sha1
from weblake.operators.frontier import ranked
from weblake.operators.links import canonicalize, filter_links, links
from weblake.sources.pages import read_pages

# --- text shared by both engines ---------------------------------------------------------------

HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"

NAV = """concat(
 '<a href="../up/', cast(page_id % 11 as string), '">up</a>',
 '<a href=', chr(39), './', cast(page_id % 13 as string), '/?s=1', chr(39), '>rel</a>',
 '<a href="//cdn.example.net/l/">cdn</a><a href="?page=2&amp;x=1">q</a><a href="#c1">f</a>',
 '<a href="javascript:void(0)">j</a><a href="mailto:a@b.example">m</a>',
 '<a href="/pic/', cast(page_id % 5 as string), '.jpg">i</a>',
 '<a class="k" href="http://facebook.com/z">s</a>',
 '<A HREF="http://', host, '/list/', cast(page_id % 3 as string), '/">abs</A>',
 '<!-- <a href="/hidden"> --></nav>')"""
ARTICLE = """concat(
 '<p>Posted 2012-03-', lpad(cast(1 + page_id % 28 as string), 2, '0'), '</p>',
 '<img src="/img/', cast(page_id % 37 as string), '.jpg" alt="pic ', cast(page_id as string), '">',
 '<img src="logo.png"><p>Price <span class="price">', cast(10 + page_id % 90 as string), '.50 EUR</span></p>',
 '<a id="more" href="/item/', cast(page_id % 17 as string), '">Seen on March ',
 cast(1 + page_id % 30 as string), ', 2011</a>',
 '<img alt="&quot;q&quot;" src="http://img.example.org/', cast(page_id % 7 as string), '.png">',
 '<div class="comment"><p>on 2013-01-01</p></div></article>')"""
WEB_HTML = f"replace(replace(html, '</nav>', {NAV}), '</article>', {ARTICLE})"

SEED_COLUMNS = """
 case when host like 'www.%' then concat('http://', host, ' ') else concat('http://', host) end as url,
 case when host like 'blog.%' then 2 else 3 end as photosourcetype_id,
 case when host like '%cheap-pills%' then 1 else 0 end as deleted,
 case when length(host) % 9 = 0 then 1 else 0 end as webkit,
 concat('cat', cast(length(host) % 5 as string)) as category, 'all' as category_1,
 '//title/text()' as title_xpath, '//article/h1/text()' as brand_xpath,
 '//article/p/text()' as description_xpath, '//article//span[@class="price"]/text()' as price_xpath,
 '//article/img/@src' as mainimageurl_xpath, '//article//img/@src | //nav//img/@src' as imageurl_xpath,
 '//nav//li/a/@href | //a[@id="more"]/@href' as detailurl_xpath, '//nav/a/@href' as nextpage_xpath,
 cast(null as string) as color_xpath"""

# Rules of a seed change six times; a page was fetched on some day before, between or after.
RULE_CHANGES = """
 id as seed_id, case when k % 3 = 0 then 'price_xpath' when k % 3 = 1 then 'title_xpath' else 'brand_xpath' end as field,
 case when k = 0 then '//article//span[@class="price"]/text()' when k = 1 then '//title/text()' when k in (2, 3) then '//article/h1/text()'
  when k = 4 then cast(null as string) else '//title/text()' end as selector,
 date '2024-01-01' + cast(20 * k + length(host) % 7 as int) as since"""
FETCHED = "date '2024-01-01' + cast((page_id * 13) % 150 as int)"

FETCH_LOG = """
 event_id, ts, event_type,
 concat('http://site', cast(user_id % 40 as string), '.example.org/p/', cast(user_id as string)) as url,
 concat(event_type, ' #', cast(event_id as string)) as title, props as pagetext,
 cast(value as string) as price, case when event_type = 'error' then 1 else 0 end as failed"""

IMAGE_SIZES = """
 page_id, concat(origin, '/img/', cast(page_id % 37 as string), '.jpg') as src,
 60 + (page_id * 37) % 900 as width, 60 + (page_id * 91) % 700 as height"""

PAIRS = """
 page_id, case when page_id % 10 = 9 then '["only-one"]' else concat('["', origin, '/img/',
 cast(page_id % 37 as string), '.jpg","', url, '"]') end as pair_json"""


# --- Spark side --------------------------------------------------------------------------------

def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fx_pages(spark, d) -> DataFrame:
    return read_pages(spark, f"{d}/pages.parquet").selectExpr(
        "*", f"{HOST} as host", f"{ORIGIN} as origin")


def fx_urls(spark, d) -> DataFrame:
    """Page addresses only; the html column is not read."""
    return table(spark, d, "pages").selectExpr("page_id", "url", f"{HOST} as host", f"{ORIGIN} as origin")


def fx_web(spark, d) -> DataFrame:
    return fx_pages(spark, d).selectExpr(
        "page_id", "url", "host", "origin", f"{WEB_HTML} as html")


def seed_id(host):
    """A seed id from its host, without numbering all hosts in one task."""
    return F.conv(F.substring(F.sha1(host), 1, 12), 16, 10).cast("bigint")


def fx_seeds(spark, d) -> DataFrame:
    hosts = fx_urls(spark, d).select("host").distinct()
    return hosts.select("host", seed_id(F.col("host")).alias("id")).selectExpr(
        "host", "id", *_split_columns(SEED_COLUMNS))


def fx_rule_changes(spark, d) -> DataFrame:
    """changes(seed_id, field, selector, since) of the rules of every seed."""
    return fx_seeds(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).selectExpr(*_split_columns(RULE_CHANGES))


def _split_columns(text):
    parts, depth, start = [], 0, 0
    for i, char in enumerate(text):
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]


def fx_links(spark, d, source=fx_web) -> DataFrame:
    return links(source(spark, d), ("page_id", "url", "host"))


def fx_items(spark, d) -> DataFrame:
    """Frontier candidates: valid canonical links in queue order, with many repeats."""
    found = filter_links(canonicalize(fx_links(spark, d)))
    return found.select(
        F.col("link").alias("url"), url_sha1(F.col("link")).alias("url_sha1"),
        seed_id(F.col("host")).alias("seed_id"), (F.lit(2) + F.col("pos") % 3).alias("depth"),
        (F.col("page_id") * 1000000 + F.col("pos")).alias("ord"), F.lit(1).alias("attempt"),
        F.when(F.col("url").startswith("https://"), 1).otherwise(0).alias("walked"))


def fx_visited(spark, d) -> DataFrame:
    """Links of the pages under https count as visited."""
    return fx_items(spark, d).filter(F.col("walked") == 1).select("url_sha1").distinct()


def fx_edges(spark, d) -> DataFrame:
    """Page graph: per host a binary tree plus back edges, so cycles exist.

    Each page names the ranks it points to, then one equi-join finds them.
    """
    pages = fx_urls(spark, d).select("page_id", "host", "url")
    rank = ranked(pages, ["host"], ["page_id"], F.floor(F.col("page_id") / 65536), "rk")
    targets = rank.select(
        F.col("page_id").alias("src"), F.col("rk").alias("src_rk"), "host",
        F.explode(F.array(2 * F.col("rk"), 2 * F.col("rk") + 1, F.col("rk") - 1)).alias("rk"))
    return targets.join(rank.select("host", "rk", F.col("page_id").alias("dst"), F.col("url").alias("dst_url")),
                        ["host", "rk"]).select("src", "src_rk", "dst", "dst_url", "host")


def fx_fetch_log(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr(*_split_columns(FETCH_LOG))


def fx_images(spark, d) -> DataFrame:
    return fx_urls(spark, d).selectExpr("url", *_split_columns(IMAGE_SIZES))


def fx_pairs(spark, d) -> DataFrame:
    return fx_urls(spark, d).selectExpr(*_split_columns(PAIRS))


# --- oracle side -------------------------------------------------------------------------------

TOKEN = (r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[!?][^>]*>"
         r"|</?[a-z](?:[^>""''=]|=\"[^\"]*\"|=''[^'']*''|=)*>|[^<]+").replace('""', '"')


def resolve_ctes(name, source, base, ref, out, blog):
    """CTE text that adds the absolute form of ``ref`` as ``out``."""
    dots = ("case when {p} = '' then '' when not regexp_matches({p}, '/\\.\\.?(/|$)') then {p} else "
            "list_reduce(string_split(substr({p}, 2), '/'), lambda a, x: case when x = '.' then a "
            "when x = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end, '') "
            "|| case when regexp_matches({p}, '/\\.\\.?$') then '/' else '' end end")
    kept = f"when {ref} like 'http://%' then regexp_replace({ref}, '/$', '')" if blog else ""
    strip = "regexp_replace(full_url, '/$', '')" if blog else "full_url"
    return f"""{name}_1 as (
 select *, regexp_replace({ref}, '#$', '') as r,
  regexp_extract({base}, '^([a-z]+://[^/?#]*)', 1) as b_root,
  regexp_extract({base}, '^[a-z]+://[^/?#]*([^?#]*)', 1) as b_path,
  regexp_extract({base}, '^[^#]*') as b_page, regexp_extract({base}, '^[a-z]+:') as b_scheme from {source}),
{name}_2 as (
 select *, regexp_extract(r, '^[^?#]*([?#].*)?$', 1) as tail, regexp_extract(r, '^[^?#]*') as r_path,
  case when r = '' then 'page' when regexp_matches(r, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then 'other' when r like '//%' then 'net'
   when r like '/%' then 'root' when r like '?%' then 'query' when r like '#%' then 'fragment'
   else 'relative' end as form from {name}_1),
{name}_3 as (
 select *, case form when 'web' then regexp_extract(r, '^https?://[^/?#]*([^?#]*)', 1)
   when 'net' then regexp_extract(r, '^//[^/?#]*([^?#]*)', 1) when 'root' then r_path
   else '/' || regexp_extract(b_path, '^/(.*/)?', 1) || r_path end as long_path,
  case form when 'web' then regexp_extract(r, '^https?://[^/?#]*')
   when 'net' then b_scheme || regexp_extract(r, '^//[^/?#]*') else b_root end as root from {name}_2),
{name}_4 as (
 select *, case form when 'page' then b_page when 'other' then r when 'net' then b_scheme || r
  when 'query' then b_root || b_path || r when 'fragment' then b_page || r else b_root || {dots.format(p='long_path')} || tail end as full_url from {name}_3),
{name} as (
 select *, case when {ref} = '' then null {kept} else {strip} end as {out} from {name}_4)"""


def _host_id(host):
    return f"cast('0x' || substr(sha1({host}), 1, 12) as bigint)"


def tag_scan(name, source, tag, columns):
    """CTE text: one row per start tag outside comments, scripts and styles."""
    pattern = (rf"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
               rf"|<{tag}\s[^>]*>")
    return f"""{name}_0 as (
 select {columns}, list_filter(regexp_extract_all(html, '{pattern}'),
  lambda t: regexp_matches(t, '(?i)^<{tag}\\s')) as l from {source}),
{name} as (select {columns}, generate_subscripts(l, 1) - 1 as pos, unnest(l) as t from {name}_0)"""


def unescape(text):
    return (f"replace(replace(replace(replace({text}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), "
            f"'&amp;', '&')")


def attr(tag, name):
    return unescape(f"regexp_extract({tag}, '(?is)\\s{name}=[\"'']([^\"'']*)[\"'']', 1)")


_VALID = (r"^$|#[0-9a-zA-Z_-]*$|^javascript:|^mailto:|\.jpg|\.png|\.gif|\.gpeg|\.bmp|\.tiff|\.pcx|\.tga"
          r"|facebook\.com|google\.com|twitter\.com")

CTES = {
    "fx_pages": ((), f"fx_pages as (select page_id, url, html, {HOST} as host, {ORIGIN} as origin from pages "
                     "where html is not null and html <> '')"),
    "fx_web": (("fx_pages",), f"fx_web as (select page_id, url, host, origin, {WEB_HTML} as html from fx_pages)"),
    "fx_seeds": (("fx_pages",), f"fx_seeds as (select host, {_host_id('host')} as id, {SEED_COLUMNS} "
                                "from (select distinct host from fx_pages) h)"),
    "fx_rule_changes": (("fx_seeds",), f"fx_rule_changes as (select {RULE_CHANGES} from fx_seeds, range(6) r(k))"),
    "raw_links": (("fx_pages",), tag_scan("raw_links_t", "fx_pages", "a", "page_id, url, host") + f""",
raw_links as (select page_id, url, host, pos, {attr('t', 'href')} as href from raw_links_t)"""),
    "fx_links": (("fx_web",), tag_scan("fx_links_t", "fx_web", "a", "page_id, url, host") + f""",
fx_links as (select page_id, url, host, pos, {attr('t', 'href')} as href from fx_links_t)"""),
    "fx_canon": (("fx_links",), resolve_ctes("fx_canon", "fx_links", "url", "href", "link", True)),
    "fx_valid": (("fx_canon",), f"fx_valid as (select * from fx_canon where not regexp_matches(link, '{_VALID}'))"),
    "fx_items": (("fx_valid",), f"""fx_items as (
 select link as url, sha1(link) as url_sha1, {_host_id('host')} as seed_id, 2 + pos % 3 as depth,
  page_id * 1000000 + pos as ord, 1 as attempt, case when url like 'https://%' then 1 else 0 end as walked
 from fx_valid)"""),
    "fx_visited": (("fx_items",), "fx_visited as (select distinct url_sha1 from fx_items where walked = 1)"),
    "fx_ranked": (("fx_pages",), "fx_ranked as (select page_id, host, url, row_number() over "
                                 "(partition by host order by page_id) as rk from fx_pages)"),
    "fx_edges": (("fx_ranked",), """fx_edges as (
 select a.page_id as src, a.rk as src_rk, b.page_id as dst, b.url as dst_url, a.host
 from fx_ranked a join fx_ranked b on a.host = b.host
  and (b.rk = 2 * a.rk or b.rk = 2 * a.rk + 1 or b.rk = a.rk - 1))"""),
    "fx_fetch_log": ((), f"fx_fetch_log as (select {FETCH_LOG} from events)"),
    "fx_images": (("fx_pages",), f"fx_images as (select url, {IMAGE_SIZES} from fx_pages)"),
    "fx_pairs": (("fx_pages",), f"fx_pairs as (select {PAIRS} from fx_pages)"),
    "fx_tokens": (("fx_web",), f"""fx_tokens_0 as (
 select page_id, url, host, regexp_extract_all(html, '{TOKEN}') as l from fx_web),
fx_tokens_1 as (select page_id, url, host, generate_subscripts(l, 1) - 1 as i, unnest(l) as t from fx_tokens_0),
fx_tokens as (
 select *, case when is_elem = 1 then elems - 1 end as node_no from (
  select *, sum(is_elem) over (partition by page_id order by i) as elems,
   lag(t) over (partition by page_id order by i) as prev_t,
   lag(t, 2) over (partition by page_id order by i) as prev_t2,
   lag(elems_at) over (partition by page_id order by i) as prev_node from (
   select *, case when regexp_matches(t, '^<[a-zA-Z]') then 1 else 0 end as is_elem,
    cast(sum(case when regexp_matches(t, '^<[a-zA-Z]') then 1 else 0 end)
     over (partition by page_id order by i) - 1 as integer) as elems_at from fx_tokens_1) a) b)"""),
    "fx_dates": (("fx_tokens",), """fx_dates_0 as (
 select page_id, prev_node as node_no, regexp_extract(t, '(?i)\\b\\d{4}-\\d{1,2}-\\d{1,2}\\b') as d1,
  regexp_extract_all(t, '(?i)\\bmarch (\\d{1,2}), (\\d{4})\\b', 1) as d2,
  regexp_extract(t, '(?i)\\bmarch (\\d{1,2}), (\\d{4})\\b', 2) as d2y
 from fx_tokens where regexp_matches(prev_t, '^<[a-zA-Z]') and coalesce(prev_t2, '') not like '%class="comment"%'
  and not regexp_matches(t, '^<')),
fx_dates as (
 select page_id, node_no, cast(try_cast(case when d1 <> '' then d1 else d2y || '-03-' || lpad(d2[1], 2, '0') end
  as date) as varchar) as date from fx_dates_0 where d1 <> '' or len(d2) > 0)"""),
    "fx_shown": (("fx_tokens",), f"""fx_shown_0 as (
 select page_id, url, node_no, {attr('t', 'src')} as s, {attr('t', 'alt')} as alt from fx_tokens
 where regexp_matches(t, '(?i)^<img\\s')),
{resolve_ctes('fx_shown_r', 'fx_shown_0', 'url', 's', 'res', False)},
fx_shown as (select page_id, url, cast(node_no as integer) as node_no, alt,
  case when regexp_matches(s, '^https?://') then s else res end as src from fx_shown_r where s <> '')"""),
}


def sql(select: str, *names: str, more: tuple[str, ...] = ()) -> str:
    """``select`` with the named CTEs, those they need, and ``more`` CTE texts in front."""
    order: list[str] = []

    def add(name):
        if name not in order:
            for needed in CTES[name][0]:
                add(needed)
            order.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join([*(CTES[name][1] for name in order), *more]) + "\n" + select.strip()
