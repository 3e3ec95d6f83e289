"""Tokens, nodes, links, titles, text, rules, dates, images."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx, query
from weblake.functions import html as H
from weblake.functions.text import decode_entities, erase_marks, ordered_distinct
from weblake.operators import images as I, links as L, nodes as N, rules as R
from weblake.operators.rule_history import rule_history, with_rules_at
from weblake.operators.treepass import IMPLIED_END, VOID
from weblake.session import work_dir

_KIND = """case when t like '<!--%' then 'comment' when regexp_matches(t, '(?i)^<script\\b') then 'script'
 when regexp_matches(t, '(?i)^<style\\b') then 'style' when regexp_matches(t, '^<[!?]') then 'declaration'
 when regexp_matches(t, '^</') then 'end' when regexp_matches(t, '^<') then 'start' else 'text' end"""


@query("html_tokens", f"""
with l as (select page_id, regexp_extract_all(html, '{fx.TOKEN}') as l from pages),
u as (select page_id, generate_subscripts(l, 1) - 1 as token_no, unnest(l) as t from l)
select page_id, token_no, {_KIND} as kind, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag,
 t as token from u""")
def html_tokens(spark, d):
    return N.tokens(fx.fx_pages(spark, d))


def _names(tags):
    return "[" + ", ".join(f"'{t}'" for t in sorted(tags)) + "]"


# The tree walk as SQL: a token a step for all pages at once, the open elements in a list.
_ENDS = "case tag " + " ".join(f"when '{tag}' then {_names(ends)}" for tag, ends in IMPLIED_END.items()) + " else []::varchar[] end"
_NODE_WALK = rf"""
with recursive l as (select page_id, regexp_extract_all(html, '{fx.TOKEN}') as l from pages),
u as (select page_id, generate_subscripts(l, 1) - 1 as i, unnest(l) as t from l),
toks as (
 select *, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9:_-]*)', 1)) as tag,
  case when regexp_matches(t, '^</[a-zA-Z]') then 'end' when regexp_matches(t, '^<[a-zA-Z]') then 'start'
   when regexp_matches(t, '^<[!?]') then 'skip' else 'text' end as what from u),
parts as (
 select *, {_ENDS} as ends, regexp_extract(t, '^<[^>]*>') as head,
  case when tag in ('script', 'style') then regexp_replace(regexp_replace(t, '^<[^>]*>', ''), '(?i)</(script|style)\s*>$', '') end as content
 from toks),
attrs as (
 select *, list_transform(regexp_extract_all(head, '[^\s">/=]+="[^"]*"'), lambda a: regexp_extract(a, '^([^=]+)=', 1)) as names,
  list_transform(regexp_extract_all(head, '[^\s">/=]+="[^"]*"'), lambda a: regexp_extract(a, '="([^"]*)"$', 1)) as vals from parts),
rich as (
 select *, coalesce(vals[list_position(names, 'class')], '') as class_, coalesce(vals[list_position(names, 'id')], '') as id_,
  '{{' || array_to_string(list_transform(range(1, len(names) + 1), lambda j: '"' || names[j] || '":"' || vals[j] || '"'), ',') || '}}' as json
 from attrs),
walk as (
 select page_id, cast(-1 as bigint) as i, cast(-1 as bigint) as last_no, cast(null as varchar) as kind, cast(null as bigint) as node_no,
  cast(null as bigint) as parent_no, cast(null as bigint) as depth, cast(null as varchar) as path, cast(null as boolean) as in_comment,
  cast([] as struct(no bigint, tag varchar, path varchar, kids varchar[], com boolean)[]) as stack, cast([] as varchar[]) as roots
 from l
 union all
 select page_id, i, last_no + starts, case what when 'start' then 'elem' else what end,
  case what when 'start' then last_no + 1 else coalesce(top.no, -1) end, coalesce(top.no, -1),
  case when what = 'text' and top is null then 1 else len(open_) end,
  case when what = 'start' then new_path else coalesce(top.path, '/body[1,1]') end,
  coalesce(top.com, false),
  case what when 'start' then
    list_concat(case when top is null then open_ else list_append(open_[1:len(open_) - 1],
      struct_pack(no := top.no, tag := top.tag, path := top.path, kids := list_append(top.kids, tag), com := top.com)) end,
     case when pushes then [struct_pack(no := last_no + 1, tag := tag, path := new_path, kids := cast([] as varchar[]),
       com := coalesce(top.com, false) or regexp_matches(class_ || ' ' || id_, 'comment|feedback'))] else [] end)
   else open_ end,
  case when what = 'start' and top is null then list_append(roots, tag) else roots end
 from (
  select *, coalesce(top.path, '') || '/' || tag || '[' || (len(list_filter(coalesce(top.kids, roots), lambda k: k = tag)) + 1) || ',' ||
    (len(coalesce(top.kids, roots)) + 1) || ']' || case when class_ <> '' then '@class="' || class_ || '"' else '' end ||
    case when id_ <> '' then '@id="' || id_ || '"' else '' end as new_path,
   tag not in {str(tuple(sorted(VOID)))} and tag not in ('script', 'style') and t not like '%/>' as pushes,
   case when what = 'start' then 1 else 0 end as starts
  from (
   select *, open_[len(open_)] as top from (
    select w.page_id, w.last_no, w.roots, r.i, r.t, r.tag, r.what, r.class_, r.id_, w.stack[1:len(w.stack) - case r.what
      when 'end' then coalesce(list_position(list_reverse(list_transform(w.stack, lambda x: x.tag)), r.tag), 0)
      when 'start' then coalesce(list_position(list_reverse(list_transform(w.stack, lambda x: list_contains(r.ends, x.tag))), false) - 1, len(w.stack))
      else 0 end] as open_
    from walk w join rich r on r.page_id = w.page_id and r.i = w.i + 1) a) b) c),
own as (
 select page_id, node_no, string_agg(t, '' order by i) as text from (
  select w.page_id, w.node_no, w.i, r.t from walk w join rich r using (page_id, i) where w.kind = 'text' and w.node_no >= 0
  union all select w.page_id, w.node_no, w.i, r.content from walk w join rich r using (page_id, i) where w.kind = 'elem' and r.content <> '') o
 group by page_id, node_no)
select w.page_id, w.i as ord, w.kind, w.node_no, w.parent_no, w.depth, case when w.kind = 'elem' then r.tag else
  coalesce(w.stack[len(w.stack)].tag, 'body') end as tag, case when w.kind = 'elem' then r.json else '{{}}' end as attrs,
 case when w.kind = 'elem' then coalesce(o.text, '') else r.t end as text, w.path, w.in_comment
from walk w join rich r using (page_id, i) left join own o on o.page_id = w.page_id and o.node_no = w.node_no and w.kind = 'elem'
where w.kind = 'elem' or (w.kind = 'text' and (w.node_no >= 0 or trim(r.t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''))
union all
select w.page_id, w.i, 'text', w.node_no, w.node_no, w.depth + 1, r.tag, '{{}}', r.content, w.path, w.in_comment
from walk w join rich r using (page_id, i) where w.kind = 'elem' and r.content <> ''
"""


@query("html_nodes", _NODE_WALK)
def html_nodes(spark, d):
    return (N.nodes(fx.fx_pages(spark, d))
            .withColumn("attrs", F.to_json("attrs")))


@query("html_node_counts", fx.sql("""
select page_id, cast(node_no as bigint) as node_no, lower(regexp_extract(t, '^<([a-zA-Z0-9]+)', 1)) as tag
from fx_tokens where is_elem = 1""", "fx_tokens"))
def html_node_counts(spark, d):
    """Numbering of elements: document order from 0."""
    nodes = N.nodes(fx.fx_web(spark, d)).filter("kind = 'elem'")
    return nodes.select("page_id", F.col("node_no").cast("bigint").alias("node_no"), "tag")


@query("link_extract", fx.sql("select page_id, url, pos, href from raw_links", "raw_links"))
def link_extract(spark, d):
    return L.links(fx.fx_pages(spark, d))


@query("link_canonicalize", fx.sql("select page_id, url, pos, href, link from fx_canon", "fx_canon"))
def link_canonicalize(spark, d):
    return L.canonicalize(fx.fx_links(spark, d)).drop("host")


@query("link_canonicalize_product", "with " + ",\n".join((
    fx.CTES["fx_pages"][1], fx.CTES["fx_web"][1], fx.CTES["fx_links"][1],
    fx.resolve_ctes("canon", "fx_links", "url", "href", "link", False))) +
    "\nselect page_id, url, pos, href, link from canon")
def link_canonicalize_product(spark, d):
    return L.canonicalize(fx.fx_links(spark, d), blog=False).drop("host")


@query("link_filter", fx.sql("select page_id, url, pos, href, link from fx_valid", "fx_valid"))
def link_filter(spark, d):
    return L.filter_links(L.canonicalize(fx.fx_links(spark, d))).drop("host")


_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_LISTING = (r"(\?showComment|/page/|\?=p|\?cat=|\?=page|_archive|#|/search\?|search/label|index\.|\?paged=|/category/)"
            rf"|({_MONTHS})/?$|\d{{4}}[-/](0?[1-9]|1[012])([-/](0?[1-9]|[12]\d|3[01]))?[-/]?$")


@query("page_kind", f"""
select page_id, url, case when regexp_matches(url, '{_LISTING}') then 0 else 1 end as detailed from pages""")
def page_kind(spark, d):
    return L.page_kind(fx.table(spark, d, "pages").select("page_id", "url"))


@query("page_kind_custom", r"""
select page_id, url, case when regexp_matches(url, '/(news|tag)/|[0-9]\.html$') then 0 else 1 end as detailed from pages""")
def page_kind_custom(spark, d):
    """A listing pattern that is given as data."""
    pages = fx.table(spark, d, "pages").select("page_id", "url")
    return L.page_kind(pages, pattern=r"/(news|tag)/|[0-9]\.html$")


@query("page_title", f"""
select page_id, {fx.unescape("regexp_extract(html, '(?is)<title[^>]*>([^<]+)', 1)")} as title from pages""")
def page_title(spark, d):
    return fx.fx_pages(spark, d).select("page_id", H.title(F.col("html")).alias("title"))


_RAW_TEXT = fx.unescape(
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>"
    "|<style\\b.*?</style\\s*>', '', 'g'), '(?is)<a\\s[^>]*>[^<]*</a>', '', 'g'), '<[^>]*>', '', 'g')")


@query("page_text_blog", fx.sql(f"""
select page_id, regexp_replace({_RAW_TEXT}, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') as pagetext from fx_web""", "fx_web"))
def page_text_blog(spark, d):
    return N.page_text(N.parse(fx.fx_web(spark, d))).select("page_id", "pagetext")


@query("page_text_product", fx.sql(f"select page_id, {_RAW_TEXT} as pagetext from fx_web", "fx_web"))
def page_text_product(spark, d):
    return N.page_text(N.parse(fx.fx_web(spark, d)), squeeze=False).select("page_id", "pagetext")


@query("text_clean", """
select page_id, translate(title, '`~!@#$%^&*()_+-={[}]|:;''"<,>./\\•', '""" + " " * 32 + f"""') as title from (
 select page_id, {fx.unescape("regexp_extract(html, '(?is)<title[^>]*>([^<]+)', 1)")} as title from pages) t""")
def text_clean(spark, d):
    return fx.fx_pages(spark, d).select("page_id", erase_marks(H.title(F.col("html"))).alias("title"))


# Detail pages: every page belongs to the seed of its host.

def _rules(spark, d):
    return R.rules_from_seeds(fx.fx_seeds(spark, d))


def _ruled(spark, d, pages=None, fields=R.DETAIL_FIELDS):
    """Pages with what the rules of their seed take. The compiled rules are a stored table: its size on disk
    tells Spark whether to broadcast it."""
    stored = f"{work_dir(spark, 'rules')}/by_seed"
    R.seed_rules(_rules(spark, d)).write.parquet(stored)
    pages = fx.fx_web(spark, d) if pages is None else pages
    pages = pages.withColumn("seed_id", fx.seed_id(F.col("host")))
    return R.parse_for_rules(R.with_rules(pages, spark.read.parquet(stored)), ("page_id", "url", "seed_id"), fields, nodes=False)


_DISTINCT = "array_to_string(list_filter({l}, lambda x, i: x <> '' and list_position({l}, x) = i), '')"
_BODY = "regexp_extract(html, '(?s)<article>.*</article>')"
_FIELDS = f"""fields as (
 select page_id, url, host,
  {fx.unescape("regexp_extract(html, '(?is)<title[^>]*>([^<]+)', 1)")} as title,
  {fx.unescape("regexp_extract(html, '(?s)<article><h1>([^<]+)', 1)")} as brand,
  list_transform(list_filter(regexp_extract_all({_BODY}, '(?s)(<div class="comment">)?<p>([^<]*)', 0),
    lambda x: x not like '<div%'), lambda x: {fx.unescape("substr(x, 4)")}) as ps,
  regexp_extract(html, '<span class="price">([^<]+)', 1) as price,
  list_transform(regexp_extract_all({_BODY}, '<img [^>]*>'), lambda t: {fx.attr('t', 'src')}) as srcs,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) as root,
  regexp_extract(url, '^https?://[^/?#]*(/([^?#]*/)?)', 1) as dir from fx_web),
absolute as (
 select *, list_transform(srcs, lambda s: case when regexp_matches(s, '^https?://') then s
  when s like '/%' then root || s else root || case when dir = '' then '/' else dir end || s end) as full_srcs
 from fields)"""


@query("rule_extract_fields", fx.sql(f"""
select page_id, {fx._host_id('host')} as seed_id, title, brand, {_DISTINCT.format(l='ps')} as description, price,
 full_srcs[1] as mainimageurl, array_to_string(full_srcs, ' ') as image_urls from absolute""", "fx_web", more=(_FIELDS,)))
def rule_extract_fields(spark, d):
    fields = R.extract_fields(_ruled(spark, d))
    return fields.select("page_id", "seed_id", "title", "brand", "description", "price", "mainimageurl",
                         F.array_join("image_urls", " ").alias("image_urls"))


_LIST_LINKS = ",\n".join((
    fx.tag_scan("a_tags", "fx_web", "a", "page_id, url, host, html"), """nav_links as (
 select page_id, url, host, pos, t, """ + fx.attr("t", "href") + """ as href,
  regexp_matches(html, '<li>' || regexp_replace(t, '([.?+*\\[\\]()|])', '\\\\\\1', 'g')) as in_list,
  t like '%id="more"%' as more from a_tags)""",
    """picked as (
 select page_id, url, host, href, case when in_list or more then 31 else 3 end as pagetype,
  case when in_list or more then 0 else 1 end as priority,
  row_number() over (partition by page_id, in_list or more order by pos) - 1 as pos from nav_links)""",
    fx.resolve_ctes("canon", "picked", "url", "href", "link", False)))


@query("rule_extract_links", fx.sql(f"""
select page_id, pagetype, priority, pos, href, link from canon where not regexp_matches(link, '{fx._VALID}')""",
    "fx_web", more=(_LIST_LINKS,)))
def rule_extract_links(spark, d):
    found = R.extract_list_links(_ruled(spark, d, fields=R.LIST_FIELDS))
    return found.select("page_id", "pagetype", "priority", "pos", "href", "link")


@query("page_link_counts", fx.sql(f"""
select page_id, count_if(pagetype = 31) as detail_links, count_if(pagetype = 3) as list_links
from canon where not regexp_matches(link, '{fx._VALID}') group by page_id""", "fx_web", more=(_LIST_LINKS,)))
def page_link_counts(spark, d):
    return L.link_counts(R.extract_list_links(_ruled(spark, d, fields=R.LIST_FIELDS)))


@query("page_rule_join", fx.sql(f"""
select p.page_id, p.seed_id, r.field, r.selector from (
 select page_id, {fx._host_id('host')} as seed_id from fx_pages) p join (
 select id as seed_id, unnest(['title_xpath', 'detailurl_xpath', 'nextpage_xpath', 'imageurl_xpath', 'brand_xpath',
  'description_xpath', 'price_xpath', 'mainimageurl_xpath']) as field, unnest([title_xpath, detailurl_xpath,
  nextpage_xpath, imageurl_xpath, brand_xpath, description_xpath, price_xpath, mainimageurl_xpath]) as selector
 from fx_seeds) r on p.seed_id = r.seed_id""", "fx_seeds"))
def page_rule_join(spark, d):
    pages = fx.fx_urls(spark, d).select("page_id", fx.seed_id(F.col("host")).alias("seed_id"))
    return pages.join(_rules(spark, d).filter(F.col("field").endswith("_xpath")), "seed_id")


@query("rule_as_of", fx.sql(f"""
select p.page_id, p.field, c.selector from (
 select page_id, {fx._host_id('host')} as seed_id, {fx.FETCHED} as fetched,
  unnest(['title_xpath', 'brand_xpath', 'price_xpath']) as field from fx_pages) p
asof join fx_rule_changes c on p.seed_id = c.seed_id and p.field = c.field and p.fetched >= c.since
where c.selector is not null""", "fx_pages", "fx_rule_changes"))
def rule_as_of(spark, d):
    """The rules in force when each page was fetched; the history is a stored table, as its size decides the join."""
    stored = f"{work_dir(spark, 'history')}/history"
    rule_history(fx.fx_rule_changes(spark, d)).write.parquet(stored)
    pages = fx.fx_urls(spark, d).select("page_id", fx.seed_id(F.col("host")).alias("seed_id"), F.expr(fx.FETCHED).alias("fetched"))
    ruled = with_rules_at(pages, spark.read.parquet(stored), "fetched")
    return ruled.select("page_id", F.explode("rules").alias("field", "selector"))


@query("main_image_clean", fx.sql("""
select page_id, coalesce(full_srcs[1], '') as main_image, array_to_string(list_distinct_in_order, ' ') as image_list
from (select *, list_filter(full_srcs, lambda x, i: list_position(full_srcs, x) = i) as list_distinct_in_order from absolute) t""",
    "fx_web", more=(_FIELDS,)))
def main_image_clean(spark, d):
    """Sources that the image rules of each page's seed match, cleaned; then once more as a page script writes them."""
    found = _ruled(spark, d, fields=("mainimageurl_xpath", "imageurl_xpath"))
    shown = F.concat(F.array(F.lit("")), F.transform(R.matches("mainimageurl_xpath"), lambda v: F.concat(F.lit("  "), v, F.lit(" "))))
    written = F.concat(F.transform(R.matches("imageurl_xpath"), lambda v: F.concat(F.lit("zoom('"), v, F.lit("','x')"))),
                       R.matches("imageurl_xpath"))
    return found.select("page_id", F.array_join(R.clean_main_image(F.col("url"), shown), "").alias("main_image"),
                        F.array_join(R.clean_image_list(F.col("url"), written), " ").alias("image_list"))


#: Selectors beyond child and descendant steps, and what SQL over the node table takes for each.
_AXES = {
    "title": "//li[last()]/a/@href", "brand": "//ul/li[position()<3]/a/text()", "color": "//a[not(@class)]/@href",
    "price": "//h1/following-sibling::p[1]/text()", "size": "(//a)[1]/@href", "productid": "//li/..//a[text()][last()]/text()",
    "description": "//p[b]/b/text() | //h1[count(../p) > 1]/text()", "category": "//article/p[position()=last()]/text()",
}
_AXES_SQL = """
n as materialized (select * from ({nodes}) w),
e as (
 select *, row_number() over (partition by page_id, parent_no, tag order by ord) as nth,
  count(*) over (partition by page_id, parent_no, tag) as many, row_number() over (partition by page_id, tag order by ord) as over_all
 from n where kind = 'elem'),
t as (select * from n where kind = 'text'),
href as (select *, regexp_extract(attrs, '"href":"([^"]*)"', 1) as href from e where attrs like '%"href":"%'),
taken as (
 select a.page_id, 'title' as field, a.ord, a.href as v from href a join e l on l.page_id = a.page_id and l.node_no = a.parent_no
  where a.tag = 'a' and l.tag = 'li' and l.nth = l.many
 union all select t.page_id, 'brand', t.ord, t.text from t join e a on a.page_id = t.page_id and a.node_no = t.parent_no and a.tag = 'a'
  join e l on l.page_id = a.page_id and l.node_no = a.parent_no and l.tag = 'li' and l.nth < 3
  join e u on u.page_id = l.page_id and u.node_no = l.parent_no and u.tag = 'ul'
 union all select page_id, 'color', ord, href from href where tag = 'a' and attrs not like '%"class":"%'
 union all select t.page_id, 'price', t.ord, t.text from t join e p on p.page_id = t.page_id and p.node_no = t.parent_no and p.tag = 'p'
  where exists (select 1 from e h where h.page_id = p.page_id and h.parent_no = p.parent_no and h.tag = 'h1' and h.ord < p.ord
   and not exists (select 1 from e q where q.page_id = p.page_id and q.parent_no = p.parent_no and q.tag = 'p' and q.ord > h.ord and q.ord < p.ord))
 union all select page_id, 'size', ord, href from href where tag = 'a' and over_all = 1
 union all select t.page_id, 'productid', t.ord, t.text from t join (
   select a.*, row_number() over (partition by a.page_id, a.parent_no order by a.ord desc) as back
   from e a where a.tag = 'a' and exists (select 1 from t s where s.page_id = a.page_id and s.parent_no = a.node_no)) a
  on a.page_id = t.page_id and a.node_no = t.parent_no and a.back = 1
  where exists (select 1 from up where up.page_id = a.page_id and up.node_no = a.node_no and up.above in (
   select l.parent_no from e l where l.page_id = a.page_id and l.tag = 'li'))
 union all select t.page_id, 'description', t.ord, t.text from t join e b on b.page_id = t.page_id and b.node_no = t.parent_no and b.tag = 'b'
  join e p on p.page_id = b.page_id and p.node_no = b.parent_no and p.tag = 'p'
 union all select t.page_id, 'description', t.ord, t.text from t join e h on h.page_id = t.page_id and h.node_no = t.parent_no and h.tag = 'h1'
  where (select count(*) from e p where p.page_id = h.page_id and p.parent_no = h.parent_no and p.tag = 'p') > 1
 union all select t.page_id, 'category', t.ord, t.text from t join e p on p.page_id = t.page_id and p.node_no = t.parent_no
  join e a on a.page_id = p.page_id and a.node_no = p.parent_no and a.tag = 'article'
  where p.tag = 'p' and p.nth = p.many)
select page_id, field, count(*) as n, string_agg({value}, ' ' order by ord) as taken from taken group by page_id, field"""


def _axes_oracle():
    """The node table's SQL with the selectors' parts behind it, as one statement."""
    walk, last = _NODE_WALK.rsplit("\nselect w.page_id, w.i as ord", 1)
    nodes = "select w.page_id, w.i as ord" + last
    parts = _AXES_SQL.format(nodes=nodes, value=fx.unescape("v"))
    up = "up(page_id, node_no, above) as (select page_id, node_no, parent_no from n where kind = 'elem' union all " \
         "select up.page_id, up.node_no, n.parent_no from up join n on n.kind = 'elem' and n.page_id = up.page_id and n.node_no = up.above)"
    head, rest = parts.split("e as (", 1)
    return f"{walk},{head}{up},\ne as ({rest}"


@query("rule_axes", _axes_oracle())
def rule_axes(spark, d):
    """What selectors with axes, positions from the end, groups and conditions on children take from every page."""
    each = F.explode(F.array(*(F.struct(F.lit(f"{f}_xpath").alias("field"), F.lit(s).alias("selector")) for f, s in _AXES.items())))
    rules = fx.fx_seeds(spark, d).select(F.col("id").alias("seed_id"), each.alias("r")).select("seed_id", "r.*")
    pages = fx.fx_pages(spark, d).withColumn("seed_id", fx.seed_id(F.col("host")))
    found = R.parse_for_rules(R.with_rules(pages, R.seed_rules(rules)), ("page_id",), [f"{field}_xpath" for field in _AXES], nodes=False)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), R.matches(f"{f}_xpath").alias("m")) for f in _AXES)))
    return found.select("page_id", each.alias("f")).filter("size(f.m) > 0").select(
        "page_id", "f.field", F.size("f.m").cast("bigint").alias("n"), F.array_join("f.m", " ").alias("taken"))


# Some pages lose their images, some their prices.
_BARE = """page_id, url, host, case when page_id % 3 = 1 then replace(html, '<img ', '<hr ') else html end as html"""
_BARER = """page_id, url, host, case when page_id % 4 = 1 then replace(html, 'class="price"', 'class="none"') else html end as html"""


@query("page_routing", fx.sql(f"""
select page_id, pagetype, case pagetype when 3 then 'list' when 31 then 'detail' else 'ignore' end as route,
 case when regexp_matches({_BODY}, '<img ') then 'store' when regexp_matches(html, '(?i)<title[^>]*>[^<]')
  and regexp_matches({_BODY}, '<span class="price">[^<]') then 'retry' else 'drop' end as outcome
from (select *, case when url like '%.html' then 31 when url like '%/' then 3 else 2 end as pagetype
 from (select {_BARER} from (select {_BARE} from fx_web) a) b) c""", "fx_web"))
def page_routing(spark, d):
    """Route of each page, and its outcome from what the rules of its seed match."""
    pages = fx.fx_web(spark, d).selectExpr(*fx._split_columns(_BARE)).selectExpr(*fx._split_columns(_BARER))
    fields = R.extract_fields(_ruled(spark, d, pages))
    hits = F.array_repeat(F.lit(1), F.col("title_hits")), F.array_repeat(F.lit(1), F.col("price_hits"))
    kind = F.when(F.col("url").endswith(".html"), 31).when(F.col("url").endswith("/"), 3).otherwise(2)
    return L.route(fields.withColumn("pagetype", kind)).select(
        "page_id", "pagetype", "route", L.detail_outcome(F.col("main_images"), *hits).alias("outcome"))


@query("ordered_distinct", fx.sql("""
select page_id, array_to_string(list_filter(l, lambda x, i: x <> '' and list_position(l, x) = i), ' ') as words from (
 select page_id, array_agg(href order by pos) as l from raw_links group by page_id) t""", "raw_links"))
def ordered_distinct_query(spark, d):
    pages = fx.fx_pages(spark, d)
    return pages.select("page_id", F.array_join(ordered_distinct(L.hrefs(F.col("html"))), " ").alias("words"))


@query("ordered_concat", f"""
select page_id, {fx.unescape("array_to_string(regexp_extract_all(html, '<p>([^<]+)', 1), '')")} as text from pages""")
def ordered_concat(spark, d):
    parsed = N.parse(fx.fx_pages(spark, d), ("page_id",))
    parts = F.filter("nodes", lambda n: (n["kind"] == "text") & (n["tag"] == "p"))
    return parsed.select("page_id", decode_entities(F.array_join(F.transform(parts, lambda n: n["text"]), "")).alias("text"))


@query("date_mentions", fx.sql("select page_id, node_no, date from fx_dates where date is not null", "fx_dates"))
def date_mentions(spark, d):
    return I.date_mentions(N.parse(fx.fx_web(spark, d)))


@query("image_extract", fx.sql("""
select page_id, url, src, alt, '2024-01-31' as postdate, row_number() over (partition by page_id order by node_no) - 1 as pos
from fx_shown""", "fx_shown"))
def image_extract(spark, d):
    return I.images_as_of(fx.fx_web(spark, d), F.lit("2024-01-31"))


@query("image_nearest_date", fx.sql("""
select page_id, url, node_no, src, alt, coalesce((select d.date from fx_dates d where d.page_id = i.page_id
 and d.date is not null order by abs(d.node_no - i.node_no), d.node_no limit 1), '') as postdate
from fx_shown i""", "fx_shown", "fx_dates"))
def image_nearest_date(spark, d):
    parsed = N.parse(fx.fx_web(spark, d))
    return I.dated_images(parsed, I.images_of(F.col("nodes")), I.dates_of(F.col("nodes")))


@query("image_first_seen", fx.sql("""
select photo_sha1, page_id, src from (
 select sha1(src) as photo_sha1, page_id, src,
  row_number() over (partition by src order by page_id, node_no) as n from fx_shown) t where n = 1""", "fx_shown"))
def image_first_seen(spark, d):
    shown = I.images(N.parse(fx.fx_web(spark, d)))
    return I.first_page_of_image(shown, ["page_id", "node_no"]).select("photo_sha1", "page_id", "src")


@query("image_quality_gate", fx.sql("""
select page_id, src, width, height from fx_images where width >= 200 and height >= 200
 and cast(width as double) / height <= 3.5 and cast(height as double) / width <= 3.5""", "fx_images"))
def image_quality_gate(spark, d):
    return I.image_gate(fx.fx_images(spark, d)).drop("url")
