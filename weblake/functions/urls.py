"""URL column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weblake.functions.text import each


def url_sha1(url: Column) -> Column:
    """The key of a page or image: lower-case hex SHA-1 of the URL."""
    return F.sha1(url)


def domain(url: Column) -> Column:
    """Host with user and port. Without http(s) scheme: up to the first "/", or "?" when there is no "/"."""
    has_scheme = url.startswith("http://") | url.startswith("https://")
    bare = F.when(url.contains("/"), F.substring_index(url, "/", 1)).otherwise(
        F.substring_index(url, "?", 1))
    return F.when(has_scheme, F.regexp_extract(url, r"^https?://([^/?#]*)", 1)).otherwise(bare)


def strip_slash(url: Column) -> Column:
    """Drop one trailing "/"."""
    return F.regexp_replace(url, r"/$", "")


def add_www(url: Column) -> Column:
    """Put "www." in front of the host; "http://www", "https://www" and "wwww" starts stay as they are."""
    done = url.startswith("http://www") | url.startswith("https://www") | url.startswith("wwww")
    return F.when(done, url).otherwise(F.regexp_replace(url, r"^(.*?)//", "$1//www."))


# x.b: URL of the page, x.r: link. The cases of RFC 3986, section 5.2.2, as head, path and tail; a link
# that names its host stays as written.
_SPLIT = r"""x -> case
  when x.r = '' then named_struct('head', regexp_extract(x.b, '^[^#]*', 0), 'path', '', 'tail', '')
  when x.r rlike '^[a-zA-Z][a-zA-Z0-9+.-]*:' then named_struct('head', x.r, 'path', '', 'tail', '')
  when startswith(x.r, '//') then named_struct('head', concat(regexp_extract(x.b, '^[^:/?#]*:', 0), x.r),
    'path', '', 'tail', '')
  when startswith(x.r, '/') then named_struct('head', regexp_extract(x.b, '^[^:/?#]*://[^/?#]*', 0),
    'path', regexp_extract(x.r, '^[^?#]*', 0), 'tail', regexp_extract(x.r, '(?s)^[^?#]*(.*)$', 1))
  when startswith(x.r, '?') then named_struct('head', concat(regexp_extract(x.b, '^[^?#]*', 0), x.r),
    'path', '', 'tail', '')
  when startswith(x.r, '#') then named_struct('head', concat(regexp_extract(x.b, '^[^#]*', 0), x.r),
    'path', '', 'tail', '')
  else named_struct('head', regexp_extract(x.b, '^[^:/?#]*://[^/?#]*', 0),
    'path', concat('/', regexp_extract(x.b, '^[^:/?#]*://[^/?#]*/([^?#]*/)?', 1), regexp_extract(x.r, '^[^?#]*', 0)),
    'tail', regexp_extract(x.r, '(?s)^[^?#]*(.*)$', 1)) end"""
# "." and ".." go, a surplus ".." is dropped.
_JOIN = r"""u -> concat(u.head, case when u.path rlike r'/\.\.?(?:/|$)' then concat(aggregate(
    split(substr(u.path, 2), '/'), '', (done, part) -> case part when '.' then done
      when '..' then regexp_replace(done, '/[^/]*$', '') else concat(done, '/', part) end),
    case when u.path rlike r'/\.\.?$' then '/' else '' end) else u.path end, u.tail)"""


def resolve(base: Column, ref: Column) -> Column:
    """Resolve a link against the URL of its page; an empty fragment is removed."""
    pair = F.array(F.struct(base.alias("b"), F.regexp_replace(ref, r"#$", "").alias("r")))
    return F.get(each(each(pair, _SPLIT), _JOIN), F.lit(0))


def image_url(base: Column, src: Column) -> Column:
    """Absolute image URL: http(s) sources stay as written, others are resolved."""
    absolute = src.startswith("http://") | src.startswith("https://")
    return F.when(src.isNull() | (src == "") | absolute, src).otherwise(resolve(base, src))
