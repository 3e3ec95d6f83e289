"""HTML column expressions: everything that needs no element tree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weblake.functions.text import decode_all, decode_entities

# Inside a tag a quote only counts after "="; ">" within a quoted value does not end the tag. A "<" outside
# quotes gives the tag up at once, so that a row of unfinished tags costs one look each.
_TAG_REST = r"""(?:[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+>"""
_OPAQUE = (rf"!--.*?(?:-->|\z)|script\b{_TAG_REST}.*?(?:</script\s*>|\z)"
           rf"|style\b{_TAG_REST}.*?(?:</style\s*>|\z)")
TOKEN = (rf"(?is)<(?:{_OPAQUE}|[!?][^<>]*+>|/[a-z][^<>]*+>|[a-z]{_TAG_REST})"
         r"|(?:[^<]++|<(?![a-z/!?]))++")
_ATTRIBUTE = r"""[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?+"""


def tokens(html: Column) -> Column:
    """Array of tokens: comments, script and style elements, tags, text."""
    return F.regexp_extract_all(html, F.lit(TOKEN), 0)


def token_kind(token: Column) -> Column:
    low = F.lower(F.substring(token, 1, 8))
    return (F.when(token.startswith("<!--"), "comment")
             .when(low.rlike(r"^<script\b"), "script")
             .when(low.rlike(r"^<style\b"), "style")
             .when(low.rlike(r"^<[!?]"), "declaration")
             .when(low.rlike(r"^</[a-z]"), "end")
             .when(low.rlike(r"^<[a-z]"), "start")
             .otherwise("text"))


def token_tag(token: Column) -> Column:
    """Lower-case tag name, "" for text, comments and declarations."""
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9:_-]*)", 1))


def start_tags(html: Column, tag: str) -> Column:
    """Raw start tags of one element name, in document order; comments, scripts and styles are skipped."""
    pattern = rf"(?is)<(?:{_OPAQUE}|{tag}(?=[\s/>]){_TAG_REST})"
    return F.filter(F.regexp_extract_all(html, F.lit(pattern), 0),
                    lambda t: t.rlike(rf"(?i)^<{tag}[\s/>]"))


def attributes(start_tags: Column, name: str) -> Column:
    """Decoded value of the named attribute of each tag; null where a tag has none with a value."""
    before = rf"(?is)^<[a-z][^\s/>]*+[\s/]*+(?:(?!{name}[\s=/>]){_ATTRIBUTE}[\s/]*+)*+{name}"
    value = rf"""{before}(\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++))"""
    raw = F.transform(start_tags, lambda t: F.regexp_extract(t, value, 1))
    bare = F.transform(raw, lambda v: F.when(v != "", F.regexp_replace(
        v, r"""(?s)^\s*=\s*(?:"(.*)"|'(.*)'|(.*))$""", "$1$2$3")))
    return decode_all(bare)


def title(html: Column) -> Column:
    """First non-empty text of a title element, or ""."""
    pattern = rf"(?is)<(?:{_OPAQUE}|title(?=[\s/>]){_TAG_REST}[^<]++)"
    found = F.filter(F.regexp_extract_all(html, F.lit(pattern), 0), lambda t: t.rlike(r"(?i)^<title"))
    text = F.regexp_extract(F.get(found, F.lit(0)), rf"(?is)^<title{_TAG_REST}(.*)$", 1)
    return F.coalesce(decode_entities(text), F.lit(""))
