"""Text column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# Marks that become one space each.
MARKS = "`~!@#$%^&*()_+-={[}]|:;'\"<,>./\\•"

_COMMON = ("amp", "lt", "gt", "quot", "nbsp")
_ENTITY_MAP = " ".join(f"{n}:{chr(name2codepoint[n])}" for n in
                       [*_COMMON, *(n for n in name2codepoint if n not in _COMMON)])


def each(items: Column, body: str) -> Column:
    """``transform`` with its lambda as SQL text, such as "x -> upper(x)".

    A long expression built from single function calls costs a JVM round trip per call; as text it
    costs one. The lambda variable is computed once, however often the body uses it.
    """
    return F.call_function("transform", items, F.expr(body))


def let(value: Column, body: str) -> Column:
    """``body`` (SQL lambda text) applied to one value."""
    return F.get(each(F.array(value), body), F.lit(0))


def erase_marks(text: Column) -> Column:
    return F.translate(text, MARKS, " " * len(MARKS))


def remove_space(text: Column) -> Column:
    """Drop ASCII white space (a non-breaking space stays)."""
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", "")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def first_quoted(text: Column) -> Column:
    """What stands in the first pair of single quotes, else the text itself."""
    return F.when(text.rlike(r"'[^'\n]*'"), F.regexp_extract(text, r"'([^'\n]*)'", 1)).otherwise(text)


def first_nonempty(items: Column) -> Column:
    """Array of at most one element: the first that is neither null nor empty."""
    return F.slice(F.filter(items, lambda x: x.isNotNull() & (x != "")), 1, 1)


def ordered_distinct(items: Column) -> Column:
    """Distinct non-empty elements in order of first appearance."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def flat_distinct(lists: Column) -> Column:
    """:func:`ordered_distinct` over an array of arrays."""
    return ordered_distinct(F.flatten(F.filter(lists, lambda x: x.isNotNull())))


def _code_point(digits: str, radix: int) -> str:
    code = f"cast(conv({digits}, {radix}, 10) as bigint)"
    return (f"case when {code} between 1 and 1114111 and {code} not between 55296 and 57343 "
            f"then decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') else p end")


# Splits at references, replaces each once, left to right; unknown names stay as written.
DECODE = rf"""t -> case when not contains(t, '&') then t else array_join(transform(
  regexp_extract_all(t, r'&#?[a-zA-Z0-9]+;|[^&]+|&', 0), p -> case
   when p rlike r'^&#[xX]0*[0-9a-fA-F]{{1,6}};$' then {_code_point("regexp_extract(p, '^&#[xX]0*([0-9a-fA-F]+);$', 1)", 16)}
   when p rlike r'^&#0*[0-9]{{1,7}};$' then {_code_point("regexp_extract(p, '^&#0*([0-9]+);$', 1)", 10)}
   when p rlike r'^&[a-zA-Z][a-zA-Z0-9]*;$' then coalesce(try_element_at(
     str_to_map('{_ENTITY_MAP}', ' ', ':'), substr(p, 2, length(p) - 2)), p)
   else p end), '') end"""


def decode_all(texts: Column) -> Column:
    """:func:`decode_entities` for an array."""
    return each(texts, DECODE)


def decode_entities(text: Column) -> Column:
    """Replace character references, named and numeric."""
    return let(text, DECODE)
