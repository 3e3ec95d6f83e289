"""Spans of text as SQL: every match of a pattern with its place in code points."""

from __future__ import annotations

from collections.abc import Sequence

NONE = "cast(array() as array<struct<kind: int, start: int, end: int, found: string>>)"


def quoted(text: str) -> str:
    """A pattern as a raw SQL string."""
    return "r'" + text.replace("'", r"\x27") + "'"


def matches(text: str, pattern: str, kind: int) -> str:
    """SQL of array<struct<kind, start, end, found>>: the leftmost non-overlapping matches of ``pattern``.

    ``regexp_extract_all`` and ``split`` walk the same matches; the pieces between and the matches
    themselves, taken in turn, give each match's start in code points. Texts without a match are
    read once. ``pattern`` must not match the empty string; null texts have no matches.
    """
    return f"""element_at(transform(array(regexp_extract_all(coalesce({text}, ''), {quoted(pattern)}, 0)),
      all -> case when size(all) = 0 then {NONE} else aggregate(
        zip_with(all, split({text}, {quoted(pattern)}, -1), (found, gap) -> named_struct('found', found, 'gap', gap)),
        named_struct('at', 0, 'spans', {NONE}),
        (acc, x) -> case when x.found is null then acc else named_struct(
          'at', acc.at + char_length(x.gap) + char_length(x.found),
          'spans', concat(acc.spans, array(named_struct('kind', {kind}, 'start', acc.at + char_length(x.gap),
            'end', acc.at + char_length(x.gap) + char_length(x.found), 'found', x.found)))) end,
        acc -> acc.spans) end), 1)"""


def between(text: str, pattern: str) -> str:
    """SQL of array<struct<start, found>>: what stands before, between and after the matches of ``pattern``."""
    none = "cast(array() as array<struct<start: int, found: string>>)"
    return f"""aggregate(
      zip_with(split({text}, {quoted(pattern)}, -1), regexp_extract_all({text}, {quoted(pattern)}, 0),
        (gap, hit) -> named_struct('gap', gap, 'hit', coalesce(hit, ''))),
      named_struct('at', 0, 'parts', {none}),
      (acc, x) -> named_struct('at', acc.at + char_length(x.gap) + char_length(x.hit),
        'parts', concat(acc.parts, array(named_struct('start', acc.at, 'found', x.gap)))),
      acc -> acc.parts)"""


def apart(spans: str, others: str, same_kind: bool) -> str:
    """SQL of the ``spans`` that overlap none of ``others`` (of their own kind)."""
    kind = "o.kind = s.kind and " if same_kind else ""
    return f"filter({spans}, s -> not exists({others}, o -> {kind}o.start < s.end and s.start < o.end))"


def ordered(spans: str, first: str, second: str) -> str:
    """SQL of ``spans`` sorted by the fields ``first``, then ``second`` (start or kind), without their text."""
    return (f"array_sort(transform({spans}, s -> named_struct('{first}', s.{first}, '{second}', s.{second}, 'end', s.end)))")


def written(spans: str, kinds: Sequence[str]) -> str:
    """SQL of ``kind:start:end`` of each span in order, comma-joined."""
    names = ", ".join(f"'{k}'" for k in kinds)
    return (f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', "
            f"cast(s.start as string), ':', cast(s.end as string))), ',')")


def count_kind(spans: str, kind: int) -> str:
    return f"cast(size(filter({spans}, s -> s.kind = {kind})) as bigint)"
