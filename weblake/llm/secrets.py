"""Secrets in texts: fixed forms, and strings of high entropy in a sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weblake.llm.common import free_names
from weblake.llm.spans import apart, between, count_kind, matches, ordered, quoted, written

KINDS = ("assign", "access", "hex", "entropy")

# The forms that a secret is known by.
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]"
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"

#: Runs that the entropy window slides over.
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Class, what its strings look like, and the bits a character from which a window counts as random.
CLASSES = (
    ("hex", "^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0),
    ("upper", "^(?=.*[0-9].*[0-9])(?=.*[A-Z])[A-Z0-9]+$", 3.5),
    ("mixed", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*$", 3.7),
    ("lower", "^(?=.*[0-9].*[0-9].*[0-9])(?=.*[a-z])[a-z0-9_=-]+$", 3.6),
)
# What is random by its letters and yet no secret.
ALLOWED = (
    "(?i:example|sample|dummy|placeholder|changeme|redacted|xxxx)",
    "(?<![0-9a-fA-F-])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F-])",
    "0123456789|abcdefghij|ABCDEFGHIJ",
)


def base_spans(text: str) -> str:
    """SQL of the fixed forms. Matches are found first and dropped by length after, without a retry."""
    assign = f"""filter({matches(text, ASSIGN_HEAD + ASSIGN_VALUE + '+', 0)},
      s -> char_length(regexp_extract(s.found, {quoted('^' + ASSIGN_HEAD + '(' + ASSIGN_VALUE + '+)$')}, 1)) >= 6)"""
    return f"concat({assign}, {matches(text, ACCESS, 1)}, {matches(text, HEX, 2)})"


def windows(found: str) -> str:
    """SQL of struct<bits, first, last>: the largest entropy of a window of ``found``, and the first start and
    last end (0-based) of the windows at or over the string's class threshold ``limit``.

    The sum of n log n over the characters' counts n changes by two terms as the window moves on.
    """
    def term(n):
        return f"(case when {n} > 0 then {n} * log2({n}) else 0d end)"

    def count(string, char):
        return f"(char_length({string}) - char_length(replace({string}, {char}, '')))"

    limit = " ".join(f"when {found} rlike {quoted(form)} then {bits}d" for _, form, bits in CLASSES)
    return f"""aggregate(sequence(1, char_length({found})),
      named_struct('sum', 0d, 'limit', case {limit} end, 'first', -1, 'last', -1),
      (acc, i) -> element_at(transform(array(named_struct(
          'added', {count(f"substring({found}, greatest(i - {WINDOW}, 1), least(i - 1, {WINDOW}))", f"substring({found}, i, 1)")},
          'gone', case when i > {WINDOW} then {count(f"substring({found}, i - {WINDOW}, {WINDOW} + 1)", f"substring({found}, i - {WINDOW}, 1)")} else 0 end)),
        c -> element_at(transform(array(acc.sum + {term('(c.added + 1)')} - {term('c.added')}
            + case when c.gone > 0 then {term('(c.gone - 1)')} - {term('c.gone')} else 0d end),
          total -> named_struct('sum', total, 'limit', acc.limit,
            'first', case when acc.first < 0 and i >= {WINDOW} and log2({WINDOW}) - total / {WINDOW} >= acc.limit then i - {WINDOW} else acc.first end,
            'last', case when i >= {WINDOW} and log2({WINDOW}) - total / {WINDOW} >= acc.limit then i else acc.last end)), 1)), 1))"""


def entropy_spans(text: str) -> str:
    """SQL of the candidate strings, cut to their random windows; classless strings have none.

    What the allow-list names suppresses the windows that overlap it and no others: the window slides
    over each stretch between two listed parts by itself.
    """
    known = " or ".join(f"s.found rlike {quoted(form)}" for _, form, _ in CLASSES)
    free = f"""flatten(transform({matches(text, CANDIDATE, 3)}, c -> transform(
      filter({between('c.found', '|'.join(ALLOWED))}, p -> char_length(p.found) >= {WINDOW}),
      p -> named_struct('kind', c.kind, 'start', c.start + p.start, 'found', p.found))))"""
    cut = f"""transform(filter({free}, s -> {known}),
      s -> element_at(transform(array({windows('s.found')}), w -> named_struct('kind', s.kind, 'start', s.start + w.first,
        'end', s.start + w.last, 'found', case when w.first >= 0 then substring(s.found, w.first + 1, w.last - w.first) end)), 1))"""
    return f"filter({cut}, s -> s.found is not null)"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base and spans, arrays of struct<start, kind, end> ordered by start, then kind.

    ``base`` has the fixed forms, ``spans`` also the random strings that overlap none of them. Null
    and empty texts have empty arrays; repeated rows are scanned each by itself, an empty table gives no
    rows; existing columns base and spans are replaced.
    """
    kept, more = free_names(docs.columns, "base_found", "more_found")
    base = docs.withColumn(kept, F.expr(base_spans(text))).withColumn(more, F.expr(entropy_spans(text)))
    return base.withColumns({
        "base": F.expr(ordered(kept, "start", "kind")),
        "spans": F.expr(ordered(f"concat({kept}, {apart(more, kept, False)})", "start", "kind")),
    }).drop(kept, more)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, hash and text form of the spans of :func:`scan`."""
    return scanned.select("doc_id", *(F.expr(count_kind("base", i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
                          F.sha2(F.expr(written("base", KINDS)), 256).alias("base_sha256"),
                          F.expr(written("spans", KINDS)).alias("spans"))
