"""Personal data: fixed forms, and candidate spans that boosted trees judge by format and context."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from weblake.llm.common import free_names
from weblake.llm.spans import apart, count_kind, matches, ordered, written
from weblake.session import Work

KINDS = ("email", "ip", "card", "phone")

# The forms. A look-behind keeps a start inside a run from being tried, save where the
# match before ended; no pattern loops over groups without a bound, so long texts use no deep stack.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@(?={LABEL}++\.{LABEL})[A-Za-z0-9.-]+?(?!{LABEL})(?!\.{LABEL})"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: What may be personal data of each kind, in many more forms than are certain to be.
LETTER = r"\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{M}0-9"
GENERATORS = (
    rf"(?<![{LETTER}._%+'-])[{LETTER}._%+'-]{{1,64}}@[{LETTER}-]{{1,63}}(?:\.[{LETTER}-]{{1,63}}){{1,8}}",
    r"(?<![0-9])[0-9]{1,4}(?:\[?[.,]\]?[0-9]{1,4}){2,4}(?![0-9])",
    r"(?<![0-9])(?<![0-9][ ./_-])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![0-9])",
    r"(?<![0-9+])[+(]?[0-9][ ()./0-9-]{6,24}[0-9](?![0-9])",
)
#: Words that announce each kind, and those that announce other numbers.
CUES = (
    "e-?mail|mail|correo|courriel|contact|kontakt|write|escrib|adresse?|address",
    "ip|host|server|servidor|serveur|ping|address|adresse",
    "card|visa|mastercard|amex|credit|karte|tarjeta|carte",
    "call|tel|phone|mobile|cell|fax|whatsapp|anruf|handy|mobil|llam|m[oó]vil|appel|portable",
)
OTHER = "order|invoice|room|isbn|issn|sku|ref|part|item|model|serial|version|bestell|rechnung|pedido|factura|commande|facture"
LEAD = 24
CONTEXT = 12


def base_spans(text: str) -> str:
    """SQL of the fixed forms, by kind, then start. Matches are found first and dropped after, without a retry."""
    return f"""case when {text} rlike '[@0-9]' then concat({matches(text, EMAIL, 0)},
      filter({matches(text, IP, 1)}, s -> s.found rlike r'^{OCTET}(?:\\.{OCTET}){{3}}$'),
      filter({matches(text, CARD, 2)}, s -> luhn_check(translate(s.found, ' -', ''))),
      filter({matches(text, PHONE, 3)}, s -> char_length(translate(s.found, '+ ().-', '')) between 9 and 15))
      else {matches("''", "x", 0)} end"""


def candidate_spans(text: str) -> str:
    """SQL of the candidates of every kind; those of different kinds may overlap."""
    return f"""case when {text} rlike '[@0-9]' then concat({', '.join(matches(text, g, k) for k, g in enumerate(GENERATORS))})
      else {matches("''", "x", 0)} end"""


def well_formed(span: str = "c") -> str:
    """SQL of the candidates that are of their kind once gaps and alphabets are normalised.

    Numbers of the wrong length or sum are no cards, whatever stands around them. A phone number has a
    country or trunk prefix, an area code in parentheses, or groups of 3, 3 and 4 digits.
    """
    found = f"{span}.found"
    digits = f"regexp_replace({found}, '[^0-9]', '')"
    return f"""case {span}.kind
      when 0 then {found} rlike r'^[^._%+\\x27-].*\\.[{LETTER}]*[^0-9.@-]{{2}}$'
      when 1 then regexp_replace({found}, r'\\[?[.,]\\]?', '.') rlike r'^{OCTET}(?:\\.{OCTET}){{3}}$'
      when 2 then {found} rlike r'^[0-9]{{4}}(?:[ ./_-]{{1,2}}[0-9]{{2,7}}){{2,5}}$' and luhn_check({digits})
      else char_length({digits}) between 9 and 15 and {found} rlike '[0-9][ ()./-]+[0-9]'
        and not {found} rlike r'^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}'
        and {found} rlike r'^(?:\\+[1-9]|00[1-9]|\\(?0[1-9]|\\([0-9]{{2,5}}\\)|[2-9][0-9]{{2}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}$)' end"""


def features(text: str, span: str = "c", base: str = "base") -> dict[str, str]:
    """SQL of the numbers that the trees see of a span: its surroundings only, as far as they hold for every kind.

    Nothing here tells a fixed form from a missed one, so what is learned of the former holds for the latter.
    """
    before = f"substring({text}, greatest({span}.start - {CONTEXT - 1}, 1), least({span}.start, {CONTEXT}))"
    after = f"substring({text}, {span}.end + 1, {CONTEXT})"
    lead = f"substring({text}, greatest({span}.start - {LEAD - 1}, 1), least({span}.start, {LEAD}))"
    cues = " ".join(f"when {k} then r'(?iU)(?<!\\p{{L}})(?:{words})[^\\n]*$'" for k, words in enumerate(CUES))
    near = f"{base}, b -> b.end <= {span}.start and b.end > {span}.start - 200 or b.start >= {span}.end and b.start < {span}.end + 200"
    number = {
        "own_cue": f"{lead} rlike case {span}.kind {cues} end",
        "other_cue": f"{lead} rlike r'(?iU)(?<!\\p{{L}})(?:{OTHER})[^\\n]*$'",
        "line_start": f"{before} = '' or {before} rlike r'\\n\\s*$'",
        "open_before": f"{before} = '' or {before} rlike r'[\\s(\\[<,;:]$'",
        "open_after": f"{after} = '' or {after} rlike r'^[\\s)\\]>,;:.!?]'",
        "digits_before": f"char_length(regexp_replace({before}, '[^0-9]', ''))",
        "letters_before": f"char_length(regexp_replace({before}, '[^A-Za-z]', ''))",
        "digits_after": f"char_length(regexp_replace({after}, '[^0-9]', ''))",
        "near_base": f"size(filter({near}))",
    }
    return {name: f"coalesce(cast({sql} as double), 0d)" for name, sql in number.items()}


@dataclass(frozen=True)
class SpanModel:
    """Boosted trees as SQL over a struct of features, with a threshold for each kind; empty: takes nothing."""

    margin: str
    thresholds: tuple[float, ...]

    def score(self, struct: str) -> str:
        return f"(1d / (1d + exp(-2d * ({self.margin.replace('$', struct)}))))"


def _tree_sql(node, names: list[str]) -> str:
    if node.subtreeDepth() == 0:
        return f"{node.prediction()!r}d"
    split = node.split()
    left, right = _tree_sql(node.leftChild(), names), _tree_sql(node.rightChild(), names)
    return f"(case when $.{names[split.featureIndex()]} <= {split.threshold()!r}d then {left} else {right} end)"


def counted_candidates(docs: DataFrame) -> DataFrame:
    """All candidates of ``docs`` as counted rows: kind, label, the columns of :func:`features`, whether they are of the fifth ``left_out``, n.

    What is learned depends on a candidate's numbers alone, and these are counts and tests of a few characters
    around it: the table has a row per combination that occurs, however many candidates there are.
    """
    rows = docs.filter("text rlike '[@0-9]'").select(
        "doc_id", "text", F.expr(base_spans("text")).alias("base"), F.explode(F.expr(candidate_spans("text"))).alias("c"))
    rows = rows.select("doc_id", "c", "text", "base", F.expr("exists(base, b -> b.kind = c.kind and b.start < c.end and c.start < b.end)")
                       .cast("double").alias("label"), F.xxhash64("doc_id", "c.start", "c.kind").alias("place"))
    rows = rows.filter("label = 1 or not exists(base, b -> b.start < c.end and c.start < b.end)")
    numbers = rows.select(F.expr("pmod(place, 5) = 0").alias("left_out"), F.col("c.kind").alias("kind"), "label",
                          *(F.expr(sql).alias(n) for n, sql in features("text").items()))
    return numbers.groupBy(*numbers.columns).agg(F.count("*").cast("double").alias("n"))


def fit(docs: DataFrame, trees: int = 10, depth: int = 3, share: float = 0.5) -> SpanModel:
    """Train on the candidates of all documents, as :func:`counted_candidates` weighs them.

    A candidate is known where a fixed form of its kind overlaps it; the others are not negative but
    unlabelled, save those that overlap a fixed form of another kind, which are left out. The trees learn
    on four fifths of the candidates how likely a span in such surroundings is to be known. The mean of that
    over the known ones of the last fifth is the rate at which personal data gets known (Elkan and Noto), so
    a kind's threshold is ``share`` of its mean, or of the mean of all kinds where it has none. Without
    both classes the model takes nothing.
    """
    work = Work(docs.sparkSession, "pii")
    names = list(features("text"))
    every = counted_candidates(docs)
    counted = work.table("candidates", every.orderBy(*(c for c in every.columns if c != "n")))
    train = VectorAssembler(inputCols=names, outputCol="features").transform(counted.filter("not left_out"))
    seen = {row.label: row["count"] for row in train.groupBy("label").count().collect()}
    if len(seen) < 2:
        return SpanModel("0d", ())
    # Splits are looked for among all rows, not a sample, where the square of maxBins is no less than the rows.
    bins = max(32, isqrt(sum(seen.values())) + 1)
    model = GBTClassifier(labelCol="label", weightCol="n", maxIter=trees, maxDepth=depth, maxBins=bins, seed=42, cacheNodeIds=False).fit(train)
    margin = " + ".join(f"{w!r}d * {_tree_sql(t._call_java('rootNode'), names)}" for w, t in zip(model.treeWeights, model.trees))
    draft = SpanModel(margin, ())
    known = counted.filter("left_out and label = 1").select("kind", "n", F.struct(*names).alias("f"))
    means = {r.kind: r.mean for r in known.rollup("kind").agg(F.expr(f"sum(n * {draft.score('f')}) / sum(n)").alias("mean")).collect()}
    thresholds = [2.0 if means.get(None) is None else share * means.get(kind, means[None]) for kind in range(len(KINDS))]
    return SpanModel(margin, tuple(thresholds))


def beyond(text: str, base: str) -> str:
    """SQL of the well-formed candidates outside the fixed forms of any kind. Of an address of which a fixed
    form covers a part, as its other letters are not ASCII, the pieces before and after that part remain."""
    part = f"filter({base}, b -> b.kind = 0 and c.kind = 0 and b.start < c.end and c.start < b.end)"
    pieces = f"""flatten(transform(filter({candidate_spans(text)}, c -> {well_formed()} and (c.kind > 0 or c.found rlike r'[^\x00-\x7F]')),
      c -> element_at(transform(array({part}), p -> case when size(p) = 0 then array(c) else array(
        named_struct('kind', c.kind, 'start', c.start, 'end', array_min(p.start), 'found', c.found),
        named_struct('kind', c.kind, 'start', array_max(p.end), 'end', c.end, 'found', c.found)) end), 1)))"""
    return apart(f"filter({pieces}, c -> c.start < c.end)", base, False)


def find(docs: DataFrame, model: SpanModel | None = None, text: str = "text") -> DataFrame:
    """``docs`` with base and spans, arrays of struct<kind, start, end> by kind, then start.

    ``base`` has the fixed forms; ``spans`` also what :func:`beyond` adds to them where the model takes it.
    Null and empty texts have empty arrays, repeated rows are scanned each by itself, existing columns
    base and spans are replaced.
    """
    model = fit(docs.select("doc_id", F.col(text).alias("text"))) if model is None else model
    kept, more = free_names(docs.columns, "base_found", "more_found")
    out = docs.withColumn(kept, F.expr(base_spans(text)))
    if model.thresholds:
        limits = ", ".join(f"{t!r}d" for t in model.thresholds)
        struct = ", ".join(f"'{n}', {sql}" for n, sql in features(text, base=kept).items())
        taken = f"""filter({beyond(text, kept)},
          c -> element_at(transform(array(named_struct({struct})), f -> {model.score('f')}), 1) >= element_at(array({limits}), c.kind + 1))"""
        out = out.withColumn(more, F.expr(f"case when size({kept}) > 0 or {text} rlike '[@0-9]' then {taken} else {kept} end"))
    else:
        out = out.withColumn(more, F.expr(f"slice({kept}, 1, 0)"))
    return out.withColumns({"base": F.expr(ordered(kept, "kind", "start")),
                            "spans": F.expr(ordered(f"concat({kept}, {more})", "kind", "start"))}).drop(kept, more)


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of :func:`find` with each span replaced by its kind, as ``[EMAIL]``; of spans that
    overlap, the first in the text is written and the others' rest goes with it. Null texts stay null, and
    rows are redacted each by itself; an empty table stays empty."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    cut = f"""case when size(spans) = 0 then {text} else aggregate(
      array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))),
      named_struct('at', 0, 'out', ''),
      (acc, s) -> case when s.start >= acc.at
        then named_struct('at', s.end, 'out', concat(acc.out, substring({text}, acc.at + 1, s.start - acc.at), element_at(array({names}), s.kind + 1)))
        else named_struct('at', greatest(acc.at, s.end), 'out', acc.out) end,
      acc -> concat(acc.out, substring({text}, acc.at + 1))) end"""
    return found.withColumn(text, F.expr(cut)).drop("base", "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and text form of the spans of :func:`find`."""
    return found.select("doc_id", *(F.expr(count_kind("base", i)).alias(f"n_{k}") for i, k in enumerate(KINDS)),
                        F.sha2(F.expr(written("base", KINDS)), 256).alias("base_sha256"),
                        F.expr(written("spans", KINDS)).alias("spans"))
