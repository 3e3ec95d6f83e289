"""The pipeline: every stage on what the stage before it left, against plain code."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.llm.edges import documents
from tests.llm.test_text_operators import check_pieces, plain_components, plain_fingerprint, plain_targets
from weblake.llm import pii, toxicity
from weblake.session import Work

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name → (input, output), with the edge rows among the documents."""
    work = Work(spark, "test")
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    edges = documents(spark).selectExpr("doc_id + 100000 as doc_id", *given.columns[1:]).filter("doc_id is not null").dropDuplicates(["doc_id"])
    docs, out = work.table("documents", given.unionByName(edges)), {}
    for name, stage in corpus_pipeline.STAGES:
        after = work.table(name, stage(spark, docs, SMALL))
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "personal_data", "mix_sources", "pack"]
    for name, (before, after) in stages.items():
        if name != "pack":
            assert after.columns == before.columns


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    judged = toxicity.toxicity(before.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert sorted(map(repr, (tuple(r) for r in after.select("doc_id", "text").collect()))) == sorted(
        repr((r.doc_id, r.text)) for r in judged if not r.predicted)
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert all(i in kept for i, toxic in known.items() if not toxic)
    assert any(i not in kept for i, toxic in known.items() if toxic)


def test_one_document_of_each_group_stays(stages):
    before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in stages["near_dedup"])
    root = plain_components({plain_fingerprint(t) for _, t in before})
    least = {}
    for i, t in before:
        if i is not None:
            r = root[plain_fingerprint(t)]
            least[r] = min(i, least.get(r, i))
    assert sorted(i for i, _ in after if i is not None) == sorted(set(least.values()) & {i for i, _ in before})
    assert sum(i is None for i, _ in after) == sum(i is None for i, _ in before)


def test_personal_data_is_replaced(spark, stages):
    before, after = stages["personal_data"]
    texts = {}
    for r in after.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
        assert r.text is None or (brute.pii(r.text) == [] and r.n_chars == len(r.text))
    found = pii.find(before.select("doc_id", "text")).collect()
    for r in found:
        text, at, out = r.text or "", 0, ""
        for s in sorted(r.spans, key=lambda s: (s.start, s.end, s.kind)):
            if s.start >= at:
                out += text[at:s.start] + f"[{pii.KINDS[s.kind].upper()}]"
            at = max(at, s.end)
        assert (None if r.text is None else out + text[at:]) in texts[r.doc_id]
    assert len(found) == after.count()


def test_the_mix_takes_what_it_is_to_take(stages):
    before, after = stages["mix_sources"]
    words = lambda t: len((t or "").encode().split())
    sizes, taken = {}, {}
    size_of = {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
        size_of.setdefault(r.doc_id, []).append((words(r.text), r.text))
    for r in after.collect():
        assert r.n_chars == len(r.text)
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
        assert any(0 < words(r.text) <= 2 * n and (r.text.startswith(t) or t.startswith(r.text)) for n, t in size_of[r.doc_id] if t)
    for s, target in plain_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 16


def test_pieces_hold_every_token(stages):
    """Only where ids are unique can pieces be told apart, so rows without an id are counted by their tokens."""
    before, after = stages["pack"]
    rows = {r.doc_id: r.text for r in before.filter("doc_id is not null").collect()}
    assert len(rows) == before.filter("doc_id is not null").count()
    pieces = after.collect()
    if not before.filter("doc_id is null").count():
        check_pieces(pieces, rows)
    else:
        used = {}
        for p in pieces:
            used[p.doc_id] = used.get(p.doc_id, 0) + p.length
        totals = {p.doc_id: p.doc_tokens for p in pieces if p.doc_id is not None}
        assert set(totals) == set(rows) and all(used[i] == n for i, n in totals.items())


def test_stages_stand_clashing_names_and_empty_tables(spark):
    """Edge rows with columns named like the operators' own, and no rows at all, through every stage."""
    for rows in (None, []):
        docs = Work(spark, "edges").table("documents", documents(spark, rows))
        for name, stage in corpus_pipeline.STAGES:
            after = Work(spark, "edges").table(name, stage(spark, docs, SMALL))
            assert name == "pack" or after.columns == docs.columns
            assert (after.count() == 0) == (rows == [])
            docs = after


def test_run(spark):
    rows = entry.queries()["pipeline"](spark, SMALL)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 100
