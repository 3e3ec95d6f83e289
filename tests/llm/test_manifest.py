"""The manifest against trees built one node at a time."""

import random
import zlib

import pytest

import __spark_entry__ as entry
from tests.llm import brute
from tests.llm.edges import TEXTS, documents
from weblake.llm import manifest
from weblake.session import Work

SMALL = "/root/testdata/sf0.001"


def plain_leaf(*fields):
    return brute.sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes, arity=2):
    """(top, siblings of each node as (left, right) a level)."""
    paths, spots, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i:i + arity] for i in range(0, len(level), arity)]
        for path, spot in zip(paths, spots):
            run = runs[spot // arity]
            path.append((run[:spot % arity], run[spot % arity + 1:]))
        spots = [s // arity for s in spots]
        level = [brute.sha("".join(run)) for run in runs]
    return level[0], paths


def plain_rows(docs, arity=2):
    """Rows of the contract for [(doc_id, source, lang, n_chars, text)]."""
    by_lang = {}
    for doc in docs:
        by_lang.setdefault(doc[2], []).append((doc[0], plain_leaf(*doc), doc))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = plain_tree([h for _, h, _ in by_lang[lang]], arity)
    if not docs:
        return []
    root, tops = plain_tree([trees[lang][0] for lang in langs], arity)
    rows = []
    for lang, top in zip(langs, tops):
        for (doc_id, leaf, doc), path in zip(by_lang[lang], trees[lang][1]):
            now = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                now = plain_leaf(*doc[:3], None if doc[3] is None else doc[3] + 1, doc[4])
            for left, right in path + top:
                now = brute.sha("".join(left) + now + "".join(right))
            proof = brute.sha("".join("".join(left + right) for left, right in path + top))
            rows.append((doc_id, leaf, trees[lang][0], root, proof, now, now == root))
    return sorted(rows, key=repr)


def read(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_plain_trees(spark):
    got = entry.queries()["op11_merkle_manifest"](spark, SMALL)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = found(got)
    assert rows == plain_rows(read(spark.read.parquet(f"{SMALL}/documents.parquet")))
    assert {r[-1] for r in rows} == {True, False}


def mixed(spark, n, seed=1):
    """Rows of groups of every small size, with nulls, repeats and ties."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i, i, i // 3]), rng.choice([None, "s", "ß"]), lang, rng.choice([None, 5, -3]), rng.choice([None, "", "t", "ü😀"]))
            for i, lang in enumerate(lang for size in range(n) for lang in [f"l{size}" if size else None] * max(size, 3))]
    return spark.createDataFrame(rows + rows[:7], "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("arity, levels", [(2, 1), (2, 2), (3, 2)])
def test_trees_of_every_shape(spark, monkeypatch, arity, levels):
    """Groups of 1 to 12 rows, in passes of few levels, so that chunks, passes and short runs all occur."""
    monkeypatch.setattr(manifest, "ARITY", arity)
    monkeypatch.setattr(manifest, "LEVELS", levels)
    docs = Work(spark, "test").table("docs", mixed(spark, 12 if levels > 1 else 6))
    assert found(manifest.digest(docs)) == plain_rows(read(docs), arity)


def test_edges(spark):
    """Nulls, empty and long texts, repeats, clashing columns, an empty table, a single row, a repeated one only."""
    for docs in (documents(spark, TEXTS[:8] + [(7, "x")] * 3), documents(spark, []), documents(spark, [(1, "only")])):
        assert found(manifest.digest(docs)) == plain_rows(read(docs))


def test_any_change_is_seen(spark):
    """A proof holds for its own row and for no other: every field counts, and so does its place."""
    docs = Work(spark, "test").table("docs", mixed(spark, 6))
    rows = manifest.verified(manifest.manifest(docs))
    assert rows.filter("not verified").count() == 0
    swapped = rows.drop("folded_root", "verified").withColumn("pos", rows["pos"] + 1 - 2 * (rows["pos"] % 2)).filter("path <> '' and pos < n")
    again = manifest.verified(swapped)
    assert again.filter("verified and group_path <> ''").count() <= again.filter("leaf = substring(path, 1, 64)").count()
