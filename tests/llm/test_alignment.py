"""The alignment against a plain walk over the tokens that the libraries give."""

import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm import brute
from tests.llm.edges import documents
from weblake.llm import alignment

SMALL = "/root/testdata/sf0.001"
HARD = ["", " ", "a", "  two  spaces \n\n", "▁ piece mark", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "é日本語😀‍́", "\x00\x01\x7f",
        "a" * 5000, "ab " * 3000, "x" + " " * 700 + "y", "  wide", "1234567890 3.14 -- == !!??", "don't we'll I'M", "日" * 900]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def byte_of_char():
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(libraries, text, chars=byte_of_char()):
    """(ids of A, ids of B, groups as (A ids, B ids)) or None."""
    a, b = libraries
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))
    groups, at_a, at_b = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = ends_a.index(cut, at_a) + 1, ends_b.index(cut, at_b) + 1
        groups.append((ids_a[at_a:to_a], ids_b[at_b:to_b]))
        at_a, at_b = to_a, to_b
    return ids_a, ids_b, groups


def plain_rows(libraries, docs):
    """The rows of the contract for [(doc_id, text)]."""
    found = [plain(libraries, t) for _, t in docs]
    count = Counter((g[0][-1], g[1][-1]) for f in found if f for g in f[2])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for (i, _), f in zip(docs, found):
        if f is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(x[-1], y[-1]) for x, y in f[2]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        rows.append((i, len(f[0]), len(f[1]), len(f[2]), len(pairs), sum(count[p] == most[p[1]] for p in pairs),
                     sum(count[p] for p in pairs), brute.sha(text)))
    return sorted(rows, key=repr)


def test_query_equals_the_plain_walk(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op13_cross_tokenizer_alignment"](spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_rows(libraries, docs)


def test_hard_texts_and_edges(spark, libraries):
    """Marks, special strings, runs without a space, texts that B changes; the edge rows with clashing columns."""
    for df in (documents(spark, list(enumerate(HARD)) + [(0, None), (None, "a"), (3, HARD[3])]), documents(spark)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted((tuple(r) for r in alignment.digest(df).collect()), key=repr) == plain_rows(libraries, rows)
    empty = alignment.digest(documents(spark, []))
    assert empty.collect() == [] and empty.columns[0] == "doc_id"
    kept = alignment.align(documents(spark).withColumnsRenamed({"base": "links", "spans": "N_A"}))
    assert kept.columns[-6:] == list(alignment.NAMES) and "lang" in kept.columns and kept.count() == documents(spark).count()


def test_lanes_change_nothing(libraries, monkeypatch):
    """Documents of any length cut into lanes of any length give the same links as one lane each."""
    random.seed(5)
    sizes = [1, 2, 7, 60, 400]
    ends_a, ends_b, firsts_a, firsts_b, total = [], [], [], [], 0
    for n in sizes * 3:
        firsts_a.append(len(ends_a))
        firsts_b.append(len(ends_b))
        for ends in (ends_a, ends_b):
            ends.extend(total + e for e in sorted({*random.sample(range(1, 4 * n), n - 1), 4 * n}))
        total += 4 * n
    want = [ends_b.index(e) if e in ends_b else -1 for e in ends_a]
    for lane in (1, 3, 50, 512):
        monkeypatch.setattr(alignment, "LANE", lane)
        assert alignment.lockstep(*map(np.array, (ends_a, ends_b, firsts_a, firsts_b))).tolist() == want


def test_links_and_their_bound(spark):
    """What is sent to every task is bounded by the vocabularies; links add up to groups."""
    import public_tokenizers as public
    aligned = alignment.align(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = aligned.select("n_links", "links", "groups").collect()
    assert all(sum(x.n for x in r["links"]) == r.n_links == (r.groups.count(";") + 1 if r.groups else 0) for r in rows)
    aligner = alignment.Aligner(public.path("byte_bpe_50k.tiktoken"), public.path("piece_bpe_32k.model"))
    ends = {(x.a, x.b) for r in rows for x in r["links"]}
    assert all(aligner.a.bytes[a].endswith(aligner.b.bytes[b]) or aligner.b.bytes[b].endswith(aligner.a.bytes[a]) for a, b in ends)
    assert len(ends) <= alignment.most_pairs(aligner) < 400_000
