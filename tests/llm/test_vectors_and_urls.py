"""Vector searches and URL filters against plain code."""

import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences
from weblake.llm import ann, topk, url_filter, vectors
from weblake.session import Work

SMALL = "/root/testdata/sf0.001"
EDGES = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (100, None), (1, [math.nan, 1.0]), (2, [math.inf, 1.0]), (3, [None, 1.0]), (4, []),
         (5, [0.0, 0.0]), (6, [3.0, 3.0]), (6, [3.0, 3.0]), (7, [3.0, 3.0]), (8, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (9, [-1.0, 4.0]), (9, [5.0, 4.0])]
SCHEMA = "vec_id long, embedding array<float>, score string, rank string, vector string, dim string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def plain(rows, every, k, change, zero):
    kept = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        v = change(np.float32(v).astype(float))
        kept[i] = min(kept.get(i, v.tolist()), v.tolist())
    out = []
    for q in sorted(kept):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q and len(v) == len(kept[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def result(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["op2_url_filter", "op5_exact_top_k"])
def test_queries_with_sql(spark, name):
    problem, n = differences(spark, connect(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert problem is None and n > 0


def test_top_k_edges(spark):
    got = result(topk.exact_top_k(table(spark, EDGES)))
    assert got == plain(EDGES, 50, 5, lambda v: np.floor(256 * v), True) and got
    assert result(topk.exact_top_k(table(spark, []))) == []
    assert result(topk.exact_top_k(table(spark, [(0, [1.0])]))) == []
    big = [(i, [float(1 << 20), float(-i)]) for i in range(60)]  # products beyond doubles' integers
    assert result(topk.exact_top_k(table(spark, big))) == plain(big, 50, 5, lambda v: np.array([int(x) * 256 for x in v], object), True)


def test_blocks_of_any_size_give_one_result(spark, monkeypatch):
    random.seed(2)
    rows = [(i, [random.choice([-1.0, 0.0, 0.5, 1.0, random.random()]) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5, 1.0, 0.5, 0.0, 1.0, 0.5]) for i in range(400, 700)]  # a third are one vector
    monkeypatch.setattr(vectors, "ROWS", 50)
    monkeypatch.setattr(vectors, "QUERIES", 4)
    assert result(topk.exact_top_k(table(spark, rows))) == plain(rows, 50, 5, lambda v: np.floor(256 * v), True)
    got, want = result(ann.approximate_top_k(table(spark, rows))), plain(rows, 20, 20, lambda v: v, False)
    assert len(got) == len(want)
    hits = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len(want)


def test_threshold_stops_before_the_end():
    """On vectors with few large components most of a block is never scored, and the result is exact."""
    rng = np.random.default_rng(3)
    block = rng.integers(-3, 4, (5000, 8))
    block[:40] = rng.integers(200, 256, (40, 8))
    read = []

    class Watched(topk.SortedLists):
        def scores(self, places, query):
            read.append(len(places))
            return super().scores(places, query)
    lists = Watched(np.arange(5000), block)
    for q in range(0, 40, 7):
        ids, scores = lists.top(q, block[q], 5)
        want = block @ block[q]
        want[q] = -1 << 60
        order = np.lexsort((np.arange(5000), -want))[:5]
        assert ids.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
    assert sum(read) < 0.2 * 6 * 5000


def test_recall_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = result(entry.queries()["op6_one_bit_neighbours"](spark, SMALL)), plain(rows, 20, 20, lambda v: v, False)
    assert len(got) == len(want)
    hits = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len(want)
    known = dict(rows)
    for q, _, i, s in got:
        assert s == pytest.approx(float(np.dot(np.float64(known[q]), np.float64(known[i]))), abs=1e-12)


def test_neighbours_edges(spark):
    got = result(ann.approximate_top_k(table(spark, EDGES)))
    assert [g[:3] for g in got] == [w[:3] for w in plain(EDGES, 20, 20, lambda v: v, False)] and got
    assert result(ann.approximate_top_k(table(spark, []))) == []


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64)) * rng.uniform(0.5, 2, (3000, 1))
    matrix = ann.Rotation(64, 256).matrix()
    codes = ann.Codes.of(x, matrix)
    outside = []
    for q in rng.standard_normal((20, 64)):
        estimate, rounding = codes.estimate(q @ matrix.T)
        slack = 2.5 * codes.spread() * np.linalg.norm(q) + rounding * codes.length / codes.along / np.sqrt(codes.bits)
        outside.append((np.abs(estimate - x @ q) > slack).mean())
    assert np.mean(outside) < 0.03


# --- URLs ---

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/12/", "http://example.org/en/2", "http://xexample.org/es/",
        "http://org", "http://org/", "http://a.b.com/fr/x", "https://com/de/", "http://a.com?de/", "http://a.com/DE/", "x://y://z.org/", "http://É.org/é",
        "http://a..org//", "http://org./", "http://www.example.org/es/" + "x" * 100_000, "http://a.net/fr/"]


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_url_edges(spark):
    from weblake.llm.queries import URL_RULES
    rows = [(i % 7 or None, u, "x", "x", "x", "x") for i, u in enumerate(URLS + URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, key string")
    got = sorted((tuple(r) for r in url_filter.filter_urls(df, URL_RULES).select("url", "host", "path", "rule", "verdict").collect()), key=repr)
    assert got == sorted(((u, *plain_verdict(u, URL_RULES)) for u in URLS + URLS), key=repr)
    assert url_filter.filter_urls(df.limit(0), URL_RULES).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(df, ()).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    random.seed(1)
    keys = [f"host{i}.net/{i % 17}" for i in range(6000)]
    lists = {"block": random.sample(keys, 400) + ["absent.net/"], "allow": random.sample(keys, 3), "none": []}
    universe = spark.createDataFrame([(k,) for k in keys + keys[:1000]], "key string")
    cascades = url_filter.build_cascades(Work(spark, "test"), lists, universe)
    assert len(cascades["block"].levels) > 2 and "none" not in cascades
    held = universe.distinct().select("key", *(c.holds(url_filter.F.col("key")).alias(n) for n, c in cascades.items())).collect()
    for name in cascades:
        assert {r.key for r in held if r[name]} == set(lists[name]) & set(keys)
    bits = sum(7 * len(level.data) for level in cascades["block"].levels)
    assert bits < 16 * len(lists["block"])
    with pytest.raises(ValueError):
        url_filter.build_cascades(Work(spark, "test"), lists, universe, max_bytes=10)
