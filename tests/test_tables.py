"""Frontier, upserts, relations, images: small rows for each rule, and brute force for the windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weblake.config import HarvestConfig
from weblake.functions.urls import url_sha1
from weblake.operators import frontier as FR, images as I, links as L, relations as RL, upsert as UP
from weblake.sources.seeds import read_seeds
from weblake.sources.state import load_state

FIRST_LAST = UP.Merge("k", ("a",), ("b",), "ts", ("ts", "n"))


def log(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, a string, b string, ts int, n int")


def by_key(df):
    return {r.k: (r.a, r.b, r.dateinsert, r.daterefresh) for r in df.collect()}


def test_upsert_keeps_first_and_last(spark):
    day1 = UP.upsert(None, log(spark, ("x", "a1", "b1", 1, 1), ("x", "a2", "b2", 2, 2), ("y", "a", "b", 1, 3)), FIRST_LAST)
    assert by_key(day1) == {"x": ("a1", "b2", 1, 2), "y": ("a", "b", 1, None)}
    day2 = UP.upsert(day1, log(spark, ("y", "n", "m", 5, 4), ("z", "a", "b", 5, 5)), FIRST_LAST)
    assert by_key(day2) == {"x": ("a1", "b2", 1, 2), "y": ("a", "m", 1, 5), "z": ("a", "b", 5, None)}
    assert by_key(UP.upsert(day2, log(spark), FIRST_LAST)) == by_key(day2)


def test_upsert_breaks_ties_by_the_order_columns(spark):
    got = UP.upsert(None, log(spark, ("x", "second", "second", 1, 2), ("x", "first", "first", 1, 1)), FIRST_LAST)
    assert by_key(got) == {"x": ("first", "second", 1, 1)}


def test_repeated_update_changes_only_the_refresh_time(spark):
    rows = log(spark, ("x", "a", "b", 1, 1))
    once = UP.upsert(None, rows, FIRST_LAST)
    twice = UP.upsert(once, rows, FIRST_LAST)
    assert by_key(twice) == {"x": ("a", "b", 1, 1)} and by_key(UP.upsert(twice, rows, FIRST_LAST)) == by_key(twice)


def test_combine_is_associative(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pqr"), f"a{i}", f"b{i}", rng.randrange(5), i) for i in range(60)]
    rng.shuffle(rows)
    whole = FIRST_LAST.table(FIRST_LAST.combine(FIRST_LAST.from_updates(log(spark, *rows))))
    parts = [FIRST_LAST.combine(FIRST_LAST.from_updates(log(spark, *rows[i::4]))) for i in range(4)]
    merged = FIRST_LAST.combine(FIRST_LAST.combine(parts[0].union(parts[1])).union(parts[2]).union(parts[3]))
    assert by_key(FIRST_LAST.table(merged)) == by_key(whole)


def test_insert_ignore(spark):
    old = spark.createDataFrame([("p", 1)], "page string, seed int")
    new = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2), ("q", 0), (None, 3)], "page string, seed int")
    added = UP.insert_ignore(old, new, ["page", "seed"])
    assert [tuple(r) for r in added.collect()] == [("p", 2)]
    assert UP.insert_ignore(old.union(added), new, ["page", "seed"]).isEmpty()


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "url_sha1 string, ord bigint, attempt int")


def test_queue(spark):
    queue = items(spark, ("a", 3, 1), ("b", 5, 1), ("c", 9, 1))
    assert [r.ord for r in FR.take(queue, 2).collect()] == [3, 5]
    assert [r.ord for r in FR.take(queue, 1, "lifo").collect()] == [9]
    assert [r.url_sha1 for r in FR.remainder(queue, FR.take(queue, 2)).collect()] == ["c"]
    longer = FR.enqueue(queue, items(spark, ("e", 8, 1), ("d", 7, 1)))
    assert [r.url_sha1 for r in FR.take(longer, 9).collect()] == ["a", "b", "c", "d", "e"]
    assert [(r.url_sha1, r.ord) for r in FR.enqueue(queue.limit(0), items(spark, ("e", 8, 1))).collect()] == [("e", 0)]
    again = FR.requeue(queue, items(spark, ("a", 3, 3), ("b", 5, 4)))
    assert [(r.url_sha1, r.attempt) for r in FR.take(again, 9).collect()] == [("a", 1), ("b", 1), ("c", 1), ("a", 4)]


def test_first_seen_and_unseen(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaaaabcdef"), i, 1) for i in rng.sample(range(1000), 200)]
    first = FR.first_seen(items(spark, *rows), ["url_sha1"], ["ord"])
    want = {}
    for key, order, _ in sorted(rows, key=lambda r: r[1]):
        want.setdefault(key, order)
    assert {r.url_sha1: r.ord for r in first.collect()} == want
    left = FR.unseen(first, items(spark, ("a", 0, 1), ("zz", 0, 1)))
    assert {r.url_sha1 for r in left.collect()} == set(want) - {"a"}


@pytest.mark.parametrize("chunk", [1, 7, 10 ** 6])
def test_ranked_with_a_hot_group(spark, chunk):
    rng = random.Random(chunk)
    rows = [("hot" if i % 3 else rng.choice("xyz"), i * 5) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "host string, ord bigint")
    got = {(r.host, r.ord): r.rank for r in FR.ranked(df, ["host"], ["ord"], F.floor(F.col("ord") / chunk)).collect()}
    count = {}
    for host, order in sorted(rows, key=lambda r: r[1]):
        count[host] = count.get(host, 0) + 1
        assert got[host, order] == count[host]


def test_politeness(spark):
    df = spark.createDataFrame([("http://a/1", 4), ("http://a/2", 1), ("https://b/", 2), ("http://a/3", 9)], "url string, ord bigint")
    plan = {r.url: r.start_at for r in FR.fetch_plan(df, 0.25).collect()}
    assert plan == {"http://a/2": 0.0, "http://a/1": 0.25, "http://a/3": 0.5, "https://b/": 0.0}


def test_retry_budget(spark):
    rows = [("won", 1, False), ("won", 2, True), ("won", 3, False), ("late", 1, False), ("late", 2, False), ("late", 3, False),
            ("late", 4, False), ("late", 5, True), ("open", 1, False)]
    df = spark.createDataFrame([(k, ts, ts, ok) for k, ts, ok in rows], "photo_sha1 string, ts int, event_id int, ok boolean")
    got = I.retry_budget(df)
    assert {r.photo_sha1: (r.attempts, r.status) for r in got.collect()} == {
        "won": (2, "stored"), "late": (4, "dead"), "open": (1, "pending")}
    assert [r.photo_sha1 for r in I.dead_letter(got).collect()] == ["late"]


def test_image_gate(spark):
    df = spark.createDataFrame([(199, 500), (200, 200), (701, 200), (700, 200), (200, 701), (80, 80), (79, 200), (100, 900)],
                               "width int, height int")
    assert [tuple(r) for r in I.image_gate(df).collect()] == [(200, 200), (700, 200)]
    assert len(I.image_gate(df, quality=2).collect()) == 7


def test_first_page_of_image(spark):
    df = spark.createDataFrame([("p1", "i", 1), ("p1", "i", 2), ("p2", "i", 3), ("p2", "j", 4)], "url string, src string, n int")
    assert {(r.url, r.src) for r in I.first_page_of_image(df, ["n"]).collect()} == {("p1", "i"), ("p2", "j")}
    assert {(r.url, r.src) for r in I.first_page_of_image(df, ["n"], "all").collect()} == {("p1", "i"), ("p2", "i"), ("p2", "j")}


def test_image_store(spark, tmp_path):
    from weblake.sources.pages import read_images
    keys = spark.createDataFrame([("http://h/1.jpg",), ("http://h/2.jpg",)], ["u"]).select(url_sha1(F.col("u")).alias("photo_sha1"))
    laid = I.store_layout(keys).collect()
    assert all(r.path == f"{r.photo_sha1[:3]}/{r.photo_sha1}.jpg" for r in laid)
    for r in laid:
        (tmp_path / r.shard).mkdir()
        (tmp_path / r.path).write_bytes(b"jpeg")
    assert {r.photo_sha1 for r in read_images(spark, str(tmp_path)).collect()} == {r.photo_sha1 for r in laid}
    I.write_images(keys, str(tmp_path / "table"))
    assert {p.name for p in (tmp_path / "table").glob("shard=*")} == {f"shard={r.shard}" for r in laid}


def test_relations(spark):
    left = spark.createDataFrame([("p1",), ("p1",), ("p2",)], ["page_sha1"])
    right = spark.createDataFrame([("i1",)], ["photo_sha1"])
    pairs = spark.createDataFrame([("p1", "i1"), ("p1", "i2"), ("p3", "i1")], ["page_sha1", "photo_sha1"])
    assert {(r.page_sha1, r.photo_sha1): r.linked for r in RL.link_by_hash(pairs, left, right).collect()} == {
        ("p1", "i1"): 1, ("p1", "i2"): 0, ("p3", "i1"): 0}
    found = RL.relation_exists(pairs, pairs.limit(1), left, right)
    assert sum(r.found for r in found.collect()) == 1


def test_pairs_from_json(spark):
    texts = ['["i","p/"]', '["i","p"]', '["only"]', "nonsense", None, "[]"]
    got = RL.pairs_from_json(spark.createDataFrame([(t,) for t in texts], "pair_json string")).collect()
    assert [r.rejected for r in got] == [0, 0, 1, 1, 1, 1] and got[0].page_sha1 == got[1].page_sha1


def test_seeds(spark):
    rows = [(1, "http://a", 0, 2, 0), (2, " http://b c ", 0, 3, 0), (3, None, 0, 3, 0), (4, "", 0, 3, 0), (5, "http://d", 1, 2, 0),
            (6, "http://e", 0, 3, 1), (None, "http://f", 0, 3, 0)]
    seeds = spark.createDataFrame(rows, "id bigint, url string, deleted int, photosourcetype_id int, webkit int").withColumn(
        "category", F.lit("c")).withColumn("category_1", F.lit("d"))
    assert [r.seed_id for r in read_seeds(seeds).collect()] == [1]
    product = read_seeds(seeds, "product").collect()
    assert [(r.seed_id, r.url, r.seed_url, r.category_1) for r in product] == [(2, " http://b c ", "http://bc", "d")]


def test_state_levels(spark):
    one = spark.range(1)
    for level, kept in {0: 3, 1: 2, 2: 1, 3: 0, 9: 3}.items():
        state = load_state({"frontier": one, "visited": one, "images": one}, HarvestConfig(init_level=level))
        assert sum(df.count() for df in state.values()) == kept


def test_routing(spark):
    df = L.route(spark.createDataFrame([(3,), (31,), (2,)], ["pagetype"]))
    assert [r.route for r in df.collect()] == ["list", "detail", "ignore"]
    hits = spark.sql("select array('i') as some, array('') as blank, cast(array() as array<string>) as none")
    outcome = hits.select(L.detail_outcome(F.col("some"), F.col("none"), F.col("none")),
                          L.detail_outcome(F.col("none"), F.col("blank"), F.col("some")),
                          L.detail_outcome(F.col("none"), F.col("some"), F.col("none"))).first()
    assert list(outcome) == ["store", "retry", "drop"]


def test_config_rejects_unknown_values():
    with pytest.raises(ValueError):
        HarvestConfig(kind="x")
    with pytest.raises(ValueError):
        HarvestConfig(scope="x")
    assert HarvestConfig.product().depth_limit == 1000 and HarvestConfig.blog().depth_limit is None


def test_main_image(spark):
    products = spark.createDataFrame([("k1", "t", "1", "s", "p", "x", None, None)],
                                     "pageurlhash string, title string, price string, size string, productid string, "
                                     "pagetext string, mainimage_sha1 string, daterefresh timestamp")
    at = dt.datetime(2024, 1, 1)
    updates = spark.createDataFrame([("k1", "n", "2", "s", "p", "y", "img", at), ("k2", "n", "2", "s", "p", "y", "img", at)],
                                    "pageurlhash string, title string, price string, size string, productid string, "
                                    "pagetext string, mainimage_sha1 string, ts timestamp")
    for stored, image in ((["img"], "img"), (["other"], None)):
        photos = spark.createDataFrame([(s,) for s in stored], ["photourlhash"])
        got = {r.pageurlhash: r for r in RL.enrich_main_image(products, photos, updates).collect()}
        assert (got["k1"].title, got["k1"].price, got["k1"].mainimage_sha1, got["k1"].daterefresh) == ("n", "2", image, at)
        assert (got["k2"].title, got["k2"].mainimage_sha1, got["k2"].daterefresh) == ("n", None, None)
