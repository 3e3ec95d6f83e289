"""Rules as of a page's fetch time, against a plain look-up in the log of changes."""

import random

import pytest
from pyspark.sql import functions as F

from weblake.config import HarvestConfig
from weblake.operators import rule_history as RH
from weblake.plans.expand import expand
from weblake.plans.harvest import product_pages
from weblake.session import work_dir
from weblake.sources.seeds import read_seeds
from weblake.operators.rules import rules_from_seeds

CHANGES = "seed_id bigint, field string, selector string, since int"
START = "timestamp '2024-01-01' + make_dt_interval(since)"


def at_day(df, column="since"):
    return df.withColumn(column, F.expr(START.replace("since", column)))


def plain(changes, seed, day):
    """Field by field, the selector of the last change not after a day."""
    out = {}
    for field in RH.XPATH_FIELDS:
        mine = [(d, s or "") for i, f, s, d in changes if i == seed and None not in (i, d, day) and f == field and d <= day]
        last = max(mine)[1] if mine else ""
        if last and "!" not in last:
            out[field] = last
    return out


@pytest.mark.parametrize("pack, chunk", [(3, "month"), (64, "year")])
def test_rules_in_force_equal_a_plain_lookup(spark, monkeypatch, pack, chunk):
    """Also a seed with most changes and pages, ties, repeats, unset fields, and selectors that are not understood."""
    monkeypatch.setattr(RH, "PACK", pack)
    draw = random.Random(5)
    selectors = ["//a/text()", "//b/text()", "//p[1]/@href", None, "", "//!!"]
    changes = [(draw.choice([1, 1, 1, 2, 3, None]), draw.choice(RH.XPATH_FIELDS[:3]), draw.choice(selectors), draw.randrange(400)) for _ in range(300)]
    changes += changes[:20] + [(1, "price_xpath", "//x/text()", None), (1, "category", "shoes", 3)]
    items = [(i, draw.choice([1, 1, 1, 2, 3, 4, None]), draw.choice([*range(-5, 420), None])) for i in range(400)]
    history = RH.rule_history(at_day(spark.createDataFrame(changes, CHANGES)), chunk)
    rows = at_day(spark.createDataFrame(items, "id int, seed_id bigint, at int"), "at")
    got = {r.id: r.rules for r in RH.with_rules_at(rows, history, "at").collect()}
    assert len(got) == len(items) == RH.with_rules_at(rows, history, "at").count()
    for number, seed, day in items:
        assert (got[number] or {}) == plain(changes, seed, day), (number, seed, day)


def test_spans_do_not_overlap(spark, monkeypatch):
    monkeypatch.setattr(RH, "PACK", 4)
    changes = at_day(spark.createDataFrame([(1, "title_xpath", f"//p[{i + 1}]/text()", i) for i in range(50)], CHANGES))
    spans = sorted((r.since, r.until, len(r.versions)) for r in RH.rule_history(changes).collect())
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] is None
    assert sum(n for *_, n in spans) == 50 and max(n for *_, n in spans) == 4


def test_empty_tables(spark):
    none = RH.rule_history(at_day(spark.createDataFrame([], CHANGES)))
    assert none.count() == 0
    items = at_day(spark.createDataFrame([(1, 1, 5)], "id int, seed_id bigint, at int"), "at")
    assert [r.rules for r in RH.with_rules_at(items, none, "at").collect()] == [None]
    assert RH.with_rules_at(items.limit(0), none, "at").collect() == []


def test_the_join_is_by_seed_and_span(spark):
    """No pairing of all rows, whichever side is large."""
    history = RH.rule_history(at_day(spark.createDataFrame([(1, "title_xpath", "//p/text()", 1)], CHANGES)))
    items = at_day(spark.createDataFrame([(1, 1, 5)], "id int, seed_id bigint, at int"), "at")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = RH.with_rules_at(items, history, "at")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_walk_reads_each_page_by_its_day(spark):
    """The list rule and the title rule change on day 10; the same page, fetched twice, gives two rows."""
    site = [(0, "http://s.com/l/", "<ul><a href='/p1'>1</a></ul><ol><a href='/p2'>2</a></ol>", 5),
            (1, "http://s.com/l/", "<ul><a href='/p1'>1</a></ul><ol><a href='/p2'>2</a></ol>", 15),
            (2, "http://s.com/p1", "<h1>Old</h1><h2>New</h2><img src='a.jpg'>", 5),
            (3, "http://s.com/p1", "<h1>Old</h1><h2>New</h2><img src='a.jpg'>", 15),
            (4, "http://s.com/p2", "<h1>Old</h1><h2>New</h2><img src='b.jpg'>", 1)]
    pages = at_day(spark.createDataFrame(site, "page_id bigint, url string, html string, fetched int"), "fetched")
    seeds = spark.createDataFrame([(1, "http://s.com/l/", 0, 3, 0)], "id bigint, url string, deleted int, photosourcetype_id int, webkit int")
    seeds = seeds.withColumn("category", F.lit("c")).withColumn("category_1", F.lit("d"))
    changes = at_day(spark.createDataFrame([
        (1, "detailurl_xpath", "//ul/a/@href", 2), (1, "detailurl_xpath", "//ol/a/@href", 10), (1, "mainimageurl_xpath", "//img/@src", 2),
        (1, "title_xpath", "//h1/text()", 2), (1, "title_xpath", "//h2/text()", 10), (1, "price_xpath", "//*!!", 3)], CHANGES))

    def walk(stored):
        folder = work_dir(spark, "t")
        crawl = expand(spark, read_seeds(seeds, "product"), stored, HarvestConfig.product(), folder, changes, at="fetched")
        found = product_pages(crawl, stored, spark.read.parquet(f"{folder}/rules"), "fetched")
        rejected = [(r.field, r.walks) for r in spark.read.parquet(f"{folder}/rejected_rules").collect()]
        return sorted((r.page_id, r.title, r.outcome) for r in found.collect()), rejected

    rows, rejected = walk(pages)
    # page 4 was fetched before any rule was there
    assert rows == [(2, "Old", "store"), (3, "New", "store"), (4, "", "drop")]
    assert rejected == [("price_xpath", True)]
    assert walk(pages.filter("page_id <> 1"))[0] == [(2, "Old", "store"), (3, "New", "store")]


def test_a_settled_table_is_the_history_of_one_change(spark):
    """Rules that never change give the same product rows with a time and without."""
    from weblake.operators.rules import seed_rules, with_rules
    seeds = spark.createDataFrame([(1, "//h1/text()", "//em/text()"), (2, "//h2/text()", None)], "id bigint, title_xpath string, price_xpath string")
    rules = rules_from_seeds(seeds)
    items = at_day(spark.createDataFrame([(i, i % 3, i) for i in range(9)], "id int, seed_id bigint, at int"), "at")
    history = RH.rule_history(at_day(rules.withColumn("since", F.lit(0))))
    settled = {r.id: r.rules for r in with_rules(items, seed_rules(rules)).collect()}
    assert {r.id: r.rules for r in RH.with_rules_at(items, history, "at").collect()} == settled
