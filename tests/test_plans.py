"""Whole harvests against a walk in plain Python, streams against batch, and the shape of the plans."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weblake.config import HarvestConfig
from weblake.functions.urls import url_sha1
from weblake.operators import frontier as FR, upsert as UP
from weblake.operators.rules import rules_from_seeds
from weblake.plans.expand import expand, reach
from weblake.plans.harvest import blog_pages, blog_tables, not_stored, product_pages, product_tables, store_harvest
from weblake.session import work_dir, work_root
from weblake.sources.buckets import BucketStore, Change
from weblake.sources.seeds import read_seeds
from weblake.sources.versions import read_version, write_version
from weblake.streaming import streams as ST

SMALL = "/root/testdata/sf0.001"

BLOG = {
    "http://a.com": "<title>Home</title><a href='/1'>1</a><a href='/2/'>2</a><a href='http://b.com/x'>b</a><img src=/logo.png>",
    "http://a.com/1": "<title>One</title><a href='2'>2</a><a href='3'>3</a><p>2012-01-05</p><img src=i.jpg alt='a.b'><img src=/logo.png>",
    "http://a.com/2": "<a href='/'>home</a><a href='3#c'>3</a><a href='/page/4'>4</a>",
    "http://a.com/3": "<a href='/1'>1</a><a href='5'>5</a><a href='pic.jpg'>p</a>",
    "http://a.com/page/4": "<a href='/gone'>gone</a>",
    "http://a.com/5": "<p>end</p>",
    "http://b.com/x": "<a href='/y'>y</a>",
}


def tables(spark, site, *seed_rows):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())], "page_id bigint, url string, html string")
    seeds = spark.createDataFrame(list(seed_rows), "id bigint, url string").select(
        "*", F.lit(0).alias("deleted"), F.lit(2).alias("photosourcetype_id"), F.lit(0).alias("webkit"))
    return pages, seeds


def blog_walk(spark, **changes):
    pages, seeds = tables(spark, BLOG, (7, "http://a.com"), (8, "http://b.com/x"), (9, "http://a.com"))
    crawl = expand(spark, read_seeds(seeds), pages, HarvestConfig.blog(**changes), work_dir(spark, "t"))
    return pages, crawl


def test_blog_walk(spark):
    _, crawl = blog_walk(spark)
    assert {r.url: (r.seed_id, r.depth) for r in crawl.collect()} == {
        "http://a.com": (7, 1), "http://b.com/x": (8, 1), "http://a.com/1": (7, 2), "http://a.com/2": (7, 2),
        "http://a.com/3": (7, 3), "http://a.com/page/4": (7, 3), "http://a.com/5": (7, 4), "http://a.com/gone": (7, 4)}
    assert crawl.groupBy("url_sha1").count().filter("count > 1").isEmpty()


def test_queue_order_within_a_level(spark):
    _, crawl = blog_walk(spark)
    third = [r.url for r in crawl.filter("depth = 3").orderBy("ord").collect()]
    assert third == ["http://a.com/3", "http://a.com/page/4"]


def test_blog_walk_stops_at_its_depth(spark):
    _, crawl = blog_walk(spark, depth_limit=2)
    assert sorted(r.url for r in crawl.collect()) == ["http://a.com", "http://a.com/1", "http://a.com/2", "http://b.com/x"]


def test_later_harvest_skips_what_was_visited(spark):
    pages, crawl = blog_walk(spark)
    _, seeds = tables(spark, BLOG, (7, "http://a.com"), (10, "http://a.com/gone"), (11, "http://a.com/new"))
    again = expand(spark, read_seeds(seeds), pages, HarvestConfig.blog(), work_dir(spark, "t"), visited=crawl)
    assert [r.url for r in again.collect()] == ["http://a.com/new"]


def test_numbers_of_a_level_come_from_several_tasks(spark):
    from weblake.operators.frontier import in_order
    links = spark.range(100_000).selectExpr("id % 10 as parent_ord", "0 as priority", "id div 10 as pos")
    folder, small = work_dir(spark, "t"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # else the few rows here become one partition
    try:
        in_order(links.repartition(8), ["parent_ord", "priority", "pos"]).write.parquet(folder)
    finally:
        spark.conf.unset(small)
    rows = spark.read.parquet(folder).orderBy("ord").collect()
    assert [(r.parent_ord, r.pos) for r in rows] == sorted((r.parent_ord, r.pos) for r in rows)
    assert len({r.ord for r in rows}) == 100_000 and len({r.ord >> 33 for r in rows}) > 1


def test_walks_have_no_bound(spark):
    chain = {f"http://a.com/{i}": f"<a href='/{i + 1}'>n</a>" for i in range(16)}
    pages, seeds = tables(spark, chain, (7, "http://a.com/0"))
    crawl = expand(spark, read_seeds(seeds), pages, HarvestConfig.blog(scope="none"), work_dir(spark, "t"))
    assert crawl.agg(F.max("depth")).first()[0] == 17
    edges = spark.range(24).selectExpr("id as src", "id + 1 as dst")
    reached = reach(spark, spark.createDataFrame([(0,)], "node bigint"), edges, None, work_dir(spark, "t"))
    assert {r.node: r.depth for r in reached.collect()} == {i: i + 1 for i in range(25)}


def test_blog_tables(spark):
    pages, crawl = blog_walk(spark)
    extracted = blog_pages(crawl, pages)
    got = blog_tables(extracted)
    blogs = {r.pageurl: r for r in got["blogpage"].collect()}
    assert set(blogs) == set(BLOG) and blogs["http://a.com/1"].title == "One" and blogs["http://a.com/page/4"].detailed == 0
    photos = {r.photourl: (r.title, r.datepost, r.page_id) for r in got["photocache"].collect()}
    assert photos == {"http://a.com/logo.png": ("", "", 0), "http://a.com/i.jpg": ("a b", "2012-01-05", 1)}
    assert got["blogphotopagerelation"].count() == 2 and got["blogpageseedrelation"].count() == len(BLOG)
    assert blog_tables(extracted, mode="all")["blogphotopagerelation"].count() == 3
    sizes = spark.createDataFrame([("http://a.com/i.jpg", 300, 300), ("http://a.com/logo.png", 90, 90)], "u string, width int, height int")
    gated = blog_tables(extracted, sizes.select(url_sha1(F.col("u")).alias("photo_sha1"), "width", "height"))
    assert [r.photourl for r in gated["photocache"].collect()] == ["http://a.com/i.jpg"]


def test_an_image_belongs_to_the_page_met_first(spark):
    """The seed page has the larger page_id, but comes first in the crawl."""
    site = {"http://a.com/deep": "<title>d</title><img src='/i.jpg' alt='deep'>", "http://a.com": "<a href='/deep'>d</a><img src='/i.jpg' alt='seed'>"}
    pages, seeds = tables(spark, site, (7, "http://a.com"))
    crawl = expand(spark, read_seeds(seeds), pages, HarvestConfig.blog(), work_dir(spark, "t"))
    photos = blog_tables(blog_pages(crawl, pages))["photocache"].collect()
    assert [(r.photourl, r.title) for r in photos] == [("http://a.com/i.jpg", "seed")]


def test_a_second_harvest_changes_only_what_an_upsert_changes(spark):
    pages, crawl = blog_walk(spark)
    root = f"{work_dir(spark, 't')}/store"
    assert BucketStore(spark, root).tables() == {}

    def store(extracted, at):
        return store_harvest(spark, root, blog_tables(extracted, at=F.to_timestamp(F.lit(at))), "blog")

    before = {n: df.collect() for n, df in store(blog_pages(crawl, pages), "2024-01-01").items()}
    changed = pages.withColumn("html", F.replace("html", F.lit("One"), F.lit("Won")))
    after = store(blog_pages(crawl, changed), "2024-02-01")
    assert {n: df.count() for n, df in after.items()} == {n: len(rows) for n, rows in before.items()}
    titles = {r.pageurl: (r.title, str(r.dateinsert), str(r.daterefresh)) for r in after["blogpage"].collect()}
    assert titles["http://a.com/1"] == ("Won", "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    first = BucketStore(spark, root).read("blogpage", 1)
    assert sorted(first.collect()) == sorted(before["blogpage"]) and {r.daterefresh for r in first.collect()} == {None}


def test_null_attempts_and_outcomes_are_not_lost(spark):
    folder = work_dir(spark, "t")
    spark.createDataFrame([(1, 1), (2, None), (3, 4), (4, 1)], "id long, attempt int").write.parquet(f"{folder}/frontier/start")
    failed = lambda: F.when(F.col("id") == 4, F.lit(None).cast("boolean")).otherwise(F.col("id") > 1)
    ended = ST.run_retries(spark, f"{folder}/frontier", failed, f"{folder}/out", f"{folder}/checkpoint")
    assert sorted((r.id, r.attempt, r.status) for r in ended.fillna(-1).collect()) == [(1, 1, "done"), (2, -1, "dead"), (3, 4, "dead"), (4, 4, "dead")]


def test_unfinished_versions_are_not_read(spark, tmp_path):
    root, table = f"{tmp_path}/store", spark.range(3)
    assert write_version(spark, root, {"t": table}) == 1
    spark.range(5).write.parquet(f"{root}/version=2/t")  # a run that failed before its end
    assert read_version(spark, root)["t"].count() == 3 and read_version(spark, root, 2) == {}
    assert write_version(spark, root, {"t": read_version(spark, root)["t"].union(table)}) == 3
    assert read_version(spark, root)["t"].count() == 6


def test_a_merge_touches_its_buckets_only(spark, tmp_path, monkeypatch):
    """Buckets without a changed key keep their files, relations only grow, and the rows are those of whole-table merges."""
    import weblake.sources.buckets as buckets
    monkeypatch.setattr(buckets, "MOST_FOLDERS", 3)
    store, plain = BucketStore(spark, f"{tmp_path}/s", 8), {}
    def newest(old, new):
        rows = new if old is None else old.unionByName(new)
        return rows.groupBy("k").agg(F.max("v").alias("v"))
    def added(old, new):
        return UP.insert_ignore(new.limit(0) if old is None else old, new, ["k", "v"])
    links = set()
    for step, keys in enumerate([range(100), range(100, 103), range(101, 102), [101], [101, 5], [], [101]]):
        new = spark.createDataFrame([(f"k{i}", step) for i in keys], "k string, v int")
        before = store.manifest()
        number = store.merge({"t": Change(new, ["k"], newest), "r": Change(new, ["k"], added, appends=True)})
        plain.update({f"k{i}": step for i in keys})
        links |= {(f"k{i}", step) for i in keys if step}
        assert number == step + 1
        assert {r.k: r.v for r in store.read("t").collect()} == plain
        assert {(r.k, r.v) for r in store.read("r").collect()} == links
        now = store.manifest()
        moved = {b for b in now["t"] if now["t"][b] != before.get("t", {}).get(b)}
        assert len(moved) <= len(keys) and all(len(f) == 1 for f in now["t"].values())
        assert all(len(f) <= 3 for f in now["r"].values())
        for b, folders in before.get("r", {}).items():
            assert now["r"][b][:len(folders)] == folders or len(folders) >= 3
    assert {r.k: r.v for r in store.read("t", 1).collect()} == {f"k{i}": 0 for i in range(100)}  # older versions stay readable


SHOP = {
    "http://s.com/l1/": "<ul><a href='p1'>1</a><a href='p2'>2</a><a href='/l2/'>both</a></ul><i class='next'><a href='/l2/'>n</a><a href='/l3/'>n</a></i>",
    "http://s.com/l2/": "<ul><a href='/p9'>9</a></ul>",
    "http://s.com/l3/": "<ul><a href='/l1/p1'>1</a><a href='/p3'>3</a></ul>",
    "http://s.com/l1/p1": "<h1>Shoe, red</h1><em>9.90</em><img src='a.jpg'>",
    "http://s.com/l1/p2": "<h1>No image</h1><em>5</em>",
    "http://s.com/p3": "<h1>No price</h1><a href='/l3/'>x</a>",
}


def test_product_walk(spark):
    pages, _ = tables(spark, SHOP, (1, "x"))
    seeds = spark.createDataFrame([(1, "http://s.com/l1/", 0, 3, 0, "shoes", "all", "//ul/a/@href", "//i[@class='next']/a/@href",
                                    "//h1/text()", "//em/text()", "//img/@src")],
                                  "id bigint, url string, deleted int, photosourcetype_id int, webkit int, category string, "
                                  "category_1 string, detailurl_xpath string, nextpage_xpath string, title_xpath string, "
                                  "price_xpath string, mainimageurl_xpath string")
    folder = work_dir(spark, "t")
    crawl = expand(spark, read_seeds(seeds, "product"), pages, HarvestConfig.product(), folder, rules_from_seeds(seeds))
    # l2 matches both rules: the detail link comes first, so it is no list and p9 is not found
    assert {r.url: (r.pagetype, r.depth) for r in crawl.collect()} == {
        "http://s.com/l1/": (3, 1), "http://s.com/l1/p1": (31, 2), "http://s.com/l1/p2": (31, 2), "http://s.com/l2/": (31, 2),
        "http://s.com/l3/": (3, 2), "http://s.com/p3": (31, 3)}
    got = product_tables(product_pages(crawl, pages, spark.read.parquet(f"{folder}/rules")))
    assert [(r.title, r.price, r.imageamount, r.category) for r in got["productpage"].collect()] == [("Shoe  red", "9 90", -1, "shoes")]
    assert [r.photourl for r in got["photocache"].collect()] == ["http://s.com/l1/a.jpg"]
    assert [(r.url, r.attempt) for r in got["retry"].collect()] == [("http://s.com/l1/p2", 1)]
    queue = FR.requeue(got["retry"].limit(0), got["retry"])
    assert [(r.url, r.attempt, r.url_sha1 is not None) for r in queue.collect()] == [("http://s.com/l1/p2", 2, True)]
    gone = pages.filter("url not in ('http://s.com/l3/', 'http://s.com/p3')")
    assert {(r.url, r.pagetype) for r in not_stored(crawl, gone, False).collect()} == {("http://s.com/l3/", 3), ("http://s.com/p3", 31)}
    stored = store_harvest(spark, f"{folder}/store", got, "product")
    assert set(stored) == {"productpage", "productpageseedrelation", "photocache", "productphotopagerelation"}
    assert [(r.title, r.daterefresh) for r in stored["productpage"].collect()] == [("Shoe  red", None)]
    assert stored["photocache"].first().datepost is not None
    assert got["productphotopagerelation"].count() == got["productpageseedrelation"].count() == 1


def test_a_stopped_walk_goes_on(spark):
    """Stopped after any level, or cut off within one, and resumed, a walk gives what it gives in one go."""
    links = {f"http://s/{i}": "".join(f'<a href="/{j}">x</a>' for j in (2 * i + 1, 2 * i + 2) if j < 15) for i in range(15)}
    pages, seeds = tables(spark, links, (1, "http://s/0"))
    rows = lambda crawl: sorted((r.url, r.depth, r.seed_id) for r in crawl.collect())
    go = lambda folder, **how: expand(spark, read_seeds(seeds), pages, how.pop("config", HarvestConfig.blog(scope="none")), folder, **how)
    want = rows(go(work_dir(spark, "t")))
    assert len(want) == 15
    for stop in (1, 2, 3):
        folder = work_dir(spark, "t")
        assert max(d for _, d, _ in rows(go(folder, levels=stop))) == stop
        spark.range(3).write.parquet(f"{folder}/crawl/level={stop + 1}/part")  # what a lost driver may leave: no mark
        assert rows(go(folder, resume=True, levels=1)) and rows(go(folder, resume=True)) == want
        assert rows(go(folder, resume=True)) == want  # a finished walk stays as it is
    dropped = rows(go(folder, resume=True, config=HarvestConfig.blog(scope="none", init_level=1)))
    assert dropped == want  # the frontier is gone, all is visited
    assert rows(go(folder, resume=True, config=HarvestConfig.blog(scope="none", init_level=2), levels=2)) == [r for r in want if r[1] <= 2]


def test_pages_move_only_if_they_are_reached(spark):
    """With a crawl too large to broadcast, the page scan is filtered by a Bloom filter before its exchange."""
    from weblake.plans.harvest import blog_pages
    folder = work_dir(spark, "t")
    spark.range(2000).selectExpr("id as page_id", "concat('http://s/', id) as url", "repeat('<p>x</p>', 200) as html").write.parquet(f"{folder}/pages")
    spark.range(50).selectExpr("concat('http://s/', id) as url", "sha1(concat('http://s/', id)) as url_sha1", "1L as seed_id", "1 as level", "id as ord").write.parquet(f"{folder}/crawl")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
            "spark.sql.optimizer.runtime.bloomFilter.enabled": "true"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = blog_pages(spark.read.parquet(f"{folder}/crawl"), spark.read.parquet(f"{folder}/pages"))
        assert "might_contain" in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() == 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_reach_equals_breadth_first_search(spark):
    edges = [(i, (i * 7 + 3) % 50) for i in range(50)] + [(i, i // 2) for i in range(50)] + [(0, i) for i in range(20, 30)]
    depth, level = {1: 1}, {1}
    for d in range(2, 6):
        level = {b for a, b in edges if a in level} - set(depth)
        depth.update({n: d for n in level})
    got = reach(spark, spark.createDataFrame([(1,)], "node bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"),
                5, work_dir(spark, "t"))
    assert {r.node: r.depth for r in got.collect()} == depth


# --- streams -----------------------------------------------------------------------------------

def test_dedup_over_batches_and_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = spark.createDataFrame([("u1", "h1"), ("u2", "h2"), ("u1", "h1")], "url string, url_sha1 string")
    rows.repartition(3).write.parquet(source)
    stream = ST.read_folder(spark, source, rows.schema, files_per_batch=1)
    assert ST.run_url_dedup(spark, stream, out, checkpoint).count() == 2
    spark.createDataFrame([("u2", "h2"), ("u3", "h3")], rows.schema).write.mode("append").parquet(source)
    again = ST.run_url_dedup(spark, ST.read_folder(spark, source, rows.schema), out, checkpoint)
    assert sorted(r.url for r in again.collect()) == ["u1", "u2", "u3"]


def test_stream_upsert_equals_batch(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    merge = UP.Merge("k", ("a",), ("b",), "ts", ("ts", "n"))
    rows = spark.range(500).selectExpr("concat('k', id % 17) as k", "concat('a', id) as a", "concat('b', id) as b",
                                       "cast(id * 31 % 101 as int) as ts", "id as n")
    rows.repartition(5).write.parquet(source)
    ST.run_upsert(ST.read_folder(spark, source, rows.schema, 1), merge, log, checkpoint)
    want = sorted(map(tuple, UP.upsert(None, rows, merge).collect()))
    assert sorted(map(tuple, ST.read_upserted(spark, merge, log).collect())) == want
    ST.run_upsert(ST.read_folder(spark, source, rows.schema, 1), merge, log, checkpoint)  # nothing new
    ST.compact(spark, merge, log, str(tmp_path / "folded"))
    assert sorted(map(tuple, ST.read_upserted(spark, merge, str(tmp_path / "folded")).collect())) == want


def test_retries_end_done_or_dead(spark, tmp_path):
    items = spark.createDataFrame([("ok", 0, 1), ("twice", 2, 1), ("never", 99, 1), ("early", 99, 0), ("late", 0, 9)], "url string, failures int, attempt int")
    items.write.parquet(str(tmp_path / "frontier/start"))
    ended = ST.run_retries(spark, str(tmp_path / "frontier"), lambda: F.col("attempt") <= F.col("failures"),
                           str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert {r.url: (r.attempt, r.status) for r in ended.collect()} == {"ok": (1, "done"), "twice": (3, "done"), "never": (4, "dead"),
                                                                        "early": (4, "dead"), "late": (9, "done")}


# --- plans -------------------------------------------------------------------------------------

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limits_apply_before_the_shuffle(spark):
    for name in ("first_seen_url", "image_first_seen", "image_retry_budget"):
        plan = plan_of(entry.queries()[name](spark, SMALL))
        assert re.search(r"WindowGroupLimit .*Partial", plan) and plan.index("Final") < plan.index("Partial"), name


def test_scans_read_only_what_they_need(spark):
    for name in ("page_kind", "host_pages", "image_quality_gate", "relation_by_hash", "seed_rules_unpivot"):
        assert "html" not in plan_of(entry.queries()[name](spark, SMALL)), name
    plan = plan_of(entry.queries()["blog_upsert"](spark, SMALL))
    assert "PushedFilters: [" in plan and "user_id" in plan and "EqualTo(event_type,view)" in plan


def test_hot_join_key_is_split(spark):
    """A seed that owns most links: without broadcast its partition becomes several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        from weblake.operators.links import in_scope
        links = spark.range(0, 60000, numPartitions=6).selectExpr(
            "if(id % 3 = 0, 1, id % 500) as seed_id", "concat('http://h', if(id % 3 = 0, 1, id % 500), '/', id) as link")
        seeds = spark.range(500).selectExpr("id as seed_id", "concat('http://h', id, '/') as seed_url")
        scoped = in_scope(links, seeds)
        assert scoped.count() == 60000
        counted = scoped.groupBy().count()
        counted.collect()
        assert "skew=true" in plan_of(counted) or "isSkew" in plan_of(counted)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_enqueue_reads_its_bounds_in_the_same_query(spark):
    queue = spark.createDataFrame([("a", 1)], "url_sha1 string, ord bigint")
    assert "Subquery" in plan_of(FR.enqueue(queue, queue))


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert work_root(spark)

    class Context:
        master = "spark://cluster:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        work_root(Session())
    monkeypatch.setattr(Conf, "get", lambda self, key, default=None: "hdfs://shared/weblake/")
    assert work_root(Session()) == "hdfs://shared/weblake"
