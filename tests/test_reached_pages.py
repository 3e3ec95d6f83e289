"""What a level of a walk reads and moves."""

from pyspark.sql import functions as F

from weblake.config import HarvestConfig
from weblake.functions.urls import url_sha1
from weblake.operators.rules import rules_from_seeds, seed_rules
from weblake.plans.expand import ITEM_DDL, Expansion, blog_edges
from weblake.session import work_dir
from weblake.streaming import streams as ST


def test_a_level_moves_the_html_of_reached_lists_only(spark):
    folder = work_dir(spark, "t")
    spark.range(2000).selectExpr("concat('http://s/', id) as url", "concat('<a href=\"/d', id, '\">d</a>') as html").write.parquet(f"{folder}/pages")
    spark.createDataFrame([("http://s/7", "k", 1, "http://s", 1, 3, "c", "all", 5)], ITEM_DDL).write.parquet(f"{folder}/lists")
    seed_rules(rules_from_seeds(spark.createDataFrame([(1, "//a/@href")], "id long, detailurl_xpath string"))).write.parquet(f"{folder}/rules")
    pages, lists, rules = (spark.read.parquet(f"{folder}/{name}") for name in ("pages", "lists", "rules"))
    found = Expansion(spark, HarvestConfig.product(), folder)._follow_rules(lists, pages, rules)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in next(line for line in plan.splitlines() if "LeftSemi" in line)
    assert [(r.url, r.seed_id, r.depth) for r in found.collect()] == [("http://s/d7", 1, 2)]


def test_rounds_take_links_that_are_there(spark):
    folder = work_dir(spark, "t")
    pages = spark.createDataFrame([(i, f"http://s/{i}", f'<a href="http://s/{i + 1}">n</a>') for i in range(4)], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("http://s/0", "http://s")], "url string, seed_url string").select(
        F.lit(1).cast("long").alias("seed_id"), "url", "seed_url", url_sha1(F.col("url")).alias("url_sha1"), F.lit(1).alias("depth"),
        F.lit(2).alias("pagetype"), F.lit("c").alias("category"), F.lit("all").alias("category_1"))
    seeds.write.parquet(f"{folder}/arrived")
    blog_edges(pages, HarvestConfig.blog()).write.parquet(f"{folder}/edges")
    unread = pages.withColumn("html", F.raise_error(F.lit("html was read")).cast("string"))
    items = ST.run_refresh(spark, ST.read_folder(spark, f"{folder}/arrived", seeds.schema), unread, HarvestConfig.blog(), f"{folder}/state",
                           f"{folder}/checkpoint", edges=spark.read.parquet(f"{folder}/edges"))
    assert sorted((r.url, r.depth) for r in items.collect()) == [(f"http://s/{i}", i + 1) for i in range(5)]
