"""Breadth-first frontier expansion over stored pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weblake.config import HarvestConfig, PRODUCT_LIST
from weblake.functions.urls import url_sha1
from weblake.operators.frontier import first_seen, in_order, unseen
from weblake.operators.links import below_depth, canonicalize, filter_links, links, scope_test
from weblake.operators.rules import LIST_FIELDS, extract_list_links, parse_for_rules, rejected_rules, seed_rules, with_rules
from weblake.operators.rule_history import rule_history, with_rules_at
from weblake.sources.state import load_state
from weblake.sources.versions import listed, put_mark, remove

ITEM_DDL = ("url string, url_sha1 string, seed_id bigint, seed_url string, depth int, pagetype int, "
            "category string, category_1 string, ord bigint")
_ITEM = [part.split()[0] for part in ITEM_DDL.split(", ")]


def page_key(url: Column, blog: bool) -> Column:
    """Key under which a frontier item finds its page; blog links carry no trailing "/".

    Without a regular expression, as Spark filters a scan by the keys of a join only where they are cheap.
    """
    return url_sha1(F.when(url.endswith("/"), F.left(url, F.length(url) - 1)).otherwise(url) if blog else url)


def fetched_at(items: DataFrame, pages: DataFrame, history: DataFrame, at: str) -> DataFrame:
    """Stored pages of product ``items`` (one row per item and page), with ``rules`` as of each page's time ``at``.

    The items meet the pages' keys and times first, narrow rows both, and then the rules; html joins only them.
    """
    key = page_key(F.col("url"), False).alias("page_key")
    narrow = items.filter(F.col("url") != "").withColumn("page_key", key).drop("url")
    times = narrow.join(pages.select(key, F.col(f"`{at}`").alias("_at")), "page_key").distinct()
    ruled = with_rules_at(times, history, "_at")
    stored = pages.withColumn("page_key", key).withColumnRenamed(at, "_fetched")
    same = (stored["page_key"] == ruled["page_key"]) & stored["_fetched"].eqNullSafe(ruled["_at"])
    return stored.join(ruled, same).drop("page_key", "_at", "_fetched")


def blog_edges(pages: DataFrame, config: HarvestConfig) -> DataFrame:
    """edges(page_key, pos, link, link_sha1): extracted once for all pages, without their html."""
    keyed = pages.select(page_key(F.col("url"), True).alias("page_key"), "url", "html")
    found = filter_links(canonicalize(links(keyed, ("page_key", "url"))), "link",
                         config.deny_extensions, config.deny_hosts)
    return found.select("page_key", "pos", "link", url_sha1(F.col("link")).alias("link_sha1"))


def bucket_count(spark: SparkSession, df: DataFrame, bucket_bytes: int = 128 << 20) -> int:
    """Buckets for a table derived from ``df``: the session's partitions, more where the files that ``df``
    reads need them, as bucketed scans are not split.

    Only the sizes of the tables read count: estimates of joins are products, and inputs without a
    known size report the largest number there is.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = max((n for n in sizes if n < 1 << 60), default=0)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), known // bucket_bytes)


class KeyLog:
    """Keys in a bucketed table that grows by appending: a join on the key does not shuffle them again."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.table = f"weblake_keys_{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> None:
        (df.select(self.key).repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key)
         .mode("append").option("path", self.path).saveAsTable(self.table))

    def keys(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the entry; the files stay in the folder."""
        self.spark.sql(f"drop table if exists {self.table}")


class Expansion:
    """One harvest walk. Each level is a written folder, so a lost executor never replays earlier levels."""

    def __init__(self, spark: SparkSession, config: HarvestConfig, folder: str, at: str | None = None, edges: DataFrame | None = None):
        self.spark, self.config, self.folder, self.at, self.edges = spark, config, folder, at, edges
        self.blog = config.kind == "blog"
        self.tables: list[str] = []

    def _table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _bucketed(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """A table that every level joins on ``key``: shuffled here once, and not again per level."""
        name = f"{name}-{uuid.uuid4().hex}"
        table = f"weblake_{name.replace('-', '_')}"
        (df.repartition(self.buckets, key).write.bucketBy(self.buckets, key).option("path", f"{self.folder}/{name}")
         .saveAsTable(table))
        self.tables.append(table)
        return self.spark.table(table)

    def _level(self, number: int, items: DataFrame) -> DataFrame:
        """Write a level, then its mark: a level without one was cut off and is written anew."""
        items = self._table(f"crawl/level={number}", items.select(*_ITEM))
        put_mark(self.spark, f"{self.folder}/marks/{number}")
        return items

    def last_level(self) -> int:
        """Number of the last level that was written whole; 0: none."""
        return max((int(path.rsplit("/", 1)[1]) for path in listed(self.spark, f"{self.folder}/marks/*")), default=0)

    def _kept(self) -> tuple[int, DataFrame, DataFrame]:
        """Last level, its items, and the keys of the items before them, as far as ``config.init_level`` keeps them."""
        number = self.last_level()
        whole = self.crawled()
        state = load_state({"frontier": whole.filter(F.col("level") == number).select(*_ITEM),
                            "visited": whole.select("url_sha1", "level")}, self.config)
        if self.config.init_level == 0:
            state["visited"] = state["visited"].filter(F.col("level") < number)
        return number, state["frontier"], state["visited"]

    def crawled(self) -> DataFrame:
        """All items reached so far, of levels that are whole."""
        found = self.spark.read.schema(f"{ITEM_DDL}, level int").parquet(f"{self.folder}/crawl")
        return found.filter(F.col("level") <= self.last_level())

    def _follow_edges(self, items: DataFrame, edges: DataFrame) -> DataFrame:
        keyed = items.withColumn("page_key", page_key(F.col("url"), True))
        found = keyed.join(edges, "page_key").filter(
            scope_test(F.col("link"), F.col("seed_url"), self.config.scope))
        return found.select(
            F.col("link").alias("url"), F.col("link_sha1").alias("url_sha1"), "seed_id", "seed_url",
            (F.col("depth") + 1).alias("depth"), "pagetype", "category", "category_1",
            F.col("ord").alias("parent_ord"), F.lit(0).alias("priority"), "pos")

    def _follow_rules(self, lists: DataFrame, pages: DataFrame, by_seed: DataFrame) -> DataFrame:
        """Links of the list pages among a level's items. Only their html is parsed, and only their html moves: the keys, a
        written table of known size, meet the page scan before the rules do. Beside the rules the items have no size that Spark
        knows, so it would shuffle all pages at every level. Keys too many to broadcast are a good part of the pages."""
        if self.at is not None:
            fetched = fetched_at(lists.drop("url_sha1"), pages.select("url", "html", self.at), by_seed, self.at)
        else:
            lists = lists.withColumn("page_key", page_key(F.col("url"), False)).drop("url", "url_sha1")
            keyed = pages.select(page_key(F.col("url"), False).alias("page_key"), "url", "html")
            reached = keyed.join(self._table("list_keys", lists.select("page_key").distinct()), "page_key", "left_semi")
            fetched = reached.join(with_rules(lists, by_seed), "page_key")
        kept = [c for c in fetched.columns if c not in ("html", "page_key")]
        found = extract_list_links(parse_for_rules(fetched, kept, LIST_FIELDS, nodes=False), self.config.deny_extensions, self.config.deny_hosts)
        return found.select(
            F.col("link").alias("url"), url_sha1(F.col("link")).alias("url_sha1"), "seed_id", "seed_url",
            (F.col("depth") + 1).alias("depth"), "pagetype", "category", "category_1",
            F.col("ord").alias("parent_ord"), "priority", "pos")

    def run(self, seeds: DataFrame, pages: DataFrame, rules: DataFrame | None = None,
            visited: DataFrame | None = None, resume: bool = False, levels: int | None = None) -> DataFrame:
        """Walk from ``seeds`` (of ``read_seeds``); ``visited`` holds the keys of earlier harvests.

        ``levels`` is how many levels this run writes at most. With ``resume`` a walk that was stopped, or whose driver
        was lost, goes on in its folder: at start level 0 from the last whole level, at 1 from the seeds with
        what was visited kept, at 2 and 3 from nothing. Give it the same pages, rules and ``visited``.

        With ``at``, the column of ``pages`` with their fetch times, ``rules`` are changes (seed_id, field, selector,
        since), and a list is read by the rules in force when it was fetched; ``rules`` in the folder is their history.

        Rules whose selector is not understood are written to ``rejected_rules`` in the work folder, with
        ``walks`` false where their seed is left without a link rule.
        """
        self.buckets = bucket_count(self.spark, pages)
        self.seen = KeyLog(self.spark, f"{self.folder}/seen-{uuid.uuid4().hex}", "url_sha1", self.buckets)
        try:
            return self._walk(seeds, pages, rules, visited, resume, levels)
        finally:
            self.seen.close()
            for table in self.tables:  # the entries only; the files stay in the folder
                self.spark.sql(f"drop table if exists {table}")

    def _reject(self, rules: DataFrame, by_seed: DataFrame) -> None:
        follows = lambda held: F.exists(F.map_keys(held), lambda f: f.isin(*LIST_FIELDS))
        ever = follows("rules") if self.at is None else F.exists("versions", lambda v: follows(v["rules"]))
        walks = by_seed.groupBy("seed_id").agg(F.bool_or(ever).alias("_walks"))
        rejected = rejected_rules(rules).join(walks, "seed_id", "left")
        self._table("rejected_rules", rejected.withColumn("walks", F.coalesce("_walks", F.lit(False))).drop("_walks"))

    def _walk(self, seeds, pages, rules, visited, resume, levels):
        if self.blog:
            edges = self._bucketed("edges", blog_edges(pages, self.config) if self.edges is None else self.edges, "page_key")
        else:
            by_seed = self._table("rules", seed_rules(rules) if self.at is None else rule_history(rules))
            self._reject(rules, by_seed)
        number, keep = self.last_level() if resume else 0, self.config.init_level
        if number and keep in (2, 3):
            remove(self.spark, f"{self.folder}/crawl", f"{self.folder}/marks")
            number = 0
        done = number
        if number:
            number, items, earlier = self._kept()
            self.seen.add(earlier)
        if not number or keep == 1:
            start = seeds if visited is None else unseen(seeds, visited)
            start = first_seen(start.withColumn("ord", F.col("seed_id")), ["url_sha1"], ["ord"])
            number += 1
            items = self._level(number, start if number == 1 else unseen(start, self.seen.keys()))
        last = None if levels is None else done + levels
        while number != last and not items.isEmpty():
            self.seen.add(items)
            open_items = below_depth(items, self.config.depth_limit)
            if self.blog:
                found = self._follow_edges(open_items, edges)
            else:
                lists = open_items.filter(F.col("pagetype") == PRODUCT_LIST)
                if lists.isEmpty():
                    items = self._level(number + 1, items.limit(0))
                    break
                found = self._follow_rules(lists, pages, by_seed)
            new = unseen(first_seen(found, ["url_sha1"], ["parent_ord", "priority", "pos"]), self.seen.keys())
            if visited is not None:
                new = unseen(new, visited)
            number += 1
            items = self._level(number, in_order(new, ["parent_ord", "priority", "pos"]))
        return self.crawled()


def expand(spark: SparkSession, seeds: DataFrame, pages: DataFrame, config: HarvestConfig, folder: str,
           rules: DataFrame | None = None, visited: DataFrame | None = None, resume: bool = False,
           levels: int | None = None, at: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Every item the harvest reaches, each with the depth and seed of its first sighting. See :meth:`Expansion.run`.

    ``edges``, written :func:`blog_edges` of the same pages and settings, saves a blog walk their extraction.
    """
    return Expansion(spark, config, folder, at, edges).run(seeds, pages, rules, visited, resume, levels)


def reach(spark: SparkSession, starts: DataFrame, edges: DataFrame, depth_limit: int | None, folder: str) -> DataFrame:
    """node, depth of all nodes that an edge list reaches (the start has depth 1), within ``depth_limit`` steps if one is given.

    starts(node), edges(src, dst). A level is deduplicated before it meets the visited nodes, which are
    bucketed by node and never shuffled again.
    """
    def level(number, df):
        df.select("node").write.mode("overwrite").parquet(f"{folder}/reach/depth={number}")
        return spark.read.schema(df.select("node").schema).parquet(f"{folder}/reach/depth={number}")

    kind = starts.schema["node"].dataType.simpleString()
    buckets = bucket_count(spark, edges)
    table = f"weblake_reach_{uuid.uuid4().hex}"
    (edges.select("src", "dst").repartition(buckets, "src").write.bucketBy(buckets, "src")
     .option("path", f"{folder}/edges").saveAsTable(table))
    edges, seen = spark.table(table), KeyLog(spark, f"{folder}/seen", "node", buckets)
    nodes, depth = level(1, starts.distinct()), 1
    while (depth_limit is None or depth < depth_limit) and not nodes.isEmpty():
        seen.add(nodes)
        found = nodes.join(edges, nodes["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        depth += 1
        nodes = level(depth, found.join(seen.keys(), "node", "left_anti"))
    seen.close()
    spark.sql(f"drop table if exists {table}")
    return spark.read.schema(f"node {kind}, depth int").parquet(f"{folder}/reach")
