"""Streams that read folders of parquet files and run until what is there is done."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from weblake.config import HarvestConfig
from weblake.functions.urls import url_sha1
from weblake.operators.links import canonicalize, filter_links, links, scope_test
from weblake.operators.rules import DETAIL_FIELDS, parse_for_rules, with_rules
from weblake.operators.rule_history import with_rules_at
from weblake.operators.upsert import Merge
from weblake.plans.expand import ITEM_DDL, expand
from weblake.plans.harvest import product_fields
from weblake.streaming.politeness import polite

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_folder(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _finish(writer) -> None:
    """Run all available input, then stop: the idle end of a round."""
    writer.trigger(availableNow=True).start().awaitTermination()


def dedup_urls(items: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """First sight of each url_sha1.

    Exact without a watermark, and then the state grows with all URLs ever seen, so it is kept in
    RocksDB. ``watermark=(column, delay)`` bounds the state and forgets older URLs.
    """
    if watermark is None:
        return items.dropDuplicates(["url_sha1"])
    return items.withWatermark(*watermark).dropDuplicatesWithinWatermark(["url_sha1"])


@contextmanager
def _rocksdb(spark: SparkSession):
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_url_dedup(spark: SparkSession, items: DataFrame, out: str, checkpoint: str) -> DataFrame:
    unique = dedup_urls(items.select("url", "url_sha1"))
    with _rocksdb(spark):
        run_append(unique, out, checkpoint)
    return spark.read.schema(unique.schema).parquet(out)


def run_polite(spark: SparkSession, items: DataFrame, out: str, checkpoint: str, **how) -> DataFrame:
    """Replay a recorded queue (:func:`polite` by its own times), append what is let go to ``out`` and return all of ``out``.

    What is not due stays in the state, and the next run with the same checkpoint goes on with it.
    """
    released = polite(items, clock="event", **how)
    with _rocksdb(spark):
        run_append(released, out, checkpoint)
    return spark.read.schema(released.schema).parquet(out)


def start_polite(spark: SparkSession, items: DataFrame, out: str, checkpoint: str, every: str = "1 second", **how):
    """Start the job that lets go of a live queue (:func:`polite` by the clock on the wall) and return its query.

    It never ends by itself, as timers may always come; stopped and started again, it goes on.
    """
    with _rocksdb(spark):
        return (polite(items, **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(processingTime=every).start())


def run_upsert(updates: DataFrame, merge: Merge, log: str, checkpoint: str) -> None:
    """Append each batch, merged per key, to a log folder.

    The merge is associative, so a batch never rewrites the table: readers combine the log, and
    :func:`compact` folds it from time to time. A repeated batch overwrites its own folder, whose name
    has the checkpoint's, so a run with a new checkpoint adds to the log.
    """
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        merge.combine(merge.from_updates(batch)).write.mode("overwrite").parquet(f"{log}/run={run}/batch={batch_id}")

    _finish(updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def read_upserted(spark: SparkSession, merge: Merge, log: str) -> DataFrame:
    return merge.table(merge.combine(spark.read.parquet(log).drop("run", "batch")))


def compact(spark: SparkSession, merge: Merge, log: str, folded: str) -> None:
    """Write the log as one batch of a new log; switch readers and writers to it afterwards."""
    merge.combine(spark.read.parquet(log).drop("run", "batch")).write.mode("overwrite").parquet(f"{folded}/run=folded/batch=-1")


def page_links(pages: DataFrame, seeds: DataFrame, config: HarvestConfig | None = None) -> DataFrame:
    """Valid links in scope of a stream of pages(page_id, url, html, seed_id). Stateless.

    ``seeds(seed_id, seed_url)`` is a static table and is read anew for each batch.
    """
    config = config or HarvestConfig.blog()
    found = filter_links(canonicalize(links(pages, ("page_id", "url", "seed_id"))), "link",
                         config.deny_extensions, config.deny_hosts)
    scoped = found.join(seeds.select("seed_id", "seed_url"), "seed_id").filter(
        scope_test(F.col("link"), F.col("seed_url"), config.scope))
    return scoped.withColumn("url_sha1", url_sha1(F.col("link"))).drop("seed_url")


def product_rows(pages: DataFrame, by_seed: DataFrame, at: str | None = None) -> DataFrame:
    """Fields and outcome of a stream of detail pages(page_id, url, html, seed_id). Stateless.

    ``by_seed`` (of ``seed_rules``) is a static table and is read anew for each batch. With ``at``, the time
    of a page, it is a history (of ``rule_history``), and a page is read by the rules in force then.
    """
    ruled = with_rules(pages, by_seed) if at is None else with_rules_at(pages, by_seed, at)
    parsed = parse_for_rules(ruled, ("page_id", "url", "seed_id"), DETAIL_FIELDS)
    return product_fields(parsed, ("seed_id",))


def run_refresh(spark: SparkSession, seeds: DataFrame, pages: DataFrame, config: HarvestConfig, folder: str,
                checkpoint: str, rules: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Walk from the seeds (of ``read_seeds``) that a stream brings, and return all items of all rounds.

    Each batch is a round: what earlier rounds reached is visited, so seeds that come again and pages
    known before start nothing. A run ends when no seed is left; the next one goes on from there. A
    repeated batch walks in a folder of its own and overwrites its round. ``edges``, written :func:`blog_edges` of the
    same pages, save every round their extraction.
    """
    rounds, schema = f"{folder}/rounds", f"{ITEM_DDL}, level int"

    def walk(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/seeds/batch={number}")
        new = spark.read.schema(batch.schema).parquet(f"{folder}/seeds/batch={number}")
        earlier = spark.read.schema(f"{schema}, batch bigint").parquet(rounds).filter(F.col("batch") < number) if number else None
        crawl = expand(spark, new, pages, config, f"{folder}/walk-{uuid.uuid4().hex}", rules,
                       None if earlier is None else earlier.select("url_sha1"), edges=edges)
        crawl.write.mode("overwrite").parquet(f"{rounds}/batch={number}")

    _finish(seeds.writeStream.foreachBatch(walk).option("checkpointLocation", checkpoint))
    return spark.read.schema(f"{schema}, batch bigint").parquet(rounds)


def run_append(df: DataFrame, out: str, checkpoint: str) -> None:
    _finish(df.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).outputMode("append"))


def run_retries(spark: SparkSession, folder: str, failed: Callable[[], Column], out: str, checkpoint: str,
                max_attempts: int = 4) -> DataFrame:
    """Work off a frontier folder; failed items come back with attempt + 1 as new files in it.

    Rounds go on until one brings nothing back. Writes ``status`` done or dead per item to ``out``.
    An item with a null attempt has used up its tries, one with a null outcome has failed, so none is lost.
    A batch is tried once: what came of it is written first, and both the ended and the returning
    items are read from there. Each batch overwrites its own folders, so a repeat changes nothing.
    """
    schema = spark.read.option("recursiveFileLookup", "true").parquet(folder).schema
    with_outcome = StructType([*schema.fields, StructField("_failed", BooleanType())])
    returned = []

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_failed", F.coalesce(failed(), F.lit(True))).write.mode("overwrite").parquet(f"{out}/tried/batch={batch_id}")
        tried = spark.read.schema(with_outcome).parquet(f"{out}/tried/batch={batch_id}")
        spent = F.coalesce(F.col("attempt") >= max_attempts, F.lit(True))
        ended = tried.filter(~F.col("_failed") | spent).withColumn(
            "status", F.when(F.col("_failed"), "dead").otherwise("done"))
        ended.drop("_failed").write.mode("overwrite").parquet(f"{out}/ended/batch={batch_id}")
        again = tried.filter(F.col("_failed") & ~spent).drop("_failed")
        again.withColumn("attempt", F.col("attempt") + 1).write.mode("overwrite").parquet(
            f"{folder}/retry/batch={batch_id}")
        returned.append(not again.isEmpty())

    while True:
        returned.clear()
        _finish(read_folder(spark, folder, schema).writeStream.foreachBatch(work)
                .option("checkpointLocation", checkpoint))
        if not any(returned):
            return spark.read.parquet(f"{out}/ended").drop("batch")
