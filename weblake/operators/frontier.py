"""The crawl frontier: order, first-seen, visited, take, requeue, politeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weblake.functions import urls as U

CHUNK = 65536


def first_seen(candidates: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Of all rows with one key, the first in queue order.

    The filter on row_number makes Spark limit each group before the shuffle as well, so a key that
    holds a third of the rows still sends one row per map task.
    """
    return (candidates.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .filter(F.col("_rank") == 1).drop("_rank"))


def unseen(candidates: DataFrame, visited: DataFrame, key: str = "url_sha1") -> DataFrame:
    """Candidates whose key was not visited; give it first-seen candidates, so that no key is hot."""
    return candidates.join(visited.select(key), key, "left_anti")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column | None,
           out: str = "rank") -> DataFrame:
    """1-based row number per key group without bringing a group into one task.

    ``chunk`` must not decrease along ``order`` within a group. Rows are numbered per (group, chunk);
    the rows in earlier chunks, counted with map-side combine, are added. ``chunk=None`` is for
    groups known to fit one chunk.
    """
    if chunk is None:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    rows = df.withColumn("_chunk", chunk).withColumn(
        "_n", F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order)))
    sizes = df.groupBy(*keys, chunk.alias("_chunk")).agg(F.count("*").alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return (rows.join(before, [*keys, "_chunk"]).withColumn(out, F.col("_before") + F.col("_n"))
            .drop("_chunk", "_n", "_before"))


def in_order(df: DataFrame, order: Sequence[str], out: str = "ord") -> DataFrame:
    """``df`` with a number that grows along ``order``, with gaps; write it before using the numbers twice.

    Rows are dealt out by ranges and sorted within them, so no task numbers them all, whatever the keys.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id())


def fetch_plan(frontier: DataFrame, delay: float = 0.25, url: str = "url", order: str = "ord",
               chunk: Column | None = None) -> DataFrame:
    """Planned start of each request in seconds: one request per host and ``delay``, in queue order."""
    chunk = F.floor(F.col(order) / CHUNK) if chunk is None else chunk
    hosted = frontier.withColumn("host", U.domain(F.col(url)))
    return (ranked(hosted, ["host"], [order], chunk, "_turn")
            .withColumn("start_at", (F.col("_turn") - 1) * F.lit(delay)).drop("_turn"))


def _tail(frontier: DataFrame) -> Column:
    return F.coalesce(frontier.select(F.max("ord")).scalar(), F.lit(-1))


def enqueue(frontier: DataFrame, new: DataFrame) -> DataFrame:
    """Append ``new`` behind the queue, keeping its own order."""
    moved = new.withColumn("ord", _tail(frontier) + 1 + F.col("ord") - F.coalesce(
        new.select(F.min("ord")).scalar(), F.lit(0)))
    return frontier.unionByName(moved.select(*frontier.columns))


def take(frontier: DataFrame, n: int, order: str = "fifo") -> DataFrame:
    """The n oldest (fifo) or newest (lifo) items."""
    direction = {"fifo": F.col("ord").asc(), "lifo": F.col("ord").desc()}[order]
    return frontier.orderBy(direction).limit(n)


def remainder(frontier: DataFrame, taken: DataFrame) -> DataFrame:
    return frontier.join(taken.select("ord"), "ord", "left_anti")


def requeue(frontier: DataFrame, failed: DataFrame, max_attempts: int = 4) -> DataFrame:
    """Put failed items back at the tail, without a visited test, until their attempts are used up.

    Those whose attempts are used up are the rows of :func:`spent`.
    """
    again = failed.filter(F.col("attempt") < max_attempts).withColumn("attempt", F.col("attempt") + 1)
    return enqueue(frontier, again)


def spent(failed: DataFrame, max_attempts: int = 4) -> DataFrame:
    """Failed items that :func:`requeue` does not take back: the dead letters."""
    return failed.filter(F.coalesce(F.col("attempt") >= max_attempts, F.lit(True)))


def visited_union(visited: DataFrame, new: DataFrame, key: str = "url_sha1") -> DataFrame:
    return visited.select(key).union(new.select(key)).distinct()


def visited_except(candidates: DataFrame, visited: DataFrame, key: str = "url_sha1") -> DataFrame:
    return candidates.select(key).distinct().join(visited.select(key), key, "left_anti")


def status(seeds: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Seeds read, queue length per seed and visited size as one table (metric, seed_id, n)."""
    def total(df, metric):
        return df.agg(F.count("*").alias("n")).select(
            F.lit(metric).alias("metric"), F.lit(None).cast("bigint").alias("seed_id"), "n")

    queued = frontier.groupBy("seed_id").agg(F.count("*").alias("n")).select(
        F.lit("queued").alias("metric"), "seed_id", "n")
    return (total(seeds, "seeds").unionByName(queued)
            .unionByName(total(visited.select("url_sha1").distinct(), "visited")))
