"""Mixing of sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weblake.llm.common import WORD, free_names, partitions, with_length
from weblake.session import Work

#: Words of a shard, and how many shards a source has at most: both the shards of a source and the
#: documents of a shard then stay small enough to be sorted by one task.
SHARD_WORDS = 250_000
MAX_SHARDS = 4096
_WORDS = re.compile(WORD.encode())


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def running(work: Work, name: str, df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with the sum of each expression over the rows before and up to each row in ``order``.

    Rows are dealt out by ranges of ``order`` and summed within a range; the totals of the earlier
    ranges, one row each, are added.
    """
    placed = work.table(name, df.repartitionByRange(partitions(work.spark), *order).withColumn("_part", F.spark_partition_id()))
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = placed.groupBy("_part").agg(*(F.sum(F.expr(e)).alias(f"_{n}") for n, e in sums.items()))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    summed = placed.withColumns({n: F.sum(F.expr(e)).over(within) for n, e in sums.items()})
    return summed.join(before, "_part").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *(f"_{n}" for n in sums))


def targets(work: Work, sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with key (1, 2, ... by code point, null last) and target.

    The targets are ``level`` times the weight but at most ``most`` times the size: what a source
    cannot take is shared by the others by weight. The level is where they add up to ``share`` of all.
    """
    keyed = running(work, "keyed", sources, [F.col("source").asc_nulls_last()], {"key": "1"})
    cycle = F.array(*(F.lit(w) for w in weights))
    keyed = work.table("weighed", keyed.withColumn("weight", F.element_at(cycle, ((F.col("key") - 1) % len(weights) + 1).cast("int")))
                       .withColumn("cap", F.col("source_size") * F.lit(float(most))))
    total, weight = keyed.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = (total or 0) * share
    by_cap = running(work, "capped", keyed, [(F.col("cap") / F.col("weight")).asc(), F.col("key").asc()], {"caps": "cap", "used": "weight"})
    level = (F.lit(goal) - (F.col("caps") - F.col("cap"))) / (F.lit(weight) - F.col("used") + F.col("weight"))
    fits = by_cap.select(level.alias("level"), (F.col("cap") / F.col("weight")).alias("ratio"))
    found = fits.filter("level <= ratio").agg(F.max("level")).first()[0]
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.col("weight") * F.lit(found))
    return work.table("targets", keyed.select("source", "source_size", "key", target.alias("target")))


def sainte_lague(df: DataFrame, group: Sequence[str], votes: str, seats: Column, order: Sequence[str]) -> DataFrame:
    """``df`` with ``seats`` allocated within each group in proportion to ``votes`` by highest quotients.

    ``seats`` is the same for all rows of a group. Votes over the natural divisor, rounded, give all
    but a few seats; what is over or missing, at most about half a seat a row, is settled among the
    next quotients votes / (2n + 1), of which each row gives as many as it can need. So as many rows
    are sorted as have votes, not as there are seats. Ties go to the first in ``order``. Groups
    without votes get no seats.
    """
    over = W.partitionBy(*group)
    start = (df.withColumn("_seats", seats).withColumn("_votes", F.sum(votes).over(over)).withColumn("_rows", F.count("*").over(over))
             .withColumn("_first", F.when(F.col("_votes") > 0, F.floor(F.col(votes) * F.col("_seats") / F.col("_votes") + 0.5)).otherwise(0).cast("bigint"))
             .withColumn("_rest", F.when(F.col("_votes") > 0, F.col("_seats")).otherwise(0) - F.sum("_first").over(over)))
    needed = F.floor(F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(0) * (F.abs("_rest") + F.col("_rows"))).cast("bigint") + 2
    # Steps up are n, n + 1, ...: the quotients of the next seats. Steps down are n - 1, n - 2, ...: those of the last seats.
    up = F.col("_rest") > 0
    steps = (F.when(F.col("_rest") == 0, F.array().cast("array<bigint>"))
             .when(up, F.sequence(F.col("_first"), F.col("_first") + needed - 1))
             .otherwise(F.filter(F.sequence(F.col("_first") - needed, F.col("_first") - 1), lambda n: n >= 0)))
    quotients = start.select(*group, *order, "_rest", F.explode(steps).alias("_n"), F.col(votes).alias("_v")).withColumn(
        "_q", F.col("_v") / (2 * F.col("_n") + 1))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(
        F.when(F.col("_rest") > 0, -F.col("_q")).otherwise(F.col("_q")),
        *(F.when(F.col("_rest") > 0, F.col(o)).otherwise(-F.col(o)) for o in order), "_n"))
    moved = (quotients.withColumn("_rank", rank).filter(F.col("_rank") <= F.abs("_rest"))
             .groupBy(*group, *order).agg(F.sum(F.signum("_rest")).cast("bigint").alias("_moved")))
    out = start.join(moved, [*dict.fromkeys([*group, *order])], "left")
    return out.withColumn("seats", F.col("_first") + F.coalesce("_moved", F.lit(0))).drop(
        "_seats", "_votes", "_rows", "_first", "_rest", "_moved")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 16,
        seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, the words that the mix takes of each row.

    ``keep`` names columns of ``docs`` that come along in a struct ``row``; without it no text is shuffled.

    Blocks of ``block`` words are apportioned to the sources by their targets, then to the shards of a
    source by their words. The documents of a shard in a seeded order, twice over, are its blocks; the
    shard takes the first of them up to its quota, or all where the source's target is its cap. So a document is taken whole, twice, in part or not
    at all, and a rerun takes the same. Null texts have size 0, null sources are one source, repeated
    rows are separate documents that share a place in the order. An empty table gives no rows.
    """
    if most > 2:
        raise ValueError("a document is taken twice at most")
    work = Work(docs.sparkSession, "mixing")
    sized = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("text_hash"),
                        *([F.struct(*keep).alias("row")] if keep else []))
    sizes = work.table("sizes", sized.drop("row"))
    sources = targets(work, sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    quotas = sainte_lague(sources.withColumn("all", F.lit(1)), ["all"], "target", F.lit(round(total / block)).cast("bigint"), ["key"])
    quotas = work.table("quotas", quotas.select(
        F.col("source").alias("_source"), "key", "source_size", "target", F.col("seats").alias("source_blocks"),
        F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / SHARD_WORDS) + 1).cast("bigint").alias("shards")))

    def sharded(df):
        joined = df.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        joined = joined.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
        return joined.withColumn("shard", F.pmod("place", "shards"))

    rows = sharded(sizes)
    shards = rows.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("source_blocks").alias("blocks"),
                                            F.first(F.col("target") >= F.col("source_size") * most).alias("full"))
    shards = sainte_lague(shards, ["key"], "words", F.col("blocks"), ["shard"])
    shards = shards.select("key", "shard", "words", F.when(
        F.col("full"), F.ceil(F.col("words") * F.lit(float(most)))).otherwise(F.col("seats") * block).alias("wanted"))
    order = W.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "place"), "doc_id", "text_hash")
    upto = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    shards = work.table("shards", shards)
    placed = (sharded(sized) if keep else rows).join(shards, ["key", "shard"]).withColumn("_before", upto - F.col("size"))

    def part(before):
        return F.greatest(F.lit(0), F.least(F.col("size"), F.col("wanted") - before))
    taken = part(F.col("_before")) + part(F.col("_before") + F.col("words"))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"),
                         *(["row"] if keep else []))


def cut(text: str | None, size: int, taken: int) -> str:
    """The first ``taken`` words of a text of ``size`` words, written again and again on lines of its own as needed."""
    if not size or not taken:
        return ""
    whole, rest = divmod(taken, size)
    parts = [text] * whole
    if rest:
        data = text.encode("utf-8", "surrogatepass")
        end = next(itertools.islice(_WORDS.finditer(data), rest - 1, None)).end()
        parts.append(data[:end].decode("utf-8", "surrogatepass"))
    return "\n".join(parts)


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` as the mix takes them: documents that it does not take go, the text of the others holds the
    words taken, and a column n_chars is brought up to date. Texts without words are never taken."""
    @F.pandas_udf("string")
    def run(text: pd.Series, size: pd.Series, taken: pd.Series) -> pd.Series:
        return pd.Series([cut(*x) for x in zip(text, size, taken)])

    size, taken = free_names(docs.columns, "words_held", "words_taken")
    found = mix(docs, keep=docs.columns, **parameters).filter("taken > 0").select(
        "row.*", F.col("size").alias(size), F.col("taken").alias(taken))
    changed = found.withColumn("text", F.when(F.col(size) == F.col(taken), F.col("text")).otherwise(run("text", size, taken)))
    return with_length(changed).select(*docs.columns)
