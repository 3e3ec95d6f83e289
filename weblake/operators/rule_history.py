"""Extraction rules that change while pages come in: a page is read by the rules in force when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weblake.operators.rules import RULE_FIELDS, selector_problem

#: Versions of a seed's rules in one row of a history.
PACK = 64
XPATH_FIELDS = tuple(field for field in RULE_FIELDS if field.endswith("_xpath"))


def _changed(changes: DataFrame) -> DataFrame:
    """One row per (seed, time): the fields that changed then, each with its new selector, null where it is unset."""
    known = changes.filter(F.col("field").isin(*XPATH_FIELDS) & F.col("seed_id").isNotNull() & F.col("since").isNotNull())
    selector = F.when((F.col("selector") != "") & selector_problem("selector").isNull(), F.col("selector"))
    # Of several changes of a field at one time the greatest selector counts, whatever the order of the rows.
    one = known.groupBy("seed_id", "since", "field").agg(F.max("selector").alias("selector")).withColumn("selector", selector)
    # A struct, as a field that is unset must hide what was there before.
    return one.groupBy("seed_id", "since").agg(*(
        F.max(F.when(F.col("field") == field, F.struct("selector"))).alias(field) for field in XPATH_FIELDS))


def _in_force(changed: DataFrame, chunk: str) -> DataFrame:
    """Each change with all fields as they stand from then on.

    The last values before a chunk of time come from one row per (seed, chunk), so the changes of a busy
    seed are carried forward in as many tasks as it has chunks.
    """
    chunked = changed.withColumn("_chunk", F.date_trunc(chunk, "since"))
    ends = chunked.groupBy("seed_id", "_chunk").agg(*(
        F.max_by(field, F.when(F.col(field).isNotNull(), F.col("since"))).alias(field) for field in XPATH_FIELDS))
    earlier = W.partitionBy("seed_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    before = ends.select("seed_id", "_chunk", *(
        F.last(field, ignorenulls=True).over(earlier).alias(f"_{field}") for field in XPATH_FIELDS))
    so_far = W.partitionBy("seed_id", "_chunk").orderBy("since").rowsBetween(W.unboundedPreceding, 0)
    return chunked.join(before, ["seed_id", "_chunk"]).select("seed_id", "_chunk", "since", *(
        F.coalesce(F.last(field, ignorenulls=True).over(so_far), F.col(f"_{field}")).alias(field) for field in XPATH_FIELDS))


def rule_history(changes: DataFrame, chunk: str = "month") -> DataFrame:
    """changes(seed_id, field, selector, since) → history(seed_id, since, until, versions).

    A change sets a field of a seed from its time on; a null or empty selector, or one that is not
    understood (see ``rejected_rules``), unsets it. ``versions`` are the at most :data:`PACK` rule maps of
    [since, until), each with its own start; the last row of a seed has no end. Changes without a seed or a
    time, and of fields that are no selectors, do not count. Of changes of one field at one time the
    greatest selector counts. ``since`` may be a date or a timestamp.
    """
    entries = F.array(*(F.struct(F.lit(field).alias("key"), F.col(f"{field}.selector").alias("value")) for field in XPATH_FIELDS))
    rules = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    in_force = _in_force(_changed(changes), chunk).select("seed_id", "_chunk", "since", rules.alias("rules"))
    number = F.row_number().over(W.partitionBy("seed_id", "_chunk").orderBy("since"))
    packs = (in_force.withColumn("_pack", F.floor((number - 1) / PACK)).groupBy("seed_id", "_chunk", "_pack")
             .agg(F.min("since").alias("since"), F.array_sort(F.collect_list(F.struct("since", "rules")), _by_start).alias("versions")))
    until = F.lead("since").over(W.partitionBy("seed_id").orderBy("since"))
    ends = packs.select("seed_id", "since", until.alias("until"))  # narrow: the maps stay out of the window over a seed
    return packs.join(ends, ["seed_id", "since"]).select("seed_id", "since", "until", "versions")


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["since"] < b["since"], -1).when(a["since"] > b["since"], 1).otherwise(0)


def with_rules_at(items: DataFrame, history: DataFrame, at: str) -> DataFrame:
    """Give each item the ``rules`` of its seed in force at its time: the as-of form of ``with_rules``.

    An item meets the one row of its seed whose span holds its time and picks the version there; it is never
    multiplied. Items before the first change of their seed, without a time or of unknown seeds have
    null rules. ``items`` may be a stream, which reads ``history`` anew for each batch.
    """
    spans = history.select(F.col("seed_id").alias("_seed"), F.col("since").alias("_since"), F.col("until").alias("_until"),
                           F.col("versions").alias("_versions"))
    time = F.col(f"`{at}`")
    holds = (F.col("seed_id") == F.col("_seed")) & (F.col("_since") <= time) & (F.col("_until").isNull() | (time < F.col("_until")))
    started = F.filter("_versions", lambda v: v["since"] <= time)
    return (items.join(spans, holds, "left").withColumn("rules", F.try_element_at(started, F.lit(-1))["rules"])
            .drop("_seed", "_since", "_until", "_versions"))
