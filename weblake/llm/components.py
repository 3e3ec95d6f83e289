"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weblake.session import Work


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()


def components(work: Work, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the root is the smallest node that it reaches.

    A step points each node's neighbours at the smallest of them, which needs one aggregate with
    map-side combine and one join, so a node with very many edges is never gathered; the number of
    edges never grows, and a chain of n nodes needs about log n rounds. Each round is a written
    table. Self links are dropped, repeated links count once, nulls are no nodes. No edges: no rows.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    current = work.table(f"{name}_0", edges.filter("a is not null and b is not null and a <> b")
                         .select(most.alias("a"), least.alias("b")).distinct())
    state, number = _state(current), 0
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work.table(f"{name}_large", large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        number += 1
        current, before = work.table(f"{name}_{number}", small), state
        state = _state(current)
        work.drop(f"{name}_{number - 1}")
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
