"""Vectors as blocks: every block of rows meets every block of queries in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows and queries of a block, about: as many queries as rows, so a block of rows, and what is made of it,
#: goes to few tasks.
ROWS, QUERIES = 8192, 8192


def valid(vector: str) -> Column:
    """True for vectors whose components are all there and finite; empty vectors are none."""
    return F.expr(f"""coalesce(size({vector}) > 0 and forall({vector},
        x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity')), false)""")


def one_per_id(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) with one row per id: of an id's rows the smallest vector, so that repeats count once."""
    return rows.filter(F.col(vec_id).isNotNull()).groupBy(F.col(vec_id).cast("bigint").alias("vec_id")).agg(F.min(vector).alias("vector"))


def search(rows: DataFrame, queries: DataFrame, count: int, asked: int,
           find: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple], k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best rows, ties to the smaller vec_id.

    ``rows`` and ``queries`` (vec_id, vector, dim), ``count`` and ``asked`` of them, are dealt by hash
    into blocks, and a task gets one block of each. ``find(ids, vectors, query_ids, queries)`` returns
    arrays (query_id, vec_id, score) of the best rows of the block, at most k a query, so what is
    ranked at the end is k rows for each query and block. Only vectors of one dimension meet.
    """
    row_blocks, query_blocks = count // ROWS + 1, asked // QUERIES + 1

    def dealt(df, own, n, other, m):
        return (df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.int64() if score == "long" else pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        (ids, vectors), (query_ids, asked_) = _arrays(left), _arrays(right)
        found = find(ids, vectors, query_ids, asked_)
        return pa.table(dict(zip(empty.column_names, found))).cast(empty.schema)

    keys = ["dim", "row_block", "query_block"]
    left = dealt(rows, "row_block", row_blocks, "query_block", query_blocks).groupBy(*keys)
    right = dealt(queries, "query_block", query_blocks, "row_block", row_blocks).groupBy(*keys)
    best = left.cogroup(right).applyInArrow(meet, f"query_id long, vec_id long, score {score}")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and the vectors as a matrix."""
    ids = table.column("vec_id").to_numpy()
    values = table.column("vector").combine_chunks()
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in (values.chunks if isinstance(values, pa.ChunkedArray) else [values])])
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def stacked(parts: Iterator[tuple]) -> tuple:
    """The arrays (query_id, vec_id, score) of several queries in one."""
    parts = [p for p in parts if len(p[1])]
    if not parts:
        return np.array([], np.int64), np.array([], np.int64), np.array([])
    return (np.concatenate([np.full(len(p[1]), p[0], np.int64) for p in parts]),
            np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
