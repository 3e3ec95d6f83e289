"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from weblake.llm import vectors as V
from weblake.session import Work

#: Entries that a query reads of each list in its first round; later rounds read twice as many.
FIRST = 16
#: Products are summed in doubles while they are exact there.
EXACT = 1 << 53


class SortedLists:
    """A block of vectors with one list of places per dimension, by ascending component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)
        self.most = int(np.abs(vectors).max(initial=0))
        self.doubles = vectors.astype(np.float64)

    def scores(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Integer inner products, exact for values of any size that fit 64 bits."""
        if self.most * int(np.abs(query).max(initial=0)) * len(query) < EXACT:
            return (self.doubles[places] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[places] @ query

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors but ``query_id``, best first.

        Each list is read from the end where its products are largest. After a round no unread vector
        can score more than the sum of the products where the lists stand; once the kth score is over
        that, it is not reached by any of them, ties included.
        """
        size = len(self.ids)
        seen = self.ids == query_id
        places, scores = np.array([], np.int64), np.array([], np.int64)
        used = np.flatnonzero(query)
        up = query[used] < 0
        low, high = 0, min(FIRST, size)
        while True:
            front = np.where(up[:, None], self.order[used, low:high], self.order[used, size - high:size - low])
            new = np.zeros(size, bool)
            new[front.ravel()] = True
            if not len(used):
                new[:] = True
            new &= ~seen
            seen |= new
            fresh = np.flatnonzero(new)
            places, scores = np.concatenate([places, fresh]), np.concatenate([scores, self.scores(fresh, query)])
            best = V.top(scores, self.ids[places], k)
            places, scores = places[best], scores[best]
            if high == size or not len(used):
                break
            edge = np.where(up, self.values[used, high - 1], self.values[used, size - high])
            bound = sum(int(a) * int(b) for a, b in zip(edge, query[used]))
            if len(scores) == k and scores[-1] > bound:
                break
            low, high = high, min(size, 3 * high)
        return self.ids[places], scores


def quantized(vector: str, factor: int = 256) -> str:
    return f"transform({vector}, x -> cast(floor({factor} * cast(x as double)) as bigint))"


def exact_top_k(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the largest integer inner product for each query.

    Queries are the ids divisible by ``every``; every id but the query's own is a candidate. Vectors
    that are null or hold null or non-finite components take no part; an id's repeated rows count
    once (the smallest vector); vectors of another dimension than the query's are no candidates.
    Ties go to the smaller id. Fewer candidates than ``k`` are all returned; no rows give no rows.
    """
    work = Work(rows.sparkSession, "topk")
    usable = rows.filter(V.valid(vector)).select(F.col(vec_id).alias("vec_id"), F.expr(quantized(vector)).alias("vector"))
    table = work.table("vectors", V.one_per_id(usable, "vec_id", "vector").withColumn("dim", F.size("vector")))
    queries = table.filter(F.col("vec_id") % every == 0)

    def find(ids, vectors, query_ids, queries):
        lists = SortedLists(ids, vectors)
        return V.stacked((q, *lists.top(q, v, k)) for q, v in zip(query_ids, queries))

    return V.search(table, queries, table.count(), queries.count(), find, k, "long")
