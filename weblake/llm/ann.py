"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from weblake.llm import vectors as V
from weblake.session import Work

#: Bits in which a rotated query's components are held.
QUERY_BITS = 4
#: Rows compared with a query's codes at a time, which bounds the arrays.
STEP = 4096


@dataclass(frozen=True)
class Rotation:
    """A seeded orthonormal map from ``dim`` components to ``bits``, at least as many; more bits, smaller errors."""

    dim: int
    bits: int
    seed: int = 42

    def matrix(self) -> np.ndarray:
        wide = max(self.bits, self.dim)
        wide += -wide % 64
        gauss = np.random.default_rng(self.seed).standard_normal((wide, self.dim))
        return np.linalg.qr(gauss)[0]


@dataclass
class Codes:
    """One-bit codes of vectors: packed signs of the rotated vector, and the scalars that correct them.

    ``length`` is the vector's norm; ``along`` the inner product of the unit vector with its code, both
    as unit vectors. Divided by it, a query's product with the code estimates that with the vector
    without bias, with an error of about sqrt((1 - along²) / along² / (bits - 1)) times the norms.
    """

    signs: np.ndarray
    length: np.ndarray
    along: np.ndarray
    bits: int

    @classmethod
    def of(cls, vectors: np.ndarray, matrix: np.ndarray) -> Codes:
        length = np.linalg.norm(vectors, axis=1)
        turned = (vectors / length[:, None]) @ matrix.T
        packed = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
        return cls(packed, length, np.abs(turned).sum(axis=1) / np.sqrt(matrix.shape[0]), matrix.shape[0])

    def spread(self) -> np.ndarray:
        """Standard error of an estimate for a query of norm 1."""
        return self.length * np.sqrt(np.maximum(1 - self.along ** 2, 0) / self.along ** 2 / (self.bits - 1))

    def estimate(self, turned: np.ndarray) -> tuple[np.ndarray, float]:
        """Estimated inner products with a rotated query, and the error from holding it in few bits.

        The query's components become integers of :data:`QUERY_BITS` bits whose planes are compared with
        the codes by counting common bits.
        """
        low, high = turned.min(), turned.max()
        step = (high - low) / ((1 << QUERY_BITS) - 1) or 1.0
        levels = np.rint((turned - low) / step).astype(np.uint8)
        planes = np.stack([np.packbits(levels >> j & 1, bitorder="little").view(np.uint64) for j in range(QUERY_BITS)])
        common = np.zeros(len(self.signs), np.int64)
        for j, plane in enumerate(planes):
            common += np.bitwise_count(self.signs & plane).sum(axis=1, dtype=np.int64) << j
        ones = np.bitwise_count(self.signs).sum(axis=1, dtype=np.int64)
        product = 2 * (low * ones + step * common) - (low * self.bits + step * levels.sum(dtype=np.int64))
        rounding = np.linalg.norm(low + step * levels - turned)
        return self.length * product / np.sqrt(self.bits) / self.along, rounding


def nearest(codes: Codes, ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, turned: np.ndarray,
            k: int, errors: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products) of the best of a block, best first.

    The k best estimates are scored on the vectors. Only vectors whose estimate plus ``errors`` standard
    errors reaches the kth of these scores can be among the best, and those are scored as well.
    """
    estimate, rounding = codes.estimate(turned)
    estimate[ids == query_id] = -np.inf
    above = estimate + errors * codes.spread() * np.linalg.norm(query) + rounding * codes.length / codes.along / np.sqrt(codes.bits)
    first = V.top(estimate, ids, k)
    first = first[ids[first] != query_id]
    scores = (vectors[first] * query).sum(axis=1)
    if len(first) == k:
        rest = above >= scores.min()
        rest[first] = False
        rest = np.flatnonzero(rest & (ids != query_id))
        first = np.concatenate([first, rest])
        scores = np.concatenate([scores, (vectors[rest] * query).sum(axis=1)])
    best = V.top(scores, ids[first], k)
    return ids[first[best]], scores[best]


def approximate_top_k(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20,
                      bits: int = 256, errors: float = 2.5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found with the largest inner product for each query.

    Queries are the ids divisible by ``every``; every id but the query's own is a candidate and has a
    code of ``bits`` bits. A true neighbour is missed only where its estimate is more than ``errors``
    standard errors low. Scores are inner products of the original vectors in doubles. Vectors that
    are null, zero or hold null or non-finite components take no part; an id's repeated rows count
    once (the smallest vector); vectors of another dimension than the query's are no candidates. Ties
    go to the smaller id. Fewer candidates than ``k`` are all returned; no rows give no rows.
    """
    work = Work(rows.sparkSession, "ann")
    usable = rows.filter(V.valid(vector) & F.exists(vector, lambda x: x != 0)).select(
        F.col(vec_id).alias("vec_id"), F.expr(f"transform({vector}, x -> cast(x as double))").alias("vector"))
    table = work.table("vectors", V.one_per_id(usable, "vec_id", "vector").withColumn("dim", F.size("vector")))
    queries = table.filter(F.col("vec_id") % every == 0)

    def find(ids, vectors, query_ids, queries):
        matrix = Rotation(vectors.shape[1], bits).matrix()
        codes, turned = Codes.of(vectors, matrix), queries @ matrix.T
        return V.stacked((q, *nearest(codes, ids, vectors, q, v, t, k, errors)) for q, v, t in zip(query_ids, queries, turned))

    return V.search(table, queries, table.count(), queries.count(), find, k, "double")
