"""Near-duplicates by 64-bit SimHash, found through the bit counts of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblake.llm.common import free_names
from weblake.llm.components import components
from weblake.session import Work

SEED = 42
BLOCK = 1 << 16
#: One in each two-bit segment of a fingerprint.
ONES = 0x5555555555555555
#: Segments 0-11, 12-23 and 24-31 with the Manhattan distance allowed in each. Where all three were
#: exceeded, at least 2 + 2 + 1 = 5 bits would differ, so 4 or fewer bits always meet in one of them.
GRIDS = ((0, 12, 1), (12, 24, 1), (24, 32, 0))


def fingerprint(text: str | None, words: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; 0 without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        part = found[start:min(start + BLOCK, n) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(part) >= words else [b" ".join(part)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(text: str | Column = "text", words: int = 4) -> Column:
    """The fingerprint of each text as a bigint; null and empty texts have 0."""
    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")
    return run(text)


def _cells(fp: str, steps: bool) -> Column:
    """Cells (grid, key, step) of a fingerprint: its own in each grid, with ``steps`` also those one up.

    The key holds the popcounts of the grid's segments, two bits each. Two neighbours at Manhattan
    distance 1 differ by one in the sum, so the lower one alone steps up, by 1 in each segment.
    """
    cells = []
    for grid, (low, high, reach) in enumerate(GRIDS):
        width = 2 * (high - low)
        part = f"(shiftrightunsigned({fp}, {2 * low}) & {(1 << width) - 1}L)"
        ones = ONES & ((1 << width) - 1)
        key = f"(({part} & {ones}L) + (shiftrightunsigned({part}, 1) & {ones}L))"
        cells.append(f"array(named_struct('grid', {grid}, 'key', {key}, 'step', 0))")
        if steps and reach:
            cells.append(f"""transform(filter(sequence(0, {width - 2}, 2),
                i -> (shiftrightunsigned({key}, i) & 3L) < 2L),
              i -> named_struct('grid', {grid}, 'key', {key} + shiftleft(1L, i), 'step', 1))""")
    return F.expr(f"inline(concat({', '.join(cells)}))")


def links(work: Work, fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fps`` (fp, n) as all close pairs would.

    Every link is a pair at ``max_bits`` or fewer differing bits. First each fingerprint is linked
    with the most frequent one of its cells where it is that close, which joins most of a dense group
    by one link a member. Then the grid join compares all fingerprints that share a cell and emits
    those close pairs whose groups still differ, so no group is written out as all its pairs. A pair
    is tested in the cells that it shares; cells with very many fingerprints are split by AQE.
    """
    if max_bits > 4:
        raise ValueError("the grids cover up to 4 differing bits")
    homes = fps.select("fp", "n", _cells("fp", False))
    heads = homes.groupBy("grid", "key").agg(F.max(F.struct("n", "fp")).alias("head"), F.count("*").alias("size"))
    heads = heads.filter("size > 1").select("grid", "key", F.col("head.fp").alias("b"))
    stars = work.table("stars", homes.join(heads, ["grid", "key"])
                       .filter(f"fp <> b and bit_count(fp ^ b) <= {max_bits}").select(F.col("fp").alias("a"), "b").distinct())
    groups = components(work, stars, "star_groups")
    grouped = fps.join(groups, fps["fp"] == groups["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))
    grouped = work.table("grouped", grouped)
    left = grouped.select("fp", "root", _cells("fp", True)).alias("l")
    right = grouped.select("fp", "root", _cells("fp", False)).alias("r")
    close = left.join(right, F.expr(f"""l.grid = r.grid and l.key = r.key and l.root <> r.root
        and (l.step = 1 or l.fp < r.fp) and bit_count(l.fp ^ r.fp) <= {max_bits}"""))
    rest = close.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()
    return stars.unionByName(work.table("close", rest))


def _grouped(docs: DataFrame, doc_id: str, text: str, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, place, fp) of ``docs`` and members (fp, component_id) of their distinct fingerprints."""
    work = Work(docs.sparkSession, "simhash")
    rows = work.table("rows", docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("place"),
                                          fingerprints(F.col(text), words).alias("fp")))
    fps = work.table("fps", rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct(
        F.col("doc_id").isNull().alias("nameless"), "doc_id", "place")).alias("least")))
    roots = components(work, links(work, fps.select("fp", "n"), max_bits), "groups")
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = work.table("named", named)
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    return rows, named.select("fp", "root").join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"),
                                                                       F.col("least.place").alias("least_place"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp (bigint) and component_id, the smallest doc_id reachable over links, of every row of ``docs``.

    Fingerprints are compared once however many documents share them. Null texts count as empty;
    texts without words share fingerprint 0, which is linked like any other. Repeated rows come
    back as often as they are given. A null doc_id is the smallest of nothing: it names a component
    only where no other id is there. Other columns of ``docs`` are not touched. An empty table gives no rows.
    """
    rows, members = _grouped(docs, doc_id, text, words, max_bits)
    return rows.join(members, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """The row smallest by (doc_id, text hash) of each near-duplicate group of ``docs`` (doc_id, text, any others).

    Groups are those of :func:`near_duplicates`. A doc_id that is repeated with unlike texts stays
    once in each of their groups where it is the smallest; of rows that repeat both doc_id and text one
    stays. Null and empty texts are a group. Rows with a null doc_id all stay, as no group can name them.
    Other columns come through whatever their names; an empty table gives no rows.
    """
    _, members = _grouped(docs, "doc_id", "text", words, max_bits)
    keep, place, rank = free_names(docs.columns, "keep", "place", "rank")
    found = members.filter("component_id is not null").select(
        F.col("component_id").alias(keep), F.col("least_place").alias(place)).distinct()
    kept = docs.join(found, (F.col("doc_id") == F.col(keep)) & (F.xxhash64("text") == F.col(place)))
    order = Window.partitionBy(keep, place).orderBy(place)
    one = kept.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*docs.columns)
    return one.unionByName(docs.filter("doc_id is null"))
