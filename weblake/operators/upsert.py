"""Keyed upserts with first-write and last-write columns, and insert-ignore."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Merge:
    """How rows of one key become one row.

    ``keep_first`` columns stay as first written, ``keep_last`` columns follow the last update.
    ``inserted`` / ``refreshed`` name the time columns of the table (None: the table has none).
    """

    key: str
    keep_first: tuple[str, ...]
    keep_last: tuple[str, ...]
    at: str = "ts"
    order_by: tuple[str, ...] = ("ts", "event_id")
    inserted: str | None = "dateinsert"
    refreshed: str | None = "daterefresh"

    def _rows(self, df, existing, first_at, last_at, order):
        ordering = F.struct(F.lit(0 if existing else 1).alias("pass"),
                            *(c.alias(f"o{i}") for i, c in enumerate(order)))
        return df.select(
            self.key, ordering.alias("first_order"),
            F.struct(*self.keep_first, first_at.alias("_at")).alias("first"),
            ordering.alias("last_order"),
            F.struct(*self.keep_last, last_at.alias("_at")).alias("last"),
            F.lit(1).cast("bigint").alias("writes"))

    def from_updates(self, updates: DataFrame) -> DataFrame:
        at = F.col(self.at)
        return self._rows(updates, False, at, at, [F.col(c) for c in self.order_by])

    def from_table(self, table: DataFrame, updates: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in updates.schema.fields}
        none = F.lit(None).cast(types[self.at])
        return self._rows(table, True,
                          F.col(self.inserted) if self.inserted else none,
                          F.col(self.refreshed) if self.refreshed else none,
                          [F.lit(None).cast(types[c]) for c in self.order_by])

    def combine(self, rows: DataFrame) -> DataFrame:
        """Merge rows per key. Associative, and combined map-side before the shuffle."""
        return rows.groupBy(self.key).agg(
            F.min("first_order").alias("first_order_"), F.min_by("first", "first_order").alias("first_"),
            F.max("last_order").alias("last_order_"), F.max_by("last", "last_order").alias("last_"),
            F.sum("writes").alias("writes"),
        ).select(self.key, F.col("first_order_").alias("first_order"), F.col("first_").alias("first"),
                 F.col("last_order_").alias("last_order"), F.col("last_").alias("last"), "writes")

    def table(self, combined: DataFrame) -> DataFrame:
        """Combined rows as table rows."""
        columns = [self.key, *(f"first.{c}" for c in self.keep_first), *(f"last.{c}" for c in self.keep_last)]
        if self.inserted:
            columns.append(F.col("first._at").alias(self.inserted))
        if self.refreshed:
            again = (F.col("writes") > 1) | (F.col("first_order.pass") == 0)
            columns.append(F.when(again, F.col("last._at")).alias(self.refreshed))
        return combined.select(*columns)


BLOG_PAGE = Merge("pageurlhash", ("pageurl", "detailed"), ("title", "pagetext"))
PRODUCT_PAGE = Merge("pageurlhash", ("pageurl", "brand", "description", "price", "color", "size",
                                     "productid", "imageamount"), ("title", "pagetext"))
BLOG_PHOTO = Merge("photourlhash", ("photourl", "datepost", "photosourcetype_id"), ("title",),
                   inserted=None, refreshed=None)
PRODUCT_PHOTO = Merge("photourlhash", ("photourl", "pageurl", "photosourcetype_id"), ("datepost",),
                      inserted=None, refreshed=None)


def upsert(target: DataFrame | None, updates: DataFrame, merge: Merge) -> DataFrame:
    """The target after all updates, in one shuffle."""
    rows = merge.from_updates(updates)
    if target is not None:
        rows = merge.from_table(target, updates).unionByName(rows)
    return merge.table(merge.combine(rows))


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that an insert-ignore adds: distinct, complete keys that are not there yet."""
    complete = new.select(*keys).dropna()
    for name, kind in complete.dtypes:
        if kind in ("int", "bigint"):
            complete = complete.filter(F.col(name) != 0)
    return complete.dropDuplicates().join(existing.select(*keys), list(keys), "left_anti")
