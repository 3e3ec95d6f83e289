"""Politeness as a running job: each host's requests are let go one per delay, failed ones after a back-off."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from weblake.functions.urls import domain

# Workers get the processor with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ITEM = "url string, ord bigint, attempt int, ready bigint"
_PAGE = "urls array<string>, ords array<bigint>, attempts array<int>, ready array<bigint>"
RELEASED = "host string, url string, ord bigint, attempt int, start bigint"
PAGE = 256


class Releases(StatefulProcessor):
    """The queue of one host. All times are milliseconds.

    ``queue`` numbers pages of at most :data:`PAGE` waiting items, from ``head`` to ``tail``; ``gone`` of the first
    page were let go. So a turn reads one page however long the queue is. ``held`` has failed items by the
    time at which they may be tried again; a timer wakes each.
    """

    def __init__(self, delay: int, event_time: bool):
        self.delay, self.event_time = delay, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "number bigint", _PAGE)
        self.held = handle.getMapState("held", "due bigint", _ITEM)
        self.ends = handle.getValueState("ends", "head bigint, gone int, tail bigint, free bigint")

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _ends(self) -> tuple[int, int, int, int]:
        return tuple(self.ends.get()) if self.ends.exists() else (0, 0, 0, 0)

    def _hold(self, item) -> None:
        due = item[3]
        while self.held.containsKey((due,)):  # a host fails once per delay at most, so this is short
            due += 1
        self.held.updateValue((due,), item)
        self.handle.registerTimer(due)

    def _append(self, tail: int, items) -> int:
        """Number behind the last page once ``items`` are queued."""
        for first in range(0, len(items), PAGE):
            self.queue.updateValue((tail,), tuple(list(column) for column in zip(*items[first:first + PAGE])))
            tail += 1
        return tail

    def handleInputRows(self, key, rows, timerValues):
        now = self._now(timerValues)
        arrived = pd.concat(list(rows), ignore_index=True)
        arrived = arrived[arrived["url"].notna()].sort_values(["ready", "ord"], kind="stable")
        items = list(zip(arrived["url"], arrived["ord"].tolist(), arrived["attempt"].tolist(), arrived["ready"].tolist()))
        later = [item for item in items if item[2] > 1 and item[3] > now]
        for item in later:
            self._hold(item)
        if later:
            items = [item for item in items if item[2] == 1 or item[3] <= now]
        head, gone, tail, free = self._ends()
        yield from self._release(key, now, head, gone, self._append(tail, items), free)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        head, gone, tail, free = self._ends()
        due = (expiredTimerInfo.getExpiryTimeInMs(),)
        if self.held.containsKey(due):
            tail = self._append(tail, [tuple(self.held.getValue(due))])
            self.held.removeKey(due)
        yield from self._release(key, self._now(timerValues), head, gone, tail, free)

    def _release(self, key, now, head, gone, tail, free):
        while head < tail:
            page, lot = list(zip(*self.queue.getValue((head,)))), []
            for url, number, attempt, ready in page[gone:]:
                start = max(free, ready)
                if start > now:
                    self.handle.registerTimer(start)
                    break
                lot.append((key[0], url, number, attempt, start))
                free = start + self.delay
            gone += len(lot)
            yield self._frame(lot)
            if gone < len(page):
                break
            self.queue.removeKey((head,))
            head, gone = head + 1, 0
        self.ends.update((head, gone, tail, free))

    @staticmethod
    def _frame(lot) -> pd.DataFrame:
        names = [part.split()[0] for part in RELEASED.split(", ")]
        return pd.DataFrame(lot, columns=names).astype({"ord": "int64", "attempt": "int32", "start": "int64"})

    def close(self) -> None:
        pass


def polite(items: DataFrame, delay: float = 0.25, back_off: float = 60.0, clock: str = "processing",
           at: str = "at") -> DataFrame:
    """A stream of items(url, ord, attempt, ``at``) → (host, url, ord, attempt, start_at), each let go at its turn.

    A host's items go in the order in which they came, within a batch by (``at``, ord), one per ``delay``
    seconds and none before ``at``: item k starts at max(start of k - 1, plus the delay; its own time).
    An item of attempt n > 1 failed at ``at`` and is held back for back_off * 2 ** (n - 2) seconds; those
    behind it need not wait. A null attempt counts as the first, a null ord as 0, a null ``at`` as the earliest.
    Repeated items are let go as often as they come. Rows without a URL let nothing go.

    ``clock="processing"`` is the running job: timers fire at batches, so give it a trigger not much longer than
    the delay. ``clock="event"`` replays a recorded queue: the watermark of ``at`` is the time, rows without a URL
    only move it on, and rows older than it are dropped by Spark, so they must come in order. State is
    what waits, in RocksDB; a batch's items of one host are sorted in memory, so bound a
    batch by the reader (``read_folder(files_per_batch)``).
    """
    if clock not in ("processing", "event"):
        raise ValueError(f"clock must be 'processing' or 'event', not {clock!r}")
    event = clock == "event"
    attempt = F.coalesce(F.col("attempt"), F.lit(1)).cast("int")
    held = F.when(attempt > 1, F.lit(back_off) * F.pow(F.lit(2.0), attempt - 2)).otherwise(0.0)
    ready = F.coalesce(F.unix_millis(at), F.lit(0)) + F.round(held * 1000).cast("bigint")
    if event:
        items = items.withWatermark(at, "0 seconds")
    kept = [F.col(at)] if event else []
    hosted = items.select(F.coalesce(domain(F.col("url")), F.lit("")).alias("host"), "url", F.coalesce("ord", F.lit(0)).cast("bigint").alias("ord"),
                          attempt.alias("attempt"), ready.alias("ready"), *kept)
    released = hosted.groupBy("host").transformWithStateInPandas(
        Releases(round(delay * 1000), event), RELEASED, "append", "eventTime" if event else "processingTime")
    return released.select("host", "url", "ord", "attempt", F.timestamp_millis("start").alias("start_at"))
