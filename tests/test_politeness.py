"""The politeness stream against the plain rule: item k of a host starts at max(start of k - 1 plus the delay, its own time)."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weblake.session import work_dir
from weblake.streaming import politeness, streams as ST
from weblake.streaming.politeness import polite

ITEMS = "url string, ord bigint, attempt int, ms bigint"


def put(spark, folder, rows):
    spark.createDataFrame(rows, ITEMS).withColumn("at", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(f"{folder}/queue")


def go(spark, folder, **how):
    queue = ST.read_folder(spark, f"{folder}/queue", "url string, ord bigint, attempt int, at timestamp")
    out = ST.run_polite(spark, queue, f"{folder}/out", f"{folder}/checkpoint", **how)
    return [(r.host, r.url, r.ord, r.attempt, r.ms) for r in out.select("*", F.unix_millis("start_at").alias("ms")).collect()]


def plain(rows, delay):
    free, out = {}, []
    for url, ord_, attempt, ms in sorted((r for r in rows if r[0]), key=lambda r: (r[3], r[1])):
        host = url.split("/")[2]
        start = max(free.get(host, 0), ms)
        out.append((host, url, ord_, attempt, start))
        free[host] = start + delay
    return sorted(out)


def test_a_recorded_queue_over_several_runs(spark, monkeypatch):
    """One host has most items; repeats, hosts of one item, queues longer than a page; a run goes on with what the last one left."""
    monkeypatch.setattr(politeness, "PAGE", 16)
    draw, folder = random.Random(3), work_dir(spark, "t")
    hosts, rows = ["a.com"] * 6 + ["b.com", "c.com"], []
    for lot in range(2):
        now = 10_000 * (lot + 1)
        new = [(f"http://{draw.choice(hosts)}/{draw.randrange(80)}", 100 * lot + i, 1, now + draw.randrange(5000)) for i in range(70)]
        new.append((f"http://d{lot}.com/", 0, 1, now + 5000))
        put(spark, folder, new)
        rows += new
        got = sorted(go(spark, folder, delay=0.25))
        assert set(got) <= set(plain(rows, 250)) and len(got) < len(rows)
    put(spark, folder, [(None, 0, 1, 10_000_000)])  # the clock moves on, and all is let go
    assert sorted(go(spark, folder, delay=0.25)) == plain(rows, 250)


def test_failed_items_are_held_back(spark):
    """Back-off doubles with each attempt, items behind a failed one do not wait, and the delay holds for all."""
    folder = work_dir(spark, "t")
    rows = [("http://a.com/f", 1, 2, 1000), ("http://a.com/g", 2, 4, 1000), ("http://a.com/f", 3, 2, 1000)]
    rows += [(f"http://a.com/{i}", 10 + i, 1, 1000) for i in range(6)] + [(None, 0, 1, 1000)]
    put(spark, folder, rows)
    put(spark, folder, [(None, 0, 1, 1_000_000)])
    got = sorted(go(spark, folder, delay=1, back_off=10), key=lambda r: r[4])
    assert sorted((r[1], r[2]) for r in got) == sorted((r[0], r[1]) for r in rows if r[0])
    starts = {(r[1], r[2]): r[4] for r in got}
    assert [starts[f"http://a.com/{i}", 10 + i] for i in range(6)] == [1000 + 1000 * i for i in range(6)]
    assert min(starts["http://a.com/f", 1], starts["http://a.com/f", 3]) == 11_000 and starts["http://a.com/g", 2] == 41_000
    assert all(b[4] - a[4] >= 1000 for a, b in zip(got, got[1:]))


def test_a_live_queue(spark):
    """By the clock on the wall, what is due is let go, and the rest waits."""
    folder, soon = work_dir(spark, "t"), 4_000_000_000_000  # in the year 2096
    # Items without a time are the earliest, so their turns are long past.
    put(spark, folder, [("http://a.com/1", None, None, None), ("http://a.com/2", 1, 1, 0), ("http://b.com/1", 2, 1, 0), (None, 1, 1, 0),
                        ("http://a.com/3", 3, 1, soon), ("http://b.com/2", 3, 2, soon)])
    queue = ST.read_folder(spark, f"{folder}/queue", "url string, ord bigint, attempt int, at timestamp")
    job, got = ST.start_polite(spark, queue, f"{folder}/out", f"{folder}/checkpoint", delay=3600, back_off=60), []
    try:
        for _ in range(60):
            time.sleep(0.5)
            got = [r for r in job.recentProgress if r["numInputRows"]]
            if got or job.exception():
                break
        else:
            pytest.fail("nothing was read")
        rows = spark.read.parquet(f"{folder}/out").collect()
    finally:
        job.stop()
    assert sorted((r.url, r.attempt) for r in rows) == [("http://a.com/1", 1), ("http://a.com/2", 1), ("http://b.com/1", 1)]


def test_unknown_clock(spark):
    with pytest.raises(ValueError):
        polite(spark.createDataFrame([], ITEMS), clock="sun")
