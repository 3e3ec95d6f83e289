"""Images and the dates near them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weblake.functions import html as H, urls as U
from weblake.functions.dates import first_date
from weblake.functions.text import decode_all, each, let
from weblake.operators.frontier import first_seen
from weblake.operators.nodes import NO_DATE

def dates_of(nodes: Column) -> Column:
    """Array of (node_no, date) of the elements whose own text holds a date, outside comment blocks."""
    excluded = ", ".join(f"'{tag}'" for tag in NO_DATE)
    candidates = F.call_function("filter", nodes, F.expr(
        f"n -> n.kind = 'elem' and not n.in_comment and n.tag not in ({excluded}) and n.text rlike '[0-9]{{4}}'"))
    dated = F.transform(candidates, lambda n: F.struct(
        n["node_no"].alias("node_no"), first_date(n["text"]).alias("date")))
    return F.filter(dated, lambda m: m["date"].isNotNull())


def images_of(nodes: Column) -> Column:
    """Array of (node_no, raw_src, alt) of each img with a source."""
    found = F.call_function("filter", nodes, F.expr(
        "n -> n.kind = 'elem' and n.tag = 'img' and try_element_at(n.attrs, 'src') <> ''"))
    return F.arrays_zip(
        each(found, "n -> n.node_no").alias("node_no"),
        decode_all(each(found, "n -> try_element_at(n.attrs, 'src')")).alias("raw_src"),
        decode_all(each(found, "n -> coalesce(try_element_at(n.attrs, 'alt'), '')")).alias("alt"))


def date_mentions(parsed: DataFrame, keep=("page_id",)) -> DataFrame:
    """:func:`dates_of` as rows."""
    return parsed.select(*keep, F.inline(dates_of(F.col("nodes"))))


def image_rows(df: DataFrame, shown: Column, keep=("page_id", "url")) -> DataFrame:
    rows = df.select(*keep, F.inline(shown))
    return rows.withColumn("src", U.image_url(F.col("url"), F.col("raw_src"))).drop("raw_src")


def images(parsed: DataFrame, keep=("page_id", "url")) -> DataFrame:
    """Each img with a source: absolute src, alt or "", and its node_no."""
    return image_rows(parsed, images_of(F.col("nodes")), keep)


def images_as_of(pages: DataFrame, today: Column, keep=("page_id", "url")) -> DataFrame:
    """As :func:`images`, with one given post date for all. Needs no element tree."""
    tags = H.start_tags(F.col("html"), "img")
    pairs = pages.select(*keep, F.posexplode(F.arrays_zip(
        H.attributes(tags, "src").alias("_src"), H.attributes(tags, "alt").alias("alt"))).alias("pos", "i"))
    return (pairs.filter(F.col("i._src") != "")
            .select(*keep, "pos", U.image_url(F.col("url"), F.col("i._src")).alias("src"),
                    F.coalesce("i.alt", F.lit("")).alias("alt"), today.alias("postdate")))


def nearest_date(images: DataFrame, dates: DataFrame, page: str = "page_id") -> DataFrame:
    """postdate of each image: the date whose element is nearest; on a tie the earlier one; "" if none.

    For images and dates in tables of their own: two sorts per page over both together, instead of
    pairing each image with each date. :func:`dated_images` serves pages that hold both.
    """
    mark = F.struct("node_no", "date").alias("mark")
    plain = images.withColumn("mark", F.lit(None).cast("struct<node_no:int,date:string>"))
    marks = plain.unionByName(dates.select(page, "node_no", mark), allowMissingColumns=True)
    is_image = F.col("mark").isNull()
    rows = (W.unboundedPreceding, W.currentRow)
    forward = W.partitionBy(page).orderBy("node_no", is_image).rowsBetween(*rows)
    backward = W.partitionBy(page).orderBy(F.col("node_no").desc(), is_image).rowsBetween(*rows)
    marked = (marks.withColumn("_before", F.last("mark", ignorenulls=True).over(forward))
              .withColumn("_after", F.last("mark", ignorenulls=True).over(backward)).filter(is_image))
    closer = (F.col("_before.node_no").isNull()
              | (F.col("_after.node_no") - F.col("node_no") < F.col("node_no") - F.col("_before.node_no")))
    return (marked.withColumn("postdate", F.coalesce(
        F.when(closer, F.col("_after.date")), F.col("_before.date"), F.lit("")))
        .drop("mark", "_before", "_after"))


# x.i: images, x.d: dates, both (node_no, ...) in document order. A date takes over from the one before
# at the middle of the two: past it for twice the node_no, so that a tie stays with the earlier date. One
# sort of both by that place, then one walk that keeps the date in force.
_DATED = """x -> aggregate(
  array_sort(concat(
    transform(x.i, i -> named_struct('place', 2 * i.node_no, 'takes', 0, 'node_no', i.node_no, 'raw_src', i.raw_src,
      'alt', i.alt, 'date', '')),
    transform(x.d, (d, n) -> named_struct('place', case when n = 0 then -1 else d.node_no + element_at(x.d, n).node_no end,
      'takes', 1, 'node_no', d.node_no, 'raw_src', '', 'alt', '', 'date', d.date)))),
  named_struct('date', '', 'out', cast(array() as array<struct<node_no: int, raw_src: string, alt: string, postdate: string>>)),
  (acc, m) -> named_struct('date', case when m.takes = 1 then m.date else acc.date end,
    'out', case when m.takes = 1 then acc.out else concat(acc.out, array(named_struct('node_no', m.node_no,
      'raw_src', m.raw_src, 'alt', m.alt, 'postdate', acc.date))) end),
  acc -> acc.out)"""


def dated_images(df: DataFrame, shown: Column, dates: Column, keep=("page_id", "url")) -> DataFrame:
    """As :func:`nearest_date` from the image and date arrays of each page: a projection, no shuffle."""
    arrays = F.struct(shown.alias("i"), dates.alias("d"))
    return image_rows(df, let(arrays, _DATED), keep)


def image_gate(df: DataFrame, quality: int = 1) -> DataFrame:
    """Keep images of sufficient size; quality 1 also drops long, thin ones."""
    least = 200 if quality == 1 else 80
    width, height = F.col("width"), F.col("height")
    kept = df.filter((width >= least) & (height >= least))
    if quality != 1:
        return kept
    return kept.filter((width <= height * 3.5) & (height <= width * 3.5))


def first_page_of_image(df: DataFrame, order, mode: str = "first") -> DataFrame:
    """mode "first": an image belongs to the first page that shows it; "all": to each page once."""
    keyed = df.withColumn("photo_sha1", U.url_sha1(F.col("src")))
    if mode == "first":
        return first_seen(keyed, ["photo_sha1"], order)
    return first_seen(keyed, ["photo_sha1", "url"], order)


def retry_budget(attempts: DataFrame, max_attempts: int = 4, key: str = "photo_sha1",
                 order=("ts", "event_id")) -> DataFrame:
    """Outcome per image from a log with ``ok``: stored, dead (budget used up) or pending.

    The limit on the attempt number is applied on both sides of the shuffle, so an image with very
    many attempts brings at most ``max_attempts`` rows per map task.
    """
    numbered = (attempts.withColumn("attempt", F.row_number().over(W.partitionBy(key).orderBy(*order)))
                .filter(F.col("attempt") <= max_attempts))
    tries = numbered.groupBy(key).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("_won"),
                                      F.max("attempt").alias("_tries"))
    return tries.select(
        key, F.coalesce("_won", "_tries").alias("attempts"),
        F.when(F.col("_won").isNotNull(), "stored")
        .when(F.col("_tries") >= max_attempts, "dead").otherwise("pending").alias("status"))


def dead_letter(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("status") == "dead").drop("status")


def store_layout(df: DataFrame, key: str = "photo_sha1") -> DataFrame:
    """shard = first three hex characters of the key, path = shard/key.jpg."""
    shard = F.substring(key, 1, 3)
    return df.withColumn("shard", shard).withColumn("path", F.concat(shard, F.lit("/"), F.col(key), F.lit(".jpg")))


def write_images(df: DataFrame, path: str) -> None:
    """Write a sharded image table. AQE gathers small shards and cuts large ones into files of its target size."""
    store_layout(df).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
