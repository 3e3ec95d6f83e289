"""Pages as tokens and as element/text nodes."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from weblake.functions import html as H
from weblake.functions.text import decode_entities, remove_space
from weblake.operators import treepass

# Workers get the pass with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(treepass)

# Text directly below one of these is not page text.
NO_PAGE_TEXT = ("a", "style", "script", "head", "img", "noscript", "form", "option")
# Text directly below one of these holds no date of the page.
NO_DATE = ("script", "head", "noscript", "option")


def tokens(pages: DataFrame) -> DataFrame:
    """One row per token of each page: token_no, kind, tag, token."""
    return (pages.select("page_id", F.posexplode(H.tokens(F.col("html"))).alias("token_no", "token"))
            .select("page_id", "token_no", H.token_kind(F.col("token")).alias("kind"),
                    H.token_tag(F.col("token")).alias("tag"), "token"))


def parse(pages: DataFrame, keep=("page_id", "url"), path_attrs=None) -> DataFrame:
    """One row per page with its ``nodes`` array in document order.

    The array stays with its page, so what follows (text, dates, images, rule fields) is a
    projection: no shuffle and no re-grouping by page. ``path_attrs`` name the attributes that the
    node paths carry; without them there are no paths.
    """
    shredded = pages.select(*keep, H.tokens(F.col("html")).alias("tokens"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shredded.schema.fields[:-1])

    def run(batches):
        return treepass.node_arrays(batches, path_attrs)

    return shredded.mapInArrow(run, f"{schema}, nodes {treepass.NODE_DDL}")


def nodes(pages: DataFrame, path_attrs=("class", "id")) -> DataFrame:
    """The node table: one row per element or text node."""
    return (parse(pages, ("page_id",), path_attrs)
            .select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.*"))


def texts_of(nodes: Column, excluded=()) -> Column:
    """Raw texts whose direct parent is not excluded, in document order."""
    test = f" and n.tag not in ({', '.join(repr(tag) for tag in excluded)})" if excluded else ""
    kept = F.call_function("filter", nodes, F.expr(f"n -> n.kind = 'text'{test}"))
    return F.transform(kept, lambda n: n["text"])


def page_text(parsed: DataFrame, squeeze: bool = True, out: str = "pagetext") -> DataFrame:
    """Visible text. ``squeeze`` drops all white space (blog pages); product pages keep it."""
    text = decode_entities(F.array_join(texts_of(F.col("nodes"), NO_PAGE_TEXT), ""))
    text = remove_space(text) if squeeze else text
    missing = "no text" if squeeze else "no desc"
    return parsed.withColumn(out, F.coalesce(text, F.lit(missing)))
