"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word is a run of bytes that are not ASCII white space; so are the words of ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_length(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, if there is such a column, as the texts now have it."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to clash with no name in ``taken``."""
    used = {name.lower() for name in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a struct ``row`` of all columns but the text, so that no column clashes with an operator's own."""
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def unboxed(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The ``columns`` of what :func:`boxed` gave, with the text as it is now."""
    return rows.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns))
