"""Labelled rows for the classifiers: a bounded, repeatable sample, and rows that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold() -> Column:
    """crc32 of doc_id as text, modulo 3; rows of fold 1 are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def held_out() -> Column:
    return F.coalesce(fold() == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled rows that aren't held out.

    The bound is on rows, chosen in the order of a hash of doc_id whatever their label: the sample
    doesn't change between runs, its size doesn't follow the table, and its labels have the table's
    shares at every size. Rows without id or label are left out; an id
    labelled twice takes its larger label.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    # bounded by `most` rows of two numbers, so it is sent to every task
    chosen = F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
