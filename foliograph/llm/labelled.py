"""A bounded sample of labelled training documents; documents held out are never in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in five, by the checksum of its id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """rows (text, y) of at most ``most`` labelled documents that are not held out, spread by a hash of the id.

    A doc_id with several labels has the least; null labels and ids are no labels.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a documented bound, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y")
