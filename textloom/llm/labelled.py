"""Bounded, repeatable samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_of

#: At most so many labelled rows are learned from; scoring covers all rows.
MOST_ROWS = 8000


def remainder(by: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


def held_out(by: int, rest: int):
    """Rows whose labels are never seen; a null doc_id has no label and is not held out."""
    return F.coalesce(remainder(by) == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, by: int, rest: int, most: int = MOST_ROWS) -> DataFrame:
    """(text, y) of at most ``most`` labelled rows outside the held-out fold, by hash of doc_id.

    Contradicting labels of one doc_id are dropped. The chosen ids are broadcast: ``most`` bounds them."""
    ids = labels.where(~held_out(by, rest)).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2"))
    ids = ids.where("y = y2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("l_id"), F.col("y").cast("int").alias("y"))
    chosen = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"))
    return settle(chosen.select("doc_id", "text", "y"))
