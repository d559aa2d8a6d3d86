"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows train a model; rows are chosen by a hash of the id.
SAMPLE_ROWS = 20_000


def labelled(docs: DataFrame, labels: DataFrame, target: Column, rows: int = SAMPLE_ROWS, allowed: Column | None = None) -> DataFrame:
    """(doc_id, text, target) of at most ``rows`` labelled ids.

    ``target`` is a column over ``labels``; rows where it or the id is null are left
    out, and of labels that repeat an id the smallest counts.  The broadcast side
    has at most ``rows`` rows of two numbers.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), target.alias("target"))
    if allowed is not None:
        known = known.where(allowed)
    known = known.dropna().groupBy("doc_id").agg(F.min("target").alias("target"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "target")
