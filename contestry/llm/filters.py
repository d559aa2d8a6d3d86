"""Rows whose id a table does not list, without moving those that are surely not listed."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITMAP_BITS = 25


def _slot(key: str) -> Column:
    # as text, as ids that are equal may be of two types
    return F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit((1 << _BITMAP_BITS) - 1))


def _bitmap(ids: DataFrame, key: str) -> np.ndarray:
    """A bitmap of the ids; its size does not depend on the data."""
    words = ids.select(_slot(key).alias("slot")).selectExpr("slot >> 5 AS word", "shiftleft(1L, CAST(slot & 31 AS INT)) AS bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (_BITMAP_BITS - 5), np.uint32)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return bits.view(np.uint8)


def _asker(bitmap: Any) -> Any:
    """A column function: whether the slot is set."""

    @F.arrow_udf("boolean")
    def ask(slots: pa.Array) -> pa.Array:
        place = slots.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((bitmap.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)

    return ask


def parted(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows that ``ids`` surely does not list, and those that it may list."""
    ask = _asker(rows.sparkSession.sparkContext.broadcast(_bitmap(ids, key)))
    asked = rows.withColumn("_listed", ask(_slot(key)))
    return asked.where("not _listed").drop("_listed"), asked.where("_listed").drop("_listed")


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose id is not in ``ids``; a row without id is in no table and stays.

    Only rows that a bitmap of fixed size cannot rule out are joined, so the others
    never leave their scan.
    """
    clear, open_rows = parted(rows, ids, key)
    return clear.unionByName(open_rows.join(ids, key, "left_anti"))
