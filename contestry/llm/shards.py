"""Shards of near-equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id).  Shard limits are places in
that order.  Each round counts the exact bytes of all rows in the slices that still
hold a limit, cut 4096 ways, and keeps the slice that holds each limit, until every
limit is within tolerance of its target.  Then rows move once.

Equal texts share the first hash.  A limit that would fall inside a group of equal
texts goes to the nearer end of it, unless the group holds more than ``GROUP_SHARE``
of a shard's mean size; there the second hash goes on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.session import materialise

_BITS = 12
_WAYS = 1 << _BITS
_STEPS = 12  # six for each of the two 64-bit hashes, the last of six with 4 bits
#: Groups of equal texts up to this share of a shard stay together.
GROUP_SHARE = 0.02


def _digit(step: int) -> Column:
    """The ``step``-th digit of the order, most significant first."""
    key = F.col("k1") if step < 6 else F.col("k2")
    shift = 64 - _BITS * (step % 6 + 1)
    digit = F.shiftrightunsigned(key, shift) if shift > 0 else key
    return digit.bitwiseAND(F.lit(_WAYS - 1 if shift > 0 else 15)).cast("int")


@dataclass
class _Limit:
    """A shard limit: rows whose digits come before ``digits`` lie below it."""

    target: float
    digits: tuple[int, ...] = ()
    below: int = 0
    settled: bool = False


def _slice_of(digits: tuple[int, ...]) -> Column:
    found = F.lit(True)
    for step, digit in enumerate(digits):
        found = found & (_digit(step) == digit)
    return found


def _refine(sized: DataFrame, limits: list[_Limit], step: int, tolerance: float, group: float) -> None:
    """One round: exact bytes of the digits of ``step`` within the open limits' slices.

    What reaches the driver is at most 4096 sums for each open limit.
    """
    places = sorted({limit.digits for limit in limits if not limit.settled})
    which = F.coalesce(*(F.when(_slice_of(p), F.lit(i)) for i, p in enumerate(places)))
    counted = sized.select(which.alias("slice"), _digit(step).alias("digit"), "size").where("slice is not null")
    rows = counted.groupBy("slice", "digit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    sums: dict[int, list] = {}
    for row in sorted(rows, key=lambda r: (r["slice"], r["digit"])):
        sums.setdefault(row["slice"], []).append(row)
    for limit in limits:
        if limit.settled:
            continue
        found = sums[places.index(limit.digits)]
        base = limit.digits
        for row in found:
            above = limit.below + row["bytes"]
            if above >= limit.target or row is found[-1]:
                low, high = limit.target - limit.below, above - limit.target
                limit.digits = (*base, row["digit"])
                whole = step == _STEPS // 2 - 1 and row["bytes"] <= group
                last = step == _STEPS - 1 or row["n"] == 1 or whole
                if min(low, high) <= tolerance or last:
                    limit.settled = True
                    if high < low:
                        limit.digits, limit.below = (*base, row["digit"] + 1), above
                break
            limit.below = above


def _place(digits: tuple[int, ...]) -> int:
    """A limit as a number of 128 bits; a digit past its last value carries over."""
    return sum(digit << 128 - 64 * (step // 6) - min(_BITS * (step % 6 + 1), 64) for step, digit in enumerate(digits))


def _ordered(key: Column) -> Column:
    """An unsigned 64-bit key as the signed number of the same rank."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def _shard(limits: list[_Limit]) -> Column:
    """How many limits a row lies at or above: a binary search in one array of them."""
    places = sorted(place for place in (_place(limit.digits) for limit in limits if limit.digits) if place < 1 << 128)
    if not places:
        return F.lit(0)
    halves = [(place >> 64, place & (1 << 64) - 1) for place in places]
    found = F.array(*[F.struct(*[F.lit(half - (1 << 63)).cast("long") for half in both]) for both in halves])
    row = F.struct(_ordered(F.col("k1")), _ordered(F.col("k2")))
    strides = [1 << bit for bit in reversed(range(len(places).bit_length()))]

    def passed(at: Column, stride: Column) -> Column:
        beyond = at + stride
        return F.when((beyond <= len(places)) & (F.get(found, beyond - 1) <= row), beyond).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, strides)), F.lit(0), passed)


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, overhead: int = 16, tolerance: float = 0.001,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with size, shard and slot: shards of near-equal total size.

    size is the text's UTF-8 bytes (null: none) plus ``overhead``.  Limits are
    within ``tolerance`` of a shard's mean size, or as near as single rows and groups of
    equal texts of at most ``GROUP_SHARE`` of a shard, which stay together, allow.
    slot numbers a shard's rows from 0 without gaps.  Rows that repeat an id and
    text, and null ids, are rows like others.  An empty table stays empty.  Columns
    size, shard and slot of ``docs`` are replaced, others are carried through.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.drop("size", "shard", "slot").withColumns(
        {
            "size": F.octet_length(text).cast("long") + overhead,
            "k1": F.xxhash64(text),
            "k2": F.xxhash64(F.lit(7), F.col(id_col).cast("string")),
        }
    )
    sized = materialise(keyed.select("size", "k1", "k2"), "shard_keys")
    total = sized.agg(F.sum("size")).first()[0] or 0
    limits = [_Limit(total * i / shards) for i in range(1, shards)]
    for step in range(_STEPS):
        if total and not all(limit.settled for limit in limits):
            _refine(sized, limits, step, tolerance * total / shards, GROUP_SHARE * total / shards)
    shard = _shard(limits)
    # a shard's rows are numbered piece by piece; the pieces' counts place them
    pieces = ["shard", "p1", "p2"]
    placed = keyed.withColumns({"shard": shard, "p1": _digit(0), "p2": F.shiftrightunsigned("k2", 58).cast("int")})
    counts = sized.select(shard.alias("shard"), _digit(0).alias("p1"), F.shiftrightunsigned("k2", 58).cast("int").alias("p2"))
    counts = counts.groupBy(*pieces).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("p1", "p2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*pieces, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*pieces).orderBy("k1", "k2", id_col)
    numbered = placed.withColumn("place", F.row_number().over(inside).cast("long") - 1).join(offsets, pieces)
    return numbered.withColumn("slot", F.col("place") + F.col("offset")).drop("k1", "k2", "p1", "p2", "place", "offset")


def plan(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: its size, checksum, shard and slot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_by_bytes(own, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
