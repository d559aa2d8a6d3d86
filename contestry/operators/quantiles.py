"""Exact medians of many columns at any row count."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BINS = 1024
#: Columns of one aggregate; with more, its generated method is too long for the JVM to compile.
COLUMNS_AT_ONCE = 12


def batches(columns: Sequence[str]) -> list[Sequence[str]]:
    """The columns in order, some at a time."""
    return [columns[k : k + COLUMNS_AT_ONCE] for k in range(0, len(columns), COLUMNS_AT_ONCE)]


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Column -> exact median (mean of the two middle values), None if all null.

    NaN counts as the largest value, above infinity, as in Spark's sort order.  Each
    middle value is bracketed: a pass counts the values of 1024 equal bins of every
    open bracket, and the bin that holds the wanted rank is the next bracket, until
    it holds one value.  A pass returns at most 1024 counts per bracket, whatever
    the row count; a pass that narrows nothing fails.  Columns go through the passes
    a dozen at a time.
    """
    return {c: median for some in batches(columns) for c, median in _medians(df, some).items()}


def _medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The medians of a few columns, all out of the same passes."""
    value = {c: F.col(c).cast("double") for c in columns}

    def finite(c: str) -> Column:
        return ~F.isnan(value[c]) & (F.abs(value[c]) < math.inf)

    wanted = {
        "n": lambda c: F.count(c),
        "nan": lambda c: F.count_if(F.isnan(value[c])),
        "low": lambda c: F.count_if(value[c] == -math.inf),
        "high": lambda c: F.count_if(value[c] == math.inf),
        "from": lambda c: F.min(F.when(finite(c), value[c])),
        "to": lambda c: F.max(F.when(finite(c), value[c])),
    }
    row = df.agg(*[make(c).alias(f"{name}_{k}") for k, c in enumerate(columns) for name, make in wanted.items()]).first()
    stats = {c: {name: row[f"{name}_{k}"] for name in wanted} for k, c in enumerate(columns)}

    found: dict[tuple[str, int], float] = {}
    brackets: dict[tuple[str, int], tuple[float, float, int]] = {}  # low, high, values below low
    for c, s in stats.items():
        for rank in {(s["n"] - 1) // 2, s["n"] // 2} if s["n"] else ():
            if rank < s["low"]:
                found[c, rank] = -math.inf
            elif rank >= s["n"] - s["nan"]:
                found[c, rank] = math.nan
            elif rank >= s["n"] - s["nan"] - s["high"]:
                found[c, rank] = math.inf
            else:
                brackets[c, rank] = (s["from"], s["to"], s["low"])
    while brackets:
        for key in [k for k, (low, high, _) in brackets.items() if low == high]:
            found[key] = brackets.pop(key)[0]
        if brackets:
            brackets = _narrowed(df, brackets)
    return {c: (found[c, (s["n"] - 1) // 2] + found[c, s["n"] // 2]) / 2.0 if s["n"] else None for c, s in stats.items()}


def _narrowed(df: DataFrame, brackets: dict[tuple[str, int], tuple[float, float, int]]) -> dict[tuple[str, int], tuple[float, float, int]]:
    """Each bracket cut down to the bin of its rank; equal brackets are counted once."""
    spans = sorted({(c, low, high) for (c, _), (low, high, _) in brackets.items()})
    parts = []
    for k, (c, low, high) in enumerate(spans):
        value = F.col(c).cast("double")
        half = 0.5 if math.isinf(high - low) else 1.0  # so that the width of a bracket does not overflow
        share = (value * half - low * half) / (high * half - low * half)
        bin_index = F.least(F.floor(share * _BINS), F.lit(_BINS - 1))
        parts.append(F.struct(F.lit(k).alias("span"), F.when(value.between(low, high), bin_index).alias("bin"), value.alias("value")))
    counted = df.select(F.inline(F.array(*parts))).filter("bin IS NOT NULL").groupBy("span", "bin")
    rows = counted.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    bins: dict[int, list] = {}
    for row in sorted(rows, key=lambda r: (r["span"], r["bin"])):
        bins.setdefault(row["span"], []).append(row)
    narrowed = {}
    for (c, rank), (low, high, below) in brackets.items():
        for row in bins[spans.index((c, low, high))]:
            if below + row["n"] > rank:
                break
            below += row["n"]
        if (row["low"], row["high"]) == (low, high):
            raise RuntimeError(f"the median of {c} cannot be bracketed within {low} and {high}")
        narrowed[c, rank] = (row["low"], row["high"], below)
    return narrowed
