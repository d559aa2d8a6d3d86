"""Entity resolution: names to ids, quotes to sides, predictions to results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.names import folded_name, normal_name, pair_key

EXACT, FOLDED = "exact", "accent_folded"


def name_index(competitors: DataFrame, key: Column, label: str) -> DataFrame:
    """Per normalised name: how many competitors carry it, and one id."""
    return (
        competitors.filter(F.col("name").isNotNull())
        .groupBy(key.alias(f"{label}_key"))
        .agg(F.count("*").alias(f"{label}_n"), F.min("competitor_id").alias(f"{label}_id"))
    )


def resolve_names(names: DataFrame, competitors: DataFrame) -> DataFrame:
    """Distinct ``name`` -> (name, resolved_id, match_tier, reason).

    The folded tier is consulted only where the exact tier finds nobody, and
    either tier must find exactly one competitor.
    """
    keyed = names.select("name").filter("name IS NOT NULL").distinct().select(
        "name", normal_name(F.col("name")).alias("exact_key"), folded_name(F.col("name")).alias("folded_key")
    )
    exact = name_index(competitors, normal_name(F.col("name")), "exact")
    folded = name_index(competitors, folded_name(F.col("name")), "folded")
    found = keyed.join(exact, "exact_key", "left").join(folded, "folded_key", "left")
    n_exact = F.coalesce("exact_n", F.lit(0))
    n_folded = F.when(n_exact == 0, F.coalesce("folded_n", F.lit(0))).otherwise(0)
    quoted = F.concat(F.lit("name '"), F.col("name"), F.lit("'"))
    reason = (
        F.when((n_exact == 1) | (n_folded == 1), None)
        .when(
            n_exact > 1,
            F.concat(quoted, F.lit(" is ambiguous: matches "), n_exact.cast("string"), F.lit(" competitor ids")),
        )
        .when(
            n_folded > 1,
            F.concat(
                quoted,
                F.lit(" is ambiguous after accent folding: matches "),
                n_folded.cast("string"),
                F.lit(" competitor ids"),
            ),
        )
        .otherwise(F.concat(F.lit("no competitor matches "), quoted, F.lit(" (exact or accent-folded)")))
    )
    return found.select(
        "name",
        F.when(n_exact == 1, F.col("exact_id")).when(n_folded == 1, F.col("folded_id")).alias("resolved_id"),
        F.when(n_exact == 1, EXACT).when(n_folded == 1, FOLDED).alias("match_tier"),
        reason.alias("reason"),
    )


def attach_names(rows: DataFrame, competitors: DataFrame, first: str, second: str) -> DataFrame:
    """Add id, tier and reason of two name columns: ``{id,tier,reason}_{1,2}``."""
    names = rows.select(F.explode(F.array(first, second)).alias("name"))
    resolved = resolve_names(names, competitors)

    def of(number: int, column: str) -> DataFrame:
        return resolved.select(
            F.col("name").alias(column),
            F.col("resolved_id").alias(f"id_{number}"),
            F.col("match_tier").alias(f"tier_{number}"),
            F.col("reason").alias(f"reason_{number}"),
        )

    return rows.join(of(1, first), first, "left").join(of(2, second), second, "left")


def orientation(first: Column, second: Column, a: Column, b: Column) -> Column:
    """Whether a listed pair stands as (a, b), as (b, a) or as neither."""
    return F.when((first == a) & (second == b), "same").when((first == b) & (second == a), "swapped")


def _local_seconds(column: str) -> Column:
    """Seconds since 1970 on the wall clock, whatever the session's time zone."""
    at = F.col(column).cast("timestamp_ntz")
    of_day = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400 + of_day


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    pair: str,
    left_key: list[str],
    left_time: str,
    right_time: str,
    right_id: str,
    days: int,
) -> DataFrame:
    """For each left row the closest right row of the same pair within ``days``.

    Whole days count, so a gap of ``days`` plus some hours still matches.  Ties
    go to the earlier right row, then to the smaller id; at most one match.

    The candidates are the last right row up to the left time and the first one
    after it, found by two running windows over the union of both sides; no
    pairs are formed.  Groups are (pair, block of days), a left row entering
    each block its window touches, so a pair with very many rows is split.
    """
    reach = (days + 1) * 86_400
    span = 32 * 86_400
    seconds = {c: _local_seconds(c) for c in (left_time, right_time)}
    here = seconds[left_time]
    blocks = F.sequence(F.floor((here - reach) / span), F.floor((here + reach) / span))
    lefts = left.filter(F.col(pair).isNotNull()).select(
        pair, *left_key, here.alias("t"), F.explode(blocks).alias("block")
    )
    rights = right.select(
        pair,
        seconds[right_time].alias("t"),
        F.floor(seconds[right_time] / span).alias("block"),
        F.struct(seconds[right_time].alias("t"), F.col(right_id).alias("id")).alias("result"),
    )
    both = lefts.withColumn("is_left", F.lit(1)).unionByName(
        rights.withColumn("is_left", F.lit(0)), allowMissingColumns=True
    )
    result_id = F.col("result.id")
    # At one instant right rows come first, ids downwards, so the last one read
    # before the left row is the smallest id.
    group = Window.partitionBy(pair, "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upward = group.orderBy("t", "is_left", F.desc(result_id))
    downward = group.orderBy(F.desc("t"), "is_left", F.desc(result_id))
    seen = both.select(
        "*",
        F.last("result", ignorenulls=True).over(upward).alias("before"),
        F.last("result", ignorenulls=True).over(downward).alias("after"),
    ).filter("is_left = 1")
    gap = F.abs(F.col("c.t") - F.col("t"))
    return (
        seen.select(*left_key, "t", F.explode(F.array("before", "after")).alias("c"))
        .filter(F.col("c").isNotNull() & (gap < reach))
        .groupBy(*left_key)
        .agg(F.min_by("c.id", F.struct(gap.alias("gap"), F.col("c.t"), F.col("c.id"))).alias(right_id))
    )


def nearest_any(
    left: DataFrame, right: DataFrame, pair: str, left_key: list[str], left_time: str, right_time: str, right_id: str
) -> DataFrame:
    """For each row of a short control list the closest right row of its pair."""
    gap = F.abs(F.datediff(right_time, left_time))
    return (
        left.select(pair, *left_key, left_time)
        .join(right.select(pair, right_time, right_id), pair)
        .groupBy(*left_key)
        .agg(F.min_by(right_id, F.struct(gap.alias("gap"), F.col(right_time), F.col(right_id))).alias(right_id))
    )


def with_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("pair", pair_key(F.col(a), F.col(b)))
