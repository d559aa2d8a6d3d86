"""Quotes to market probabilities, and probabilities against the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.names import pair_key
from contestry.functions.odds import decimal_implied, devig
from contestry.functions.parsing import trailing_hex_id
from contestry.operators.evaluation import fixed_rows
from contestry.operators.resolve import attach_names, nearest_any, orientation, resolve_names
from contestry.session import materialise

THRESHOLDS = (0.00, 0.05, 0.10)


def with_ids(raw: DataFrame) -> DataFrame:
    """Quotes with the ids that end their three links."""
    return raw.withColumns(
        {
            "contest_id": trailing_hex_id(F.col("contest_url")),
            "f1_id": trailing_hex_id(F.col("competitor_1_url")),
            "f2_id": trailing_hex_id(F.col("competitor_2_url")),
        }
    )


def known_quotes(quotes: DataFrame, contests: DataFrame) -> DataFrame:
    return quotes.join(contests.select("contest_id"), "contest_id", "left_semi")


def present(odds: Column) -> Column:
    """The quote, or null when it is missing or not a number."""
    return F.when(~F.isnan(odds), odds)


def consensus(quotes: DataFrame) -> DataFrame:
    """Per contest: medians per side, medians over two-sided quotes, book count.

    ``median`` counts distinct prices per contest before the shuffle, so a
    contest with very many quotes sends one small map per task.
    """
    one, two = present(F.col("odds_1")), present(F.col("odds_2"))
    both = one.isNotNull() & two.isNotNull()
    ids = F.struct("f1_id", "f2_id")
    linked = F.when(F.col("f1_id").isNotNull() & F.col("f2_id").isNotNull(), F.col("load_order"))
    return quotes.groupBy("contest_id").agg(
        F.median(one).alias("median_1"),
        F.median(two).alias("median_2"),
        F.median(F.when(both, one)).alias("settle_1"),
        F.median(F.when(both, two)).alias("settle_2"),
        F.count_if(both).alias("n_books"),
        F.min_by(ids, linked).alias("ids"),
        F.min_by(F.struct("competitor_1", "competitor_2"), "load_order").alias("names"),
    )


def align(quotes: DataFrame, contests: DataFrame, competitors: DataFrame) -> DataFrame:
    """Every quoted contest with its orientation, or the reason it is skipped.

    Ids decide first; names only where the ids do not fit either way round.
    """
    grouped = consensus(known_quotes(quotes, contests)).join(
        contests.select("contest_id", "competitor_a_id", "competitor_b_id"), "contest_id"
    )
    a, b = F.col("competitor_a_id"), F.col("competitor_b_id")
    flat = grouped.withColumns(
        {
            "by_id": orientation(F.col("ids.f1_id"), F.col("ids.f2_id"), a, b),
            "name_1": F.col("names.competitor_1"),
            "name_2": F.col("names.competitor_2"),
        }
    )
    # Stored, one row per contest: names and rows both start from it, and the
    # quotes are aggregated once.
    named = attach_names(materialise(flat.drop("ids", "names"), "consensus"), competitors, "name_1", "name_2")
    unresolved = F.concat_ws("; ", "reason_1", "reason_2")
    stray = F.concat(
        F.lit("resolved names '"), F.col("name_1"), F.lit("'/'"), F.col("name_2"),
        F.lit("' match neither side of this contest"),
    )
    by_name = orientation(F.col("id_1"), F.col("id_2"), a, b)
    side = F.coalesce("by_id", by_name)
    no_odds = F.col("median_1").isNull() | F.col("median_2").isNull()
    reason = (
        F.when(side.isNotNull() & no_odds, "no valid odds rows for this contest")
        .when(side.isNotNull(), None)
        .when(F.col("name_1").isNull() | F.col("name_2").isNull(), "missing competitor names")
        .when(F.col("id_1").isNull() | F.col("id_2").isNull(), unresolved)
        .otherwise(stray)
    )
    p_1, p_2 = devig(decimal_implied(F.col("median_1")), decimal_implied(F.col("median_2")))
    same, kept = side == "same", reason.isNull()

    def oriented(when_same: Column, when_swapped: Column) -> Column:
        return F.when(kept, F.when(same, when_same).otherwise(when_swapped))

    return named.select(
        "contest_id",
        oriented(F.col("settle_1"), F.col("settle_2")).alias("decimal_contest_a"),
        oriented(F.col("settle_2"), F.col("settle_1")).alias("decimal_contest_b"),
        oriented(p_1, p_2).alias("implied_contest_a"),
        oriented(p_2, p_1).alias("implied_contest_b"),
        F.when(kept, F.when(F.col("by_id").isNotNull(), "id").otherwise("name")).alias("align_method"),
        F.when(kept, F.col("n_books")).alias("n_books"),
        reason.alias("reason"),
    )


def aligned_only(alignment: DataFrame) -> DataFrame:
    return alignment.filter("reason IS NULL").drop("reason")


def alignment_counts(alignment: DataFrame) -> DataFrame:
    outcome = F.when(F.col("reason").isNotNull(), "skipped").otherwise(F.col("align_method"))
    return alignment.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def top_skip_reasons(alignment: DataFrame, k: int = 5) -> DataFrame:
    counts = alignment.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "reason").limit(k)


def join_market(features: DataFrame, alignment: DataFrame) -> DataFrame:
    """Features with the market turned to their side order."""
    merged = features.join(aligned_only(alignment), "contest_id")
    swapped = F.col("swapped")

    def first(stem: str) -> Column:
        return F.when(swapped, F.col(f"{stem}_b")).otherwise(F.col(f"{stem}_a"))

    def second(stem: str) -> Column:
        return F.when(swapped, F.col(f"{stem}_a")).otherwise(F.col(f"{stem}_b"))

    return merged.withColumns(
        {
            "market_a": first("implied_contest"),
            "market_b": 1.0 - first("implied_contest"),
            "decimal_a": first("decimal_contest"),
            "decimal_b": second("decimal_contest"),
        }
    )


def roi_sweep(scored: DataFrame, model: str = "model_p_a") -> DataFrame:
    """Flat one-unit stakes on either side wherever the edge exceeds a threshold."""
    p, won = F.col(model), F.col("y_winner") == 1
    bets = F.array(
        F.struct(
            F.lit("a").alias("bet_on"),
            (p - F.col("market_a")).alias("edge"),
            F.when(won, F.col("decimal_a") - 1.0).otherwise(-1.0).alias("profit"),
        ),
        F.struct(
            F.lit("b").alias("bet_on"),
            ((1.0 - p) - F.col("market_b")).alias("edge"),
            F.when(~won, F.col("decimal_b") - 1.0).otherwise(-1.0).alias("profit"),
        ),
    )
    swept = fixed_rows(scored.select(F.inline(bets)), THRESHOLDS, "threshold")
    taken = F.col("edge") > F.col("threshold")
    net = F.coalesce(F.sum(F.when(taken, F.col("profit"))), F.lit(0.0))
    n = F.count_if(taken)
    return swept.groupBy("threshold", "bet_on").agg(
        n.alias("n_bets"),
        n.cast("double").alias("staked"),
        F.round(net, 3).alias("net"),
        F.when(n > 0, F.round(100.0 * net / n, 3)).alias("roi_pct"),
    )


def check_favourites(
    control: DataFrame, contests: DataFrame, competitors: DataFrame, alignment: DataFrame
) -> DataFrame:
    """Known favourites against the aligned market.

    ``control`` is a short list: check_id, name_x, name_y, favourite, approx_date.
    Rows whose names do not resolve or that have no priced contest drop out.
    """
    named = attach_names(control, competitors, "name_x", "name_y")
    favourites = resolve_names(control.select(F.col("favourite").alias("name")), competitors)
    listed = (
        named.join(
            favourites.select(F.col("name").alias("favourite"), F.col("resolved_id").alias("favourite_id")),
            "favourite",
            "left",
        )
        .filter("id_1 IS NOT NULL AND id_2 IS NOT NULL")
        .withColumn("pair", pair_key(F.col("id_1"), F.col("id_2")))
    )
    priced = contests.join(aligned_only(alignment), "contest_id").withColumn(
        "pair", pair_key(F.col("competitor_a_id"), F.col("competitor_b_id"))
    )
    closest = nearest_any(listed, priced, "pair", ["check_id", "favourite_id"], "approx_date", "date", "contest_id")
    implied = F.when(
        F.col("competitor_a_id") == F.col("favourite_id"), F.col("implied_contest_a")
    ).otherwise(F.col("implied_contest_b"))
    return closest.join(priced.drop("pair"), "contest_id").select(
        "check_id", "contest_id", implied.alias("favourite_implied"), (implied > 0.5).alias("ok")
    )


def enforce_favourites(checked: DataFrame) -> None:
    row = checked.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_failed")).first()
    if row["n"] == 0:
        raise RuntimeError("no known favourite could be checked")
    if row["n_failed"]:
        raise AssertionError(f"{row['n_failed']} of {row['n']} known favourites are not the market's favourite")
