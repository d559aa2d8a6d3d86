"""Raw tables to clean competitors, contests and per-side statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions import labels
from contestry.functions.parsing import mixed_date, number, strip

# Statistic name -> column suffix in the wide raw table.
STAT_SUFFIXES = {
    "kd": "kd",
    "sig_landed": "sig_str_landed",
    "sig_attempted": "sig_str_atmpted",
    "total_landed": "total_str_landed",
    "total_attempted": "total_str_atmpted",
    "td_landed": "td_landed",
    "td_attempted": "td_atmpted",
    "sub_att": "sub_att",
    "ctrl_sec": "ctrl",
}
STATS = tuple(STAT_SUFFIXES)

CONTEST_COLUMNS = (
    "contest_id", "date", "competitor_a_id", "competitor_b_id", "winner",
    "method", "method_raw", "decision_subtype", "finish_round",
    "scheduled_rounds", "weight_class", "title_fight", "duration_sec",
)


def build_competitors(raw: DataFrame) -> DataFrame:
    """Stable id and biography; career totals in the raw table would leak the future."""
    return raw.select(
        strip(F.col("id")).alias("competitor_id"),
        strip(F.col("name")).alias("name"),
        number(F.col("height")).alias("height_cm"),
        number(F.col("reach")).alias("reach_cm"),
        strip(F.col("stance")).alias("stance"),
        mixed_date(F.col("dob")).alias("dob"),
    )


def build_contests(raw: DataFrame) -> DataFrame:
    """One row per contest: ids, date, winner code, targets and context.

    In steps, so that a text is cleaned once and no step grows into a method that the
    JVM would not compile.
    """
    read = raw.select(
        strip(F.col("contest_id")).alias("contest_id"),
        mixed_date(F.col("date")).alias("date"),
        strip(F.col("r_id")).alias("competitor_a_id"),
        strip(F.col("b_id")).alias("competitor_b_id"),
        "winner_id",
        F.col("method").alias("method_raw"),
        labels.plain_text(F.col("method")).alias("method_text"),
        number(F.col("finish_round")).cast("int").alias("last_round"),
        number(F.col("total_rounds")).cast("int").alias("scheduled_rounds"),
        labels.plain_text(F.col("division")).alias("class_text"),
        (F.coalesce(number(F.col("title_fight")), F.lit(0.0)) != 0).alias("title_fight"),
        number(F.col("match_time_sec")).alias("clock"),
    )
    winner = labels.winner_code(*[F.col(c) for c in ("winner_id", "competitor_a_id", "competitor_b_id", "method_raw")])
    named = read.withColumns(
        {
            "winner": winner,
            "method": labels.method_in(F.col("method_text")),
            "decision_subtype": labels.decision_subtype_in(F.col("method_text")),
            "weight_class": labels.weight_class_in(F.col("class_text")),
        }
    )
    method, last_round = F.col("method"), F.col("last_round")
    duration = labels.duration_seconds(method, last_round, F.col("scheduled_rounds"), F.col("clock"))
    return named.withColumns({"finish_round": labels.finish_round(method, last_round), "duration_sec": duration}).select(*CONTEST_COLUMNS)


def build_side_stats(raw: DataFrame) -> DataFrame:
    """Wide ``r_``/``b_`` statistics to two rows per contest."""

    def side(letter: str, prefix: str) -> Column:
        return F.struct(
            strip(F.col(f"{prefix}id")).alias("competitor_id"),
            F.lit(letter).alias("side"),
            *[number(F.col(prefix + raw_name)).alias(out) for out, raw_name in STAT_SUFFIXES.items()],
        )

    return raw.select(
        strip(F.col("contest_id")).alias("contest_id"),
        F.inline(F.array(side("a", "r_"), side("b", "b_"))),
    )


def sides(contests: DataFrame, *keep: str) -> DataFrame:
    """Two rows per contest: (contest_id, side, competitor_id, opponent_id, kept columns)."""

    def one(letter: str, other: str) -> Column:
        return F.struct(
            F.lit(letter).alias("side"),
            F.col(f"competitor_{letter}_id").alias("competitor_id"),
            F.col(f"competitor_{other}_id").alias("opponent_id"),
        )

    return contests.select(
        "contest_id", *keep, F.inline(F.array(one("a", "b"), one("b", "a")))
    )


def rated(contests: DataFrame) -> DataFrame:
    return contests.filter(F.col("winner").isin(*labels.RATED))


def decisive(contests: DataFrame) -> DataFrame:
    return contests.filter(F.col("winner").isin(*labels.DECISIVE))


# --- quality checks -------------------------------------------------------


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Missing or repeated keys with their row counts."""
    return (
        df.groupBy(F.col(key).alias("key"))
        .agg(F.count("*").alias("n_rows"))
        .filter(F.col("key").isNull() | (F.col("n_rows") > 1))
        .select(
            F.when(F.col("key").isNull(), "missing").otherwise("duplicate").alias("violation"),
            "key",
            "n_rows",
        )
    )


def side_violations(contests: DataFrame) -> DataFrame:
    """Contests with a missing side or the same competitor on both sides."""
    a, b = F.col("competitor_a_id"), F.col("competitor_b_id")
    return contests.filter(a.isNull() | b.isNull() | (a == b)).select(
        F.when(a.isNull() | b.isNull(), "missing_side").otherwise("same_competitor").alias("violation"),
        "contest_id",
    )


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise when a violation frame has rows; shows a few of them."""
    found = violations.take(5)
    if found:
        raise ValueError(f"{message}: {[row.asDict() for row in found]}")


def orphans(contests: DataFrame, competitors: DataFrame) -> DataFrame:
    """Ids that take part in contests but have no competitor row."""
    ids = sides(contests).select("competitor_id").distinct()
    return ids.join(competitors.select("competitor_id"), "competitor_id", "left_anti")


def one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row measurements side by side."""
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def integrity_report(contests: DataFrame, stats: DataFrame, competitors: DataFrame) -> DataFrame:
    """One row of batch measurements with the verdict of each gate."""
    of_contests = contests.agg(
        F.count("*").alias("n_contests"),
        F.count_if(F.col("date").isNull()).alias("n_bad_dates"),
        F.avg(F.col("method").isNotNull().cast("double")).alias("method_coverage"),
        F.avg(F.col("weight_class").isNotNull().cast("double")).alias("class_coverage"),
    )
    of_stats = stats.agg(F.count("*").alias("n_stats"))
    ids = sides(contests).select("competitor_id").distinct()
    known = competitors.select("competitor_id", F.lit(True).alias("known"))
    of_ids = ids.join(known, "competitor_id", "left").agg(
        F.count("*").alias("n_participants"),
        F.count_if(F.col("known").isNull()).alias("n_orphans"),
    )
    return (
        one_row(of_contests, of_stats, of_ids)
        .select(
            "*",
            (F.col("n_bad_dates") == 0).alias("dates_ok"),
            (F.col("n_stats") == 2 * F.col("n_contests")).alias("stats_ok"),
            (F.col("n_orphans") < 0.02 * F.col("n_participants")).alias("orphans_ok"),
            (F.col("method_coverage") > 0.95).alias("method_ok"),
            (F.col("class_coverage") > 0.95).alias("class_ok"),
        )
    )


def enforce_integrity(report: DataFrame) -> None:
    row = report.first().asDict()
    failed = [name for name, value in row.items() if name.endswith("_ok") and not value]
    if failed:
        raise ValueError(f"integrity gates failed: {failed} in {row}")


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))


def rows_per_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_rows"))


def contest_totals(stats: DataFrame) -> DataFrame:
    """Both sides' totals per contest; null only where both sides are null."""
    return stats.groupBy("contest_id").agg(
        *[F.sum(c).alias(c) for c in ("sig_landed", "td_landed", "sub_att", "ctrl_sec")]
    )
