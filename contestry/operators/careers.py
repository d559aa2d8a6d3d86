"""Running state of each competitor just before each of their contests.

All of it comes from one shuffle by competitor and one sort by (date, contest).
A competitor with more rows than ``HOT_ROWS`` is cut into one block per day:
each block is windowed on its own, and the state at the end of the earlier
blocks is added from a small table with one row per block.  Sums add, the
latest positions take the maximum, the last-five lists concatenate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
FORM = 5

KEY = "competitor_id"
ORDER = ("date", "contest_id")

# The running sums of a career, by output name.
SUMS = (
    "wins", "finish_wins", "kd", "sub_att", "td_landed", "td_attempted",
    "opp_td_landed", "opp_td_attempted", "sig_landed", "sig_absorbed",
    "ctrl_sec", "time_sec",
)


def hot_keys(sides: DataFrame, limit: int) -> DataFrame | None:
    """Competitors above ``limit`` rows: at most rows/limit of them, or None."""
    counted = sides.groupBy(KEY).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    found = counted.select(KEY).collect()
    if not found:
        return None
    return sides.sparkSession.createDataFrame(found, sides.select(KEY).schema)


def _blocked(sides: DataFrame, limit: int, counted: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Tag the rows of hot competitors with their day; others keep one null block.

    ``counted`` has the same competitors as often, where that is cheaper to read.
    """
    hot = hot_keys(sides if counted is None else counted, limit)
    if hot is None:
        return sides, [KEY]
    flagged = sides.join(F.broadcast(hot.withColumn("hot", F.lit(True))), KEY, "left")
    block = F.when(F.col("hot"), F.to_date("date"))
    return flagged.withColumn("block", block).drop("hot"), [KEY, "block"]


def career_links(sides: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Add each row's career ordinal and the competitor's next contest."""
    tagged, keys = _blocked(sides, limit)
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    here = F.struct("contest_id", "side", "date")
    local = tagged.select(
        "*", F.row_number().over(w).alias("ordinal"), F.lead(here).over(w).alias("next")
    )
    if len(keys) == 1:
        return local
    ends = local.filter(F.col("block").isNotNull()).groupBy(*keys).agg(
        F.max("ordinal").alias("n"), F.min_by(here, "ordinal").alias("opening")
    )
    over_blocks = Window.partitionBy(KEY).orderBy("block")
    carry = ends.select(
        *keys,
        F.sum("n").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("n_before"),
        F.lead("opening").over(over_blocks).alias("next_opening"),
    )
    return (
        local.join(carry, keys, "left")
        .withColumn("ordinal", (F.col("ordinal") + F.coalesce("n_before", F.lit(0))).cast("int"))
        .withColumn("next", F.coalesce("next", "next_opening"))
        .drop("block", "n_before", "next_opening")
    )


def _local_state(sides: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    rn = F.row_number().over(w)
    numbered = sides.withColumn("rn", rn)
    position = F.col("rn")
    return (
        numbered.select(
            "*",
            (position - 1).alias("n"),
            *[F.coalesce(F.sum(c).over(prior), F.lit(0.0)).alias(f"run_{c}") for c in SUMS],
            F.max("date").over(prior).alias("last_date"),
            F.lag("score").over(w).alias("last_score"),
            F.max(F.when(F.col("score") != 1.0, position)).over(prior).alias("last_nonwin"),
            F.max(F.when(F.col("score") != 0.0, position)).over(prior).alias("last_nonloss"),
            F.collect_list("score").over(w.rowsBetween(-FORM, -1)).alias("form"),
            F.count("opp_elo").over(prior).alias("rated_before"),
            F.lead("contest_id").over(w).isNull().alias("is_last"),
        )
        # The five latest rated opponents: positions among rated rows only.
        .withColumn(
            "opp_form",
            F.collect_list("opp_elo").over(
                Window.partitionBy(*keys).orderBy("rated_before").rangeBetween(-FORM, -1)
            ),
        )
        .drop("rn", "rated_before")
    )


def _tail(values: Column) -> Column:
    size = F.size(values)
    return F.slice(values, F.greatest(size - (FORM - 1), F.lit(1)), F.lit(FORM))


def after(state: DataFrame) -> DataFrame:
    """The state columns once the row's own contest is counted."""
    grown = state.select("*", (F.col("n") + 1).alias("n_now"))
    rated = F.when(F.col("opp_elo").isNotNull(), F.array("opp_elo")).otherwise(
        F.array().cast("array<double>")
    )
    columns = {f"run_{c}": F.col(f"run_{c}") + F.coalesce(F.col(c), F.lit(0.0)) for c in SUMS}
    columns |= {
        "n": F.col("n_now"),
        "last_date": F.col("date"),
        "last_score": F.col("score"),
        "last_nonwin": F.when(F.col("score") != 1.0, F.col("n_now")).otherwise(F.col("last_nonwin")),
        "last_nonloss": F.when(F.col("score") != 0.0, F.col("n_now")).otherwise(F.col("last_nonloss")),
        "form": _tail(F.concat("form", F.array("score"))),
        "opp_form": _tail(F.concat("opp_form", rated)),
    }
    return grown.withColumns(columns).drop("n_now")


_STATE = (
    ["n"] + [f"run_{c}" for c in SUMS]
    + ["last_date", "last_score", "last_nonwin", "last_nonloss", "form", "opp_form"]
)


def _carried(local: DataFrame) -> DataFrame:
    """State at the start of every block of a hot competitor."""
    ends = after(local.filter(F.col("block").isNotNull() & F.col("is_last")))
    before = Window.partitionBy(KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0))
    placed = ends.select(KEY, "block", *_STATE, offset.alias("offset"))
    return placed.select(
        KEY,
        "block",
        F.col("offset").alias("c_n"),
        *[F.sum(f"run_{c}").over(before).alias(f"c_run_{c}") for c in SUMS],
        F.max("last_date").over(before).alias("c_last_date"),
        F.last("last_score").over(before).alias("c_last_score"),
        *[
            F.max(F.col(c) + F.col("offset")).over(before).alias(f"c_{c}")
            for c in ("last_nonwin", "last_nonloss")
        ],
        # Five blocks back can only fall short when blocks are small or unrated,
        # so the list keeps every block; one block adds at most five numbers.
        *[
            _tail(F.flatten(F.collect_list(c).over(before))).alias(f"c_{c}")
            for c in ("form", "opp_form")
        ],
    )


def career_state(sides: DataFrame, limit: int = HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Add the competitor's state before each contest to the side rows.

    ``sides`` needs the columns contest_id, side, competitor_id, date, score,
    opp_elo and the per-contest values named in ``SUMS``; ``counted`` may give their
    competitors alone, one row each, so that counting them joins nothing.
    """
    tagged, keys = _blocked(sides, limit, counted)
    local = _local_state(tagged, keys)
    if len(keys) == 1:
        return local
    joined = local.join(_carried(local), keys, "left")
    shift = F.coalesce("c_n", F.lit(0))
    columns = {"n": F.col("n") + shift}
    columns |= {
        f"run_{c}": F.col(f"run_{c}") + F.coalesce(F.col(f"c_run_{c}"), F.lit(0.0)) for c in SUMS
    }
    columns |= {c: F.coalesce(c, f"c_{c}") for c in ("last_date", "last_score")}
    columns |= {c: F.coalesce(F.col(c) + shift, F.col(f"c_{c}")) for c in ("last_nonwin", "last_nonloss")}
    columns |= {
        c: _tail(F.concat(F.coalesce(f"c_{c}", F.array().cast("array<double>")), c))
        for c in ("form", "opp_form")
    }
    last_block = Window.partitionBy(KEY).orderBy("block")
    ends = joined.filter(F.col("is_last") & F.col("block").isNotNull()).select(
        *keys, F.lead("block").over(last_block).isNull().alias("ends_career")
    )
    return (
        joined.withColumns(columns)
        .join(ends, keys, "left")
        .withColumn("is_last", F.col("is_last") & F.coalesce("ends_career", F.lit(True)))
        .drop("block", "ends_career", *[f"c_{c}" for c in _STATE])
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def streak(n: Column, last_score: Column, last_nonwin: Column, last_nonloss: Column) -> Column:
    """Signed run length of the latest result; a draw resets to zero."""
    return (
        F.when(last_score == 1.0, n - F.coalesce(last_nonwin, F.lit(0)))
        .when(last_score == 0.0, -(n - F.coalesce(last_nonloss, F.lit(0))))
        .otherwise(0)
    )


def career_stats() -> dict[str, Column]:
    """Career statistics as expressions over the state columns."""
    run = {c: F.col(f"run_{c}") for c in SUMS}
    n = F.col("n")
    minutes = run["time_sec"] / 60.0
    return {
        "career_fights": n,
        "career_wins": run["wins"],
        "career_win_rate": _ratio(run["wins"], n),
        "career_finish_rate": _ratio(run["finish_wins"], run["wins"]),
        "kd_pf": _ratio(run["kd"], n),
        "sub_att_pf": _ratio(run["sub_att"], n),
        "td_landed_pf": _ratio(run["td_landed"], n),
        "td_acc": _ratio(run["td_landed"], run["td_attempted"]),
        "td_def": 1 - _ratio(run["opp_td_landed"], run["opp_td_attempted"]),
        "sig_pm": _ratio(run["sig_landed"], minutes),
        "sig_absorbed_pm": _ratio(run["sig_absorbed"], minutes),
        "ctrl_share": _ratio(run["ctrl_sec"], run["time_sec"]),
        "streak": streak(n, F.col("last_score"), F.col("last_nonwin"), F.col("last_nonloss")),
        "days_since_last": F.datediff("date", "last_date"),
        "last5_win_rate": _mean(F.col("form")),
        "last5_avg_opp_elo": _mean(F.col("opp_form")),
    }


STAT_NAMES = tuple(
    "career_fights career_wins career_win_rate career_finish_rate kd_pf sub_att_pf td_landed_pf "
    "td_acc td_def sig_pm sig_absorbed_pm ctrl_share streak days_since_last last5_win_rate "
    "last5_avg_opp_elo".split()
)
