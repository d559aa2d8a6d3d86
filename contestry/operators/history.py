"""Point-in-time career history and current snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.labels import is_finish
from contestry.functions.rating import score_of
from contestry.operators import careers
from contestry.operators.dataset import rated, sides

_TRACKS = ("overall", "striking", "grappling")
_USED_STATS = ("kd", "sub_att", "td_landed", "td_attempted", "sig_landed", "ctrl_sec")


def stats_by_contest(stats: DataFrame) -> DataFrame:
    """Both sides' statistics on one row per contest: structs ``stats_a``, ``stats_b``."""

    def of(side: str) -> Column:
        picked = [F.max(F.when(F.col("side") == side, F.col(c))).alias(c) for c in _USED_STATS]
        return F.struct(*picked).alias(f"stats_{side}")

    return stats.groupBy("contest_id").agg(of("a"), of("b"))


def side_values(
    contests: DataFrame, stats: DataFrame, ratings: DataFrame | None = None, post: bool = False
) -> DataFrame:
    """Per side of each rated contest: own and opposing numbers, nulls counted as zero; with ``post`` the own ratings after it.

    The joins are all on contest_id and precede the split into sides, so a
    contest is shuffled once and looked up for own and opponent at no extra cost.
    """
    base = rated(contests).select(
        "contest_id", "date", "competitor_a_id", "competitor_b_id", "winner", "method", "duration_sec"
    ).join(stats_by_contest(stats), "contest_id", "left")
    if ratings is None:
        base = base.withColumns({f"elo_{s}": F.lit(None).cast("double") for s in "ab"})
    else:
        values = {"elo": "pre_overall"} | ({f"post_{t}": f"post_{t}" for t in _TRACKS} if post else {})
        elo = ratings.groupBy("contest_id").agg(
            *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{name}_{s}") for s in "ab" for name, c in values.items()]
        )
        base = base.join(elo, "contest_id", "left")

    def zero(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"stats_{side}.{name}").cast("double"), F.lit(0.0))

    def one(own: str, opp: str) -> Column:
        score = score_of(F.col("winner"), own)
        finished = (score == 1.0) & is_finish(F.col("method"))
        return F.struct(
            F.lit(own).alias("side"),
            F.col(f"competitor_{own}_id").alias("competitor_id"),
            score.alias("score"),
            score.alias("wins"),
            finished.cast("double").alias("finish_wins"),
            zero(own, "kd").alias("kd"),
            zero(own, "sub_att").alias("sub_att"),
            zero(own, "td_landed").alias("td_landed"),
            zero(own, "td_attempted").alias("td_attempted"),
            zero(opp, "td_landed").alias("opp_td_landed"),
            zero(opp, "td_attempted").alias("opp_td_attempted"),
            zero(own, "sig_landed").alias("sig_landed"),
            zero(opp, "sig_landed").alias("sig_absorbed"),
            zero(own, "ctrl_sec").alias("ctrl_sec"),
            F.coalesce("duration_sec", F.lit(0.0)).alias("time_sec"),
            F.col(f"elo_{opp}").alias("opp_elo"),
            *[F.col(f"post_{t}_{own}").alias(f"elo_{t}") for t in _TRACKS if post],
        )

    return base.select("contest_id", "date", F.inline(F.array(one("a", "b"), one("b", "a"))))


def career_state(contests: DataFrame, stats: DataFrame, ratings: DataFrame | None, limit: int, post: bool = False) -> DataFrame:
    """The side rows with the competitor's state before; competitors are counted off the contests alone."""
    return careers.career_state(side_values(contests, stats, ratings, post), limit, sides(rated(contests)).select(careers.KEY))


def build_history(
    contests: DataFrame,
    stats: DataFrame,
    ratings: DataFrame | None = None,
    limit: int = careers.HOT_ROWS,
) -> DataFrame:
    """Two rows per rated contest with the career statistics before it."""
    state = career_state(contests, stats, ratings, limit)
    return state.select(
        "contest_id",
        "side",
        "competitor_id",
        "date",
        *[value.alias(name) for name, value in careers.career_stats().items()],
    )


def build_snapshots(
    contests: DataFrame, stats: DataFrame, ratings: DataFrame, limit: int = careers.HOT_ROWS
) -> DataFrame:
    """One row per competitor: statistics after the last contest and current ratings."""
    state = career_state(contests, stats, ratings, limit)
    final = careers.after(state.filter("is_last"))
    values = careers.career_stats()
    values.pop("days_since_last")
    stats_now = final.select(
        "competitor_id",
        *[value.alias(name) for name, value in values.items()],
        "last_date",
    )
    return stats_now.join(last_ratings(ratings), "competitor_id", "left")


def snapshots_before(
    contests: DataFrame, stats: DataFrame, ratings: DataFrame, cut: Column, limit: int = careers.HOT_ROWS
) -> DataFrame:
    """Snapshots out of the contests strictly before ``cut``."""
    earlier = F.col("date") < cut
    return build_snapshots(contests.filter(earlier), stats, ratings.filter(earlier), limit)


def last_ratings(ratings: DataFrame) -> DataFrame:
    """Each competitor's ratings after the latest (date, contest)."""
    latest = F.max_by(
        F.struct(
            F.col("post_overall").alias("elo_overall"),
            F.col("post_striking").alias("elo_striking"),
            F.col("post_grappling").alias("elo_grappling"),
        ),
        F.struct("date", "contest_id"),
    )
    return ratings.groupBy("competitor_id").agg(latest.alias("now")).select("competitor_id", "now.*")


# --- states as of any date ------------------------------------------------------------

#: Days of one block of a competitor's time line.
BLOCK_DAYS = 32


def states_after(
    contests: DataFrame, stats: DataFrame, ratings: DataFrame, limit: int = careers.HOT_ROWS
) -> DataFrame:
    """(competitor_id, date, contest_id, now): what ``build_snapshots`` gives, after every contest."""
    # the ratings after a contest come with its side, so the states themselves aren't joined with them
    state = careers.after(career_state(contests, stats, ratings, limit, post=True))
    values = careers.career_stats()
    values.pop("days_since_last")
    fields = [value.alias(name) for name, value in values.items()]
    return state.select("competitor_id", "date", "contest_id", F.struct(*fields, "last_date", *[f"elo_{t}" for t in _TRACKS]).alias("now"))


def states_as_of(events: DataFrame, states: DataFrame, as_of: str = "as_of") -> DataFrame:
    """``events`` with ``now``: the competitor's state after the last contest strictly before the date ``as_of``.

    Contests and events of a competitor are merged into one order of time; a running
    window carries the latest state to the events behind it.  Windows lie in blocks of
    ``BLOCK_DAYS``, and where a block has no earlier contest the last state of the
    blocks before counts, from a window over one row per competitor and block.  So one
    competitor's rows spread over as many tasks as blocks.  All of this carries the
    (date, contest) of a state; the state itself is looked up once at the end.  Null
    without competitor, date or earlier contest.
    """
    now = F.struct(*[F.col(f"{NOW}{f}").alias(f) for f in states.schema["now"].dataType.names])
    return flat_states_as_of(events, states, as_of).select(*events.columns, F.when(F.col(KNOWN), now).alias("now"))


#: Prefix of the columns that hold a state's fields, and the flag of rows that have a state.
NOW, KNOWN = "now_", "known"


def flat_states_as_of(events: DataFrame, states: DataFrame, as_of: str = "as_of") -> DataFrame:
    """``states_as_of`` with a column per field of the state and the flag ``known``.

    Fields nobody asks for then move nowhere.
    """
    columns, fields = events.columns, states.schema["now"].dataType.names
    held = F.struct("date", "contest_id")

    def block(day: Column) -> Column:
        return F.floor(F.unix_date(day.cast("date")) / BLOCK_DAYS)

    known = states.select(
        "competitor_id", F.col("date").cast("date").alias("day"), block(F.col("date")).alias("block"), F.lit(1).alias("order"),
        "contest_id", held.alias("held"),
    )
    asked = events.select(
        "competitor_id", F.col(as_of).cast("date").alias("day"), block(F.col(as_of)).alias("block"), F.lit(0).alias("order"),
        F.struct(*columns).alias("event"),
    )
    # on one day events come before contests, so a contest of the day itself isn't seen
    running = Window.partitionBy("competitor_id", "block").orderBy("day", "order", "contest_id")
    running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = known.unionByName(asked, allowMissingColumns=True).withColumn("seen", F.last("held", ignorenulls=True).over(running))
    found = merged.filter("order = 0").select("competitor_id", "block", "event", "seen")

    blocks = known.select("competitor_id", "block", "held").unionByName(
        asked.select("competitor_id", "block").distinct(), allowMissingColumns=True
    )
    ends = blocks.groupBy("competitor_id", "block").agg(F.max_by("held", F.struct("held.date", "held.contest_id")).alias("end"))
    earlier = Window.partitionBy("competitor_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("competitor_id").alias("of"), F.col("block").alias("in_block"), F.last("end", ignorenulls=True).over(earlier).alias("carried")
    )
    both = found.join(carried, (F.col("competitor_id") == F.col("of")) & (F.col("block") == F.col("in_block")), "left")
    usable = F.col("event.competitor_id").isNotNull() & F.col(f"event.{as_of}").isNotNull()
    placed = both.select("event", F.when(usable, F.coalesce("seen", "carried")).alias("place"))
    # structs are equal where their nulls are, so a state without a contest's id is found too
    values = [F.col("now")[f].alias(f"{NOW}{f}") for f in fields]
    kept = states.select(F.col("competitor_id").alias("whose"), held.alias("at"), F.col("now").isNotNull().alias(KNOWN), *values)
    kept = kept.dropDuplicates(["whose", "at"])
    mine = (F.col("event.competitor_id") == F.col("whose")) & (F.col("place") == F.col("at"))
    return placed.join(kept, mine, "left").select("event.*", KNOWN, *[f"{NOW}{f}" for f in fields])
