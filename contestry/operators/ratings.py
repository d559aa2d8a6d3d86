"""Chronological three-track ratings, for one or many parameter sets at once.

A contest depends only on the previous contest of each of its two competitors,
so contests are rated in rounds: a contest is ready when the ratings of both
sides have arrived.  Every rated contest sends each competitor's new ratings to
that competitor's next contest, which was looked up once with a window.  A
round is therefore one shuffle, by contest, of the ratings just sent and of the
contests still waiting.  Each round is written to the shared folder, which cuts
lineage and is the result table.

Contests enter by eras, stretches of days with about one contest for every second
competitor, in order of time.  An era opens once few contests wait, so a contest
moves a round or two and not as often as its chain is long.  Ratings for an era
that is not open stay in the result table and are read there when it opens.

The number of rounds is the longest chain of contests, where each needs the one
before: a long career cannot be computed out of order, and that is in the
definition of the rating.  No round depends on how many contests are left.

All parameter sets advance together: a rating is an array with one value per
set, so a grid search costs the same number of rounds as a single run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contestry.functions import rating as R
from contestry.functions.labels import is_finish
from contestry.functions.probability import log_loss_term
from contestry.operators import careers
from contestry.operators.dataset import contest_totals, decisive, one_row, rated, sides
from contestry.session import COMPRESSION, materialise, scratch_path

TRACKS = ("overall", "striking", "grappling")
# Eras in a competitor's mean career, the most there are, and the share of an era
# that may wait when it opens.
_ERAS_A_CONTEST, _MOST_ERAS, _MAY_WAIT = 2, 64, 0.5


def _ratings_type(tracks: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(t, T.ArrayType(T.DoubleType())) for t in tracks])


def era_ends(contests: DataFrame) -> list[int]:
    """Last day, in days since 1970, of every era but the last one; each has about as many contests."""
    places = [k / _MOST_ERAS for k in range(1, _MOST_ERAS)]
    row = (
        rated(contests)
        .select(F.unix_date(F.to_date("date")).alias("day"), F.explode(F.array("competitor_a_id", "competitor_b_id")).alias("who"))
        .agg(F.count("who").alias("n"), F.approx_count_distinct("who").alias("people"), F.percentile_approx("day", places).alias("days"))
        .first()
    )
    eras = min(_MOST_ERAS, max(1, round(_ERAS_A_CONTEST * row["n"] / max(row["people"], 1))))
    days = row["days"] or []
    return sorted({days[_MOST_ERAS * k // eras - 1] for k in range(1, eras)}) if days else []


def _era(date: Column, ends: Sequence[int]) -> Column:
    """Number of the era of a date: how many eras end before it."""
    day = F.unix_date(F.to_date(date))
    return F.size(F.filter(F.lit(list(ends)).cast("array<int>"), lambda end: end < day)) if ends else F.lit(0)


def prepare(
    contests: DataFrame,
    stats: DataFrame,
    n_sets: int,
    tracks: Sequence[str],
    hot_rows: int,
    ends: Sequence[int],
) -> DataFrame:
    """Rated contests with share, scores, career positions, next-contest pointers and eras."""
    a, b = F.col("competitor_a_id"), F.col("competitor_b_id")
    same = F.concat(F.lit("same competitor on both sides of "), F.col("contest_id"))
    undated = F.concat(F.lit("no date for rated contest "), F.col("contest_id"))
    base = (
        rated(contests)
        .withColumn("date", F.when(F.col("date").isNull(), F.raise_error(undated)).otherwise(F.col("date")))
        .withColumn("competitor_a_id", F.when(a == b, F.raise_error(same)).otherwise(a))
        .join(contest_totals(stats), "contest_id", "left")
        .select(
            "contest_id",
            "date",
            "competitor_a_id",
            "competitor_b_id",
            R.score_of(F.col("winner"), "a").alias("score_a"),
            is_finish(F.col("method")).alias("finish"),
            R.striking_share(*[F.col(c) for c in ("sig_landed", "td_landed", "sub_att", "ctrl_sec")]).alias(
                "share"
            ),
        )
    )
    linked = careers.career_links(
        sides(base, "date").select("contest_id", "date", "side", "competitor_id"), hot_rows
    )

    later = F.struct("next.contest_id", "next.side", _era(F.col("next.date"), ends).alias("era"))
    linked = linked.withColumn("next", F.when(F.col("next").isNotNull(), later))

    def of(side: str) -> list[Column]:
        here = F.col("side") == side
        return [
            F.max(F.when(here, F.col("ordinal"))).alias(f"ordinal_{side}"),
            F.max(F.when(here, F.col("next"))).alias(f"next_{side}"),
        ]

    links = linked.groupBy("contest_id").agg(*of("a"), *of("b"))
    fresh = F.struct(
        *[F.array_repeat(F.lit(R.INITIAL_RATING), n_sets).alias(t) for t in tracks]
    )
    return base.join(links, "contest_id").select(
        "contest_id",
        F.struct(*[c for c in base.columns if c != "contest_id"], *links.columns[1:]).alias("contest"),
        *[F.when(F.col(f"ordinal_{s}") == 1, fresh).alias(f"pre_{s}") for s in "ab"],
        _era(F.col("date"), ends).alias("era"),
    )


def _updated(params: Column, tracks: Sequence[str]) -> list[Column]:
    """post_a and post_b of a row whose contest, pre_a and pre_b are known."""
    contest = F.col("contest")
    weights = {"overall": F.lit(1.0), "striking": contest["share"], "grappling": 1.0 - contest["share"]}

    def post(side: str, track: str) -> Column:
        expected_a = F.zip_with(F.col(f"pre_a.{track}"), F.col(f"pre_b.{track}"), R.expected_score)
        count, score_a = contest[f"ordinal_{side}"] - 1, contest["score_a"]

        def gain(p: Column, e: Column) -> Column:
            k = R.k_factor(count, contest["finish"], p) * weights[track]
            return k * (score_a - e) if side == "a" else k * ((1.0 - score_a) - (1.0 - e))

        gains = F.zip_with(params, expected_a, gain)
        return F.zip_with(F.col(f"pre_{side}.{track}"), gains, lambda r, g: r + g)

    return [F.struct(*[post(s, t).alias(t) for t in tracks]).alias(f"post_{s}") for s in "ab"]


class _Round:
    """The column expressions of a round, built once and used in every round."""

    def __init__(self, params: Sequence[R.RatingParams], tracks: Sequence[str], contest_type: T.DataType):
        params_col = F.array(
            *[F.struct(*[F.lit(v).alias(k) for k, v in asdict(p).items()]) for p in params]
        )
        ready = F.expr("contest IS NOT NULL AND pre_a IS NOT NULL AND pre_b IS NOT NULL")
        posts = _updated(params_col, tracks)
        known = ["contest_id", "contest", "pre_a", "pre_b"]
        rating_type = _ratings_type(tracks)
        self.out_type = T.StructType(
            [T.StructField("contest_id", T.StringType()), T.StructField("contest", contest_type)]
            + [T.StructField(f"{when}_{s}", rating_type) for when in ("pre", "post") for s in "ab"]
            + [T.StructField("done", T.BooleanType())]
        )
        self.update = [
            *[F.col(c) for c in known],
            *[F.when(ready, p).alias(f"post_{s}") for p, s in zip(posts, "ab")],
            ready.alias("done"),
        ]
        # Each value is sent exactly once, so "first non-null" is the only non-null.
        self.merge = [F.first(c, ignorenulls=True).alias(c) for c in known[1:]]

        def message(side: str) -> Column:
            target = F.col(f"contest.next_{side}")
            return F.struct(
                target["contest_id"].alias("contest_id"),
                F.lit(None).cast(contest_type).alias("contest"),
                *[F.when(target["side"] == s, F.col(f"post_{side}")).alias(f"pre_{s}") for s in "ab"],
                target["era"].alias("era"),
            )

        itself = F.struct(*known, F.lit(0).alias("era"))
        self.sent = F.array(message("a"), message("b"))
        self.carried = F.inline(F.when(F.col("done"), self.sent).otherwise(F.array(itself)))
        self.known = known

    def table(self, spark: SparkSession, root: str) -> DataFrame:
        """All rounds written so far, as one partitioned table."""
        schema = T.StructType(self.out_type.fields + [T.StructField("level", T.IntegerType())])
        return spark.read.schema(schema).parquet(root)

    def carry(self, last: DataFrame, opened: int) -> DataFrame:
        """Contests still waiting, and new ratings addressed to next contests of the eras up to ``opened``."""
        return last.select(self.carried).filter((F.col("contest_id").isNotNull()) & (F.col("era") <= opened)).select(*self.known)

    def kept(self, table: DataFrame, era: int) -> DataFrame:
        """Ratings of all rounds so far that are addressed to contests of ``era``."""
        for_era = (F.col("contest.next_a.era") == era) | (F.col("contest.next_b.era") == era)
        return table.filter(F.col("done") & for_era).select(F.inline(self.sent)).filter(F.col("era") == era).select(*self.known)

    def merged(self, parts: DataFrame) -> DataFrame:
        """One row per contest: what is known of it so far."""
        return parts.groupBy("contest_id").agg(*self.merge)


def rate(
    contests: DataFrame,
    stats: DataFrame,
    params: Sequence[R.RatingParams] = (R.TUNED,),
    tracks: Sequence[str] = TRACKS,
    hot_rows: int = careers.HOT_ROWS,
) -> DataFrame:
    """One row per rated contest: the structs contest, pre_a, pre_b, post_a, post_b.

    A rated contest without a date fails, and so does a round that rates nothing
    while contests are left.
    """
    spark = contests.sparkSession
    root = scratch_path(spark, "rounds")
    # Rebalanced by era: one file for a small era, several for a large one.
    plan = prepare(contests, stats, len(params), tracks, hot_rows, era_ends(contests)).hint("rebalance", "era")
    prepared = materialise(plan, "prepared", "era")
    sizes = {row["era"]: row["count"] for row in prepared.groupBy("era").count().collect()}
    closed, n_left = sorted(sizes), sum(sizes.values())
    step = _Round(params, tracks, prepared.schema["contest"].dataType)

    def written(level: int) -> DataFrame:
        return spark.read.schema(step.out_type).parquet(f"{root}/level={level}")

    def state_before(level: int, opened: int, era: int | None) -> DataFrame:
        """What is known of the contests of open eras; ``era`` opens now, those up to ``opened`` were open."""
        fed = prepared.filter(F.col("era") == era).select(*step.known)
        if level == 1:
            return fed
        parts = step.carry(written(level - 1), opened)
        if era is not None:
            parts = parts.unionByName(fed).unionByName(step.kept(step.table(spark, root), era))
        return step.merged(parts)

    level, opened, n_waiting = 0, -1, 0
    while level == 0 or n_left:
        level += 1
        opens = closed and n_waiting <= _MAY_WAIT * sizes[closed[0]]
        era = closed.pop(0) if opens else None
        state = state_before(level, opened, era).select(*step.update)
        state.write.option("compression", COMPRESSION).partitionBy("done").parquet(f"{root}/level={level}")
        n_done = written(level).filter("done").count()  # read off the file footers
        if n_left and not n_done:
            raise RuntimeError(f"{n_left} contests wait for ratings that never come")
        n_left -= n_done
        n_waiting += (0 if era is None else sizes[era]) - n_done
        opened = opened if era is None else era
    return step.table(spark, root).filter("done").drop("done")


def ratings_table(done: DataFrame, set_index: int = 0) -> DataFrame:
    """Two rows per rated contest with the ratings before and after it."""
    tracks = done.schema["pre_a"].dataType.names

    def one(side: str) -> Column:
        contest = F.col("contest")
        values = [
            F.col(f"{when}_{side}.{t}")[set_index].alias(f"{when}_{t}")
            for when in ("pre", "post")
            for t in tracks
        ]
        return F.struct(
            contest["date"].alias("date"),
            contest[f"competitor_{side}_id"].alias("competitor_id"),
            F.lit(side).alias("side"),
            (contest[f"ordinal_{side}"] - 1).alias("pre_fights"),
            *values,
        )

    return done.select("contest_id", F.inline(F.array(one("a"), one("b"))))


def run_elo(contests: DataFrame, stats: DataFrame, params: R.RatingParams = R.TUNED, **options) -> DataFrame:
    return ratings_table(rate(contests, stats, [params], **options))


def prediction_pairs(contests: DataFrame, ratings: DataFrame) -> DataFrame:
    """Decisive contests with both sides' prior ratings, p(a wins) and the outcome."""
    pre = ratings.groupBy("contest_id").agg(
        *[
            F.max(F.when(F.col("side") == s, F.col("pre_overall"))).alias(f"pre_overall_{s}")
            for s in "ab"
        ]
    )
    p_a = R.expected_score(F.col("pre_overall_a"), F.col("pre_overall_b"))
    return (
        decisive(contests)
        .select("contest_id", "date", "winner")
        .join(pre, "contest_id")
        .filter(F.col("pre_overall_a").isNotNull() & F.col("pre_overall_b").isNotNull())
        .select("*", p_a.alias("p_a"), (F.col("winner") == "a").cast("double").alias("y"))
    )


# The tuning grid, in search order.
GRID = {
    "k_early": (40.0, 48.0, 56.0, 64.0),
    "k_late": (24.0, 32.0, 40.0, 48.0),
    "finish_bonus": (1.2, 1.4, 1.6, 1.8),
}


def grid_params() -> list[R.RatingParams]:
    return [
        R.RatingParams(k_early=e, k_late=l, finish_bonus=b)
        for e in GRID["k_early"]
        for l in GRID["k_late"]
        for b in GRID["finish_bonus"]
    ]


def grid_losses(contests: DataFrame, stats: DataFrame, grid: list[R.RatingParams], **options) -> DataFrame:
    """Log-loss of every parameter set over the decisive contests given."""
    done = rate(contests, stats, grid, tracks=("overall",), **options)
    expected = F.zip_with("pre_a.overall", "pre_b.overall", R.expected_score)
    y = F.col("contest.score_a")
    losses = (
        done.filter(y != 0.5)
        .select(y.alias("y"), F.posexplode(expected).alias("grid_index", "p"))
        .groupBy("grid_index")
        .agg(F.avg(log_loss_term(F.col("y"), F.col("p"))).alias("log_loss"))
    )
    rows = [(i, p.k_early, p.k_late, p.early_contests, p.finish_bonus) for i, p in enumerate(grid)]
    names = "grid_index int, k_early double, k_late double, early_contests int, finish_bonus double"
    return losses.join(F.broadcast(losses.sparkSession.createDataFrame(rows, names)), "grid_index")


def first_minimum(losses: DataFrame, loss: str = "log_loss", index: str = "grid_index") -> DataFrame:
    """The row with the smallest loss; the earliest wins a tie."""
    return losses.orderBy(loss, index).limit(1)


def peaks(ratings: DataFrame, competitors: DataFrame, k: int = 10) -> DataFrame:
    """The k highest ratings ever reached, one per competitor, with names."""
    top = (
        ratings.groupBy("competitor_id")
        .agg(F.max("post_overall").alias("peak"))
        .orderBy(F.desc("peak"), "competitor_id")
        .limit(k)
    )
    named = top.join(competitors.select("competitor_id", "name"), "competitor_id", "left")
    return named.select(
        "competitor_id", F.coalesce("name", "competitor_id").alias("name"), F.round("peak", 1).alias("peak")
    )


def trajectory(ratings: DataFrame) -> DataFrame:
    """Every competitor's rating after each contest; average where a date has several."""
    return ratings.groupBy("date", "competitor_id").agg(F.avg("post_overall").alias("post_overall"))


def trajectory_pivot(ratings: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Ratings of the named competitors side by side, one row per date."""
    chosen = ratings.filter(F.col("competitor_id").isin(*ids))
    return chosen.groupBy("date").pivot("competitor_id", list(ids)).agg(F.avg("post_overall"))


def rating_checks(ratings: DataFrame, contests: DataFrame) -> DataFrame:
    """Counts of rows that break the invariants of the ratings table.

    A row follows the row of its competitor with one contest less; joining on
    both columns spreads long careers over all tasks.
    """
    previous = ratings.select(
        "competitor_id", (F.col("pre_fights") + 1).alias("pre_fights"), F.col("post_overall").alias("previous")
    )
    chained = ratings.join(previous, ["competitor_id", "pre_fights"], "left")
    start = F.when(F.col("pre_fights") == 0, R.INITIAL_RATING)
    broken = F.coalesce(F.abs(F.col("pre_overall") - F.coalesce("previous", start)) > 1e-9, F.lit(True))
    rows = chained.agg(
        F.count("*").alias("n_rows"),
        F.count_if(broken).alias("n_broken_chains"),
        F.count_if(~F.col("post_overall").between(1000, 2200)).alias("n_out_of_range"),
    )
    expected = rated(contests).agg((2 * F.count("*")).alias("n_expected"))
    return one_row(rows, expected)
