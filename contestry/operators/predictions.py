"""The prediction log: predict cards, merge immutably, grade, summarise, promote."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.labels import class_or_default, inferred_rounds
from contestry.functions.names import folded_name, pair_key
from contestry.functions.probability import brier_term, log_loss_term
from contestry.operators.careers import STAT_NAMES
from contestry.operators.dataset import one_row
from contestry.operators.features import matchup_columns
from contestry.operators.history import KNOWN, NOW, flat_states_as_of
from contestry.operators.resolve import FOLDED, attach_names, nearest_within, with_pair
from contestry.session import materialise

GRADE_WINDOW_DAYS = 3
PROMOTION_MINIMUM = 150
PROMOTION_MARGIN = 0.002
VALIDATION_YEARS = 2

BOUT_KEY = ["event_name", "event_date", "position"]
_BIO = ("height_cm", "reach_cm", "stance", "dob")


def upcoming(events: DataFrame, today: Column, horizon_days: int) -> DataFrame:
    """Events from today to the end of the horizon, both included."""
    return events.filter(F.col("date").between(today, F.date_add(today, horizon_days))).orderBy("date")


def require_events(events: DataFrame) -> None:
    """A schedule that parses to nothing means the page changed."""
    if not events.take(1):
        raise RuntimeError("the schedule parse returned no events")


def empty_cards(events: DataFrame, bouts: DataFrame) -> DataFrame:
    """Events whose card parse returned no bouts: a warning, not an error."""
    return events.join(bouts.select("event_name"), "event_name", "left_anti")


# --- M1: predict ---------------------------------------------------------------


def _corner(number: int, as_of: Column) -> Column:
    """The side struct of one resolved competitor as of a date."""
    now, bio = F.col(f"now_{number}"), F.col(f"bio_{number}")
    flags = {
        "age": F.datediff(as_of, bio["dob"]) / 365.25,
        "reach_missing": bio["reach_cm"].isNull(),
        "dob_missing": bio["dob"].isNull(),
        "southpaw": F.coalesce(bio["stance"] == "Southpaw", F.lit(False)),
        "debut": F.coalesce(now["career_fights"], F.lit(0)) == 0,
    }
    careers = [now[c].alias(c) for c in STAT_NAMES if c != "days_since_last"]
    return F.struct(
        *careers,
        F.datediff(as_of, now["last_date"]).alias("days_since_last"),
        now["elo_overall"].alias("pre_overall"),
        now["elo_striking"].alias("pre_striking"),
        now["elo_grappling"].alias("pre_grappling"),
        now["career_fights"].alias("pre_fights"),
        bio["height_cm"].alias("height_cm"),
        bio["reach_cm"].alias("reach_cm"),
        *[value.alias(name) for name, value in flags.items()],
    )


def matchups(bouts: DataFrame, competitors: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Card rows with resolved ids, both current states, or the reason to skip them.

    With a column ``run`` in both, a bout takes the states of its own run.
    """
    run = ["run"] if "run" in snapshots.columns else []
    named = attach_names(bouts, competitors, "competitor_a_name", "competitor_b_name")
    state = snapshots.join(
        competitors.select("competitor_id", F.struct(*_BIO).alias("bio")),
        "competitor_id",
        "left",
    )
    values = [c for c in snapshots.columns if c not in ("competitor_id", "run")]
    state = state.select("competitor_id", *run, F.struct(*values).alias("now"), "bio")

    def of(number: int) -> DataFrame:
        return state.select(
            *run,
            F.col("competitor_id").alias(f"id_{number}"),
            F.col("now").alias(f"now_{number}"),
            F.col("bio").alias(f"bio_{number}"),
        )

    joined = named.join(of(1), ["id_1", *run], "left").join(of(2), ["id_2", *run], "left")
    return _listed(joined, bouts.columns, [F.col(f"now_{k}").isNotNull() for k in (1, 2)])


def matchups_as_of(bouts: DataFrame, competitors: DataFrame, states: DataFrame, known_before: str = "event_date") -> DataFrame:
    """Like ``matchups``, with each competitor's state strictly before the bout's own date ``known_before``.

    ``states`` are the states after every contest; all dates are served by one merged
    order of time, whatever the number of cards.
    """
    named = attach_names(bouts, competitors, "competitor_a_name", "competitor_b_name")
    sides = F.array(*[F.struct(F.lit(k).alias("number"), F.col(f"id_{k}").alias("competitor_id")) for k in (1, 2)])
    events = named.select(*BOUT_KEY, F.col(known_before).alias("as_of"), F.inline(sides)).filter("competitor_id IS NOT NULL")
    bios = competitors.select("competitor_id", *[F.col(c).alias(f"bio_{c}") for c in _BIO])
    found = flat_states_as_of(events, states).join(bios, "competitor_id", "left")
    # a column per field of each side's state, so that only those asked for move to the bouts
    fields = [c for c in found.columns if c == KNOWN or c.startswith((NOW, "bio_"))]
    folded = found.groupBy(*BOUT_KEY).agg(
        *[F.first(F.when(F.col("number") == k, F.col(c)), ignorenulls=True).alias(f"{c}_{k}") for k in (1, 2) for c in fields]
    )

    def packed(prefix: str, number: int) -> Column:
        return F.struct(*[F.col(f"{c}_{number}").alias(c.removeprefix(prefix)) for c in fields if c.startswith(prefix)])

    joined = named.join(folded, BOUT_KEY, "left")
    structs = {f"{name}_{k}": packed(f"{name}_", k) for k in (1, 2) for name in ("now", "bio")}
    return _listed(joined.withColumns(structs), bouts.columns, [F.coalesce(f"{KNOWN}_{k}", F.lit(False)) for k in (1, 2)])


def _listed(joined: DataFrame, columns: list[str], known: list[Column]) -> DataFrame:
    """Resolved bouts with both states, where ``known``: sides, or the reason to skip them."""
    unmatched = F.col("id_1").isNull() | F.col("id_2").isNull()
    unseen = [
        F.when(~has, F.concat(F.lit("'"), F.col(f"competitor_{s}_name"), F.lit("'"))) for has, s in zip(known, "ab", strict=True)
    ]
    no_history = F.concat(
        F.lit("matched competitor id has no contest history: ["), F.concat_ws(", ", *unseen), F.lit("]")
    )
    reason = F.when(unmatched, F.concat_ws("; ", "reason_1", "reason_2")).when(
        ~(known[0] & known[1]), no_history
    )
    as_of = F.col("event_date")
    title = F.coalesce("title_fight", F.lit(False))
    folded = (F.col("tier_1") == FOLDED) | (F.col("tier_2") == FOLDED)
    return joined.select(
        *columns,
        reason.alias("reason"),
        reason.isNotNull().alias("skipped"),
        F.col("id_1"),
        F.col("id_2"),
        F.when(folded, FOLDED).otherwise("exact").alias("match_tier"),
        title.alias("is_title"),
        inferred_rounds(title, F.col("main_event")).alias("scheduled_rounds"),
        class_or_default(F.col("weight_class")).alias("scored_class"),
        _corner(1, as_of).alias("side_1"),
        _corner(2, as_of).alias("side_2"),
    )


def orientations(ready: DataFrame, *keep: Column) -> DataFrame:
    """Each bout as two feature rows: listed order, and the other way round; ``keep`` comes along."""

    one, two, forward = F.col("side_1"), F.col("side_2"), F.col("orientation") == "ab"
    names = ready.select(F.struct(*matchup_columns(one, two)).alias("m")).schema["m"].dataType.names
    listed, turned = F.struct(*matchup_columns(one, two)), F.struct(*matchup_columns(two, one))
    # only the name of the orientation is multiplied, so what a scorer doesn't read is never computed
    return ready.withColumn("orientation", F.explode(F.array(F.lit("ab"), F.lit("ba")))).select(
        *BOUT_KEY,
        *keep,
        F.col("scored_class").alias("weight_class"),
        F.col("is_title").alias("title_fight"),
        "scheduled_rounds",
        "orientation",
        *[F.when(forward, listed[name]).otherwise(turned[name]).alias(name) for name in names],
    )


METHOD_PROBS = ("ko_tko", "submission", "decision")
ROUND_PROBS = ("1", "2", "3", "45")


def symmetrise(scored: DataFrame, *key: str, count: str | None = None) -> DataFrame:
    """Average both orientations: the win probability flipped, the rest as is; ``count`` names a column for their number."""
    forward = F.col("orientation") == "ab"
    p = F.when(forward, F.col("winner_prob")).otherwise(1.0 - F.col("winner_prob"))
    maps = [c for c in ("method_probs", "round_probs") if c in scored.columns]

    def mean_map(name: str) -> Column:
        classes = METHOD_PROBS if name == "method_probs" else ROUND_PROBS
        pairs = [v for c in classes for v in (F.lit(c), F.avg(F.col(name)[c]))]
        return F.create_map(*pairs).alias(name)

    return scored.groupBy(*key).agg(
        F.avg(p).alias("winner_prob"),
        F.max("winner_spread").alias("winner_spread"),
        F.max(F.when(forward, F.col("winner_prob"))).alias("prob_ab"),
        F.max(F.when(~forward, F.col("winner_prob"))).alias("prob_ba"),
        *[mean_map(c) for c in maps],
        *([F.count("*").alias(count)] if count else []),
    )


def rating_scorer(rows: DataFrame) -> DataFrame:
    """A plain scorer: the rating edge, clipped, and shifts of fixed class shares."""
    edge = F.least(F.greatest(F.col("elo_diff") / 1000.0, F.lit(-0.3)), F.lit(0.3))
    lean = F.least(F.greatest(F.col("striking_elo_diff") / 2000.0, F.lit(-0.1)), F.lit(0.1))
    method = F.create_map(
        F.lit("ko_tko"), 0.3 + lean, F.lit("submission"), 0.2 - lean, F.lit("decision"), F.lit(0.5)
    )
    short = F.col("scheduled_rounds") <= 3
    late = F.when(short, 0.0).otherwise(0.2)
    rounds = F.create_map(
        F.lit("1"), F.when(short, 0.5).otherwise(0.4), F.lit("2"), F.when(short, 0.3).otherwise(0.24),
        F.lit("3"), F.when(short, 0.2).otherwise(0.16), F.lit("45"), late,
    )
    return rows.withColumns(
        {
            "winner_prob": 0.5 + edge,
            "winner_spread": F.abs(edge) / 10.0,
            "method_probs": method,
            "round_probs": rounds,
        }
    )


def predict_cards(
    bouts: DataFrame,
    competitors: DataFrame,
    snapshots: DataFrame,
    scorer: Callable[[DataFrame], DataFrame] = rating_scorer,
) -> DataFrame:
    """One row per bout of all cards: a prediction, or a stub with its reason."""
    return predict_matchups(matchups(bouts, competitors, snapshots), scorer)


def predict_matchups(
    matched: DataFrame, scorer: Callable[[DataFrame], DataFrame] = rating_scorer, detail: bool = False
) -> DataFrame:
    """One row per bout of ``matchups``: a prediction, or a stub with its reason.

    ``detail`` adds the spread and what each orientation gave.
    """
    only_made = {
        "competitor_a_id": F.col("id_1"),
        "competitor_b_id": F.col("id_2"),
        "match_tier": F.col("match_tier"),
        "title_fight": F.col("is_title"),
        "scheduled_rounds": F.col("scheduled_rounds"),
        "elo_a": F.col("side_1.pre_overall"),
        "elo_b": F.col("side_2.pre_overall"),
    }
    # What is listed of a bout rides along with both its rows, so bouts are neither stored
    # nor joined; a skipped one has no sides, and whatever is scored for it isn't shown.
    listed = F.struct(
        "competitor_a_name", "competitor_b_name", "weight_class", "skipped", "reason", *[v.alias(f"made_{n}") for n, v in only_made.items()]
    )
    both = symmetrise(scorer(orientations(matched, listed.alias("bout"))), *BOUT_KEY, "bout", count="n_rows")
    # two bouts alike in all that is listed stay two
    both = both.select("*", F.explode(F.array_repeat(F.lit(0), (F.col("n_rows") / 2).cast("int"))))
    made = ~F.col("bout.skipped")
    keyed = made & F.col("event_name").isNotNull() & F.col("event_date").isNotNull() & F.col("position").isNotNull()
    shown = {n: F.when(made, F.col(f"bout.made_{n}")) for n in only_made}
    scores = {n: F.when(keyed, F.col(c)) for n, c in (("p_a_wins", "winner_prob"), ("method_probs", "method_probs"), ("round_probs", "round_probs"))}
    if detail:
        scores |= {c: F.when(keyed, F.col(c)) for c in ("winner_spread", "prob_ab", "prob_ba")}
    order = [*list(shown)[:5], "p_a_wins", "method_probs", "round_probs", "elo_a", "elo_b", *list(scores)[3:]]
    return both.select(
        *BOUT_KEY,
        *[F.col(f"bout.{c}").alias(c) for c in ("competitor_a_name", "competitor_b_name", "weight_class")],
        *[(shown | scores)[n].alias(n) for n in order],
        F.col("bout.skipped").alias("skipped"),
        F.col("bout.reason").alias("reason"),
    )


def stamped(predicted: DataFrame, predicted_at: Column, version: Column) -> DataFrame:
    return predicted.withColumns({"predicted_at_utc": predicted_at, "model_version": version})


# --- M2, M3: identity and merge ----------------------------------------------------


def with_keys(fights: DataFrame) -> DataFrame:
    """Order-free id pair (null for stubs) and order-free folded name pair."""
    names = [folded_name(F.coalesce(c, F.lit(""))) for c in ("competitor_a_name", "competitor_b_name")]
    return fights.withColumns(
        {
            "id_key": pair_key(F.col("competitor_a_id"), F.col("competitor_b_id")),
            "name_key": pair_key(*names),
        }
    )


EVENT = ["event_name", "event_date"]


def _first_by(rows: DataFrame, key: str) -> DataFrame:
    """The earliest row per event and key, without collecting the copies."""
    first = F.min_by(F.struct(*rows.columns), "position").alias("row")
    return rows.groupBy(*EVENT, F.col(key).alias("_key")).agg(first).select("row.*")


def merge_log(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next snapshot of the log with an ``action`` per row.

    * keep: already in the log;
    * append: a bout not recorded before;
    * replace: a prediction that takes the place of a stub of the same names.

    A recorded prediction never changes.  Of repeated incoming rows the first
    one counts.  An event not in the log yet is written as it comes.  The input
    is left alone; write the result to a fresh folder.
    """
    # Stored, because every step below starts from these keys.
    log = materialise(with_keys(existing), "log-keyed")
    new = materialise(with_keys(incoming), "run-keyed")
    known_events = log.select(*EVENT).distinct()
    fresh_events = new.join(known_events, EVENT, "left_anti").withColumn("action", F.lit("append"))
    update = new.join(known_events, EVENT, "left_semi")

    recorded = log.filter("id_key IS NOT NULL")
    old_stubs = log.filter("id_key IS NULL")

    # Predictions: the first of each id pair counts, and is new unless recorded.
    on_id = [*EVENT, "id_key"]
    on_name = [*EVENT, "name_key"]
    real = materialise(
        _first_by(update.filter("id_key IS NOT NULL"), "id_key").join(recorded.select(*on_id), on_id, "left_anti"),
        "new-predictions",
    )

    # Stubs: the first of each name pair, unless the pair is in the log already.
    stubs = (
        _first_by(update.filter("id_key IS NULL"), "name_key")
        .join(old_stubs.select(*on_name), on_name, "left_anti")
        .join(recorded.select(*on_name), on_name, "left_anti")
    )
    first_real = real.groupBy(*on_name).agg(F.min("position").alias("real_position"))
    # A stub listed after a new prediction of the same names is covered by it; one
    # listed before is written and at once replaced, so it never shows either.
    against_real = stubs.join(first_real, on_name, "left")
    new_stubs = against_real.filter("real_position IS NULL").drop("real_position")
    passing = against_real.filter("real_position > position").select(
        *on_name, F.lit(True).alias("passing")
    )
    replaceable = old_stubs.select(*on_name, F.lit(True).alias("stubbed")).dropDuplicates(on_name)
    placed = (
        real.join(first_real, on_name)
        .join(replaceable, on_name, "left")
        .join(passing, on_name, "left")
    )
    # Only a prediction listed after the passing stub finds it in the log.
    takes_place = (F.col("position") == F.col("real_position")) & (
        F.col("stubbed").isNotNull() | F.col("passing").isNotNull()
    )
    reals = placed.withColumn("action", F.when(takes_place, "replace").otherwise("append")).drop(
        "real_position", "stubbed", "passing"
    )
    # A prediction takes one place: that of the last stub of its names.
    last_stub = old_stubs.groupBy(*on_name).agg(F.max("position").alias("position"))
    replaced = reals.filter("action = 'replace'").select(*on_name).join(last_stub, on_name)
    kept = recorded.unionByName(old_stubs.join(replaced, [*on_name, "position"], "left_anti")).withColumn(
        "action", F.lit("keep")
    )
    parts = [reals, new_stubs.withColumn("action", F.lit("append")), fresh_events]
    merged = kept
    for part in parts:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.drop("id_key", "name_key")


def rows_written(merged: DataFrame) -> DataFrame:
    return merged.groupBy("action").agg(F.count("*").alias("n"))


# --- M4: grade ---------------------------------------------------------------------


def grade(log: DataFrame, contests: DataFrame, today: Column) -> DataFrame:
    """Add grading columns to past, ungraded predictions; all others stay pending."""
    open_rows = with_pair(
        log.filter(
            (F.col("event_date") <= today) & ~F.col("skipped") & F.col("competitor_a_id").isNotNull()
        ),
        "competitor_a_id",
        "competitor_b_id",
    )
    if "actual_winner" in log.columns:
        open_rows = open_rows.filter("actual_winner IS NULL")
    results = with_pair(contests, "competitor_a_id", "competitor_b_id")
    matched = nearest_within(
        open_rows, results, "pair", BOUT_KEY, "event_date", "date", "contest_id", GRADE_WINDOW_DAYS
    )
    outcome = matched.join(
        contests.select(
            "contest_id",
            F.when(F.col("winner") == "a", F.col("competitor_a_id"))
            .when(F.col("winner") == "b", F.col("competitor_b_id"))
            .otherwise("draw")
            .alias("actual_winner"),
        ),
        "contest_id",
    ).select(*BOUT_KEY, "actual_winner")
    plain = log.drop(*[c for c in GRADES if c in log.columns])
    graded = plain.join(outcome, BOUT_KEY, "left").withColumns(_grades())
    if "actual_winner" not in log.columns:
        return graded
    earlier = log.filter("actual_winner IS NOT NULL")
    later = graded.join(earlier.select(*BOUT_KEY), BOUT_KEY, "left_anti")
    return earlier.unionByName(later, allowMissingColumns=True)


GRADES = (
    "actual_winner", "correct", "log_loss_contribution", "brier_contribution", "coin_flip_correct",
    "coin_flip_log_loss_contribution", "coin_flip_brier_contribution", "elo_dummy_correct",
)


def _grades() -> dict[str, Column]:
    winner, a, b, p = (F.col(c) for c in ("actual_winner", "competitor_a_id", "competitor_b_id", "p_a_wins"))
    graded, decided = winner.isNotNull(), winner != "draw"
    y = F.when(winner == "draw", 0.5).when(winner == a, 1.0).otherwise(0.0)
    pick = F.when(p >= 0.5, a).otherwise(b)
    elo_a, elo_b = F.col("elo_a"), F.col("elo_b")
    favourite = F.when(elo_a > elo_b, a).when(elo_a < elo_b, b)
    return {
        "correct": F.when(decided, pick == winner),
        "log_loss_contribution": F.when(graded, log_loss_term(y, p)),
        "brier_contribution": F.when(graded, brier_term(y, p)),
        "coin_flip_correct": F.when(decided, winner == a),
        "coin_flip_log_loss_contribution": F.when(graded, F.lit(math.log(2.0))),
        "coin_flip_brier_contribution": F.when(graded, F.lit(0.25)),
        "elo_dummy_correct": F.when(decided, favourite == winner),
    }


# --- A18, M5: summarise ----------------------------------------------------------------


def track_record(graded: DataFrame) -> DataFrame:
    """Per model version and overall (null version): counts, scores and baselines.

    Versions are summed first; the overall row adds up their few sums, so it is
    there with zero counts even when nothing was predicted.
    """
    kept = graded.filter(~F.coalesce("skipped", F.lit(False)))
    scores = {
        "accuracy": "correct",
        "log_loss": "log_loss_contribution",
        "brier": "brier_contribution",
        "coin_flip_accuracy": "coin_flip_correct",
        "coin_flip_log_loss": "coin_flip_log_loss_contribution",
        "coin_flip_brier": "coin_flip_brier_contribution",
        "elo_dummy_accuracy": "elo_dummy_correct",
    }
    versions = kept.groupBy(F.coalesce("model_version", F.lit("unversioned")).alias("model_version")).agg(
        F.count("*").alias("n_predicted"),
        F.count("actual_winner").alias("n_graded"),
        F.min("predicted_at_utc").alias("first_prediction_at"),
        *[F.sum(F.col(c).cast("double")).alias(f"sum_{name}") for name, c in scores.items()],
        *[F.count(c).alias(f"n_{name}") for name, c in scores.items()],
    )
    counts = ["n_predicted", "n_graded", *[f"n_{name}" for name in scores]]
    overall = versions.agg(
        F.lit(None).cast("string").alias("model_version"),
        F.min("first_prediction_at").alias("first_prediction_at"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        *[F.sum(f"sum_{name}").alias(f"sum_{name}") for name in scores],
    )
    return versions.unionByName(overall).select(
        "model_version",
        "n_predicted",
        "n_graded",
        "first_prediction_at",
        F.col("n_elo_dummy_accuracy").alias("elo_dummy_n"),
        *[
            F.when(F.col(f"n_{name}") > 0, F.col(f"sum_{name}") / F.col(f"n_{name}")).alias(name)
            for name in scores
        ],
    )


def track_record_document(record: DataFrame, generated_at: str) -> DataFrame:
    """The summary as one nested row: overall, by version, baselines."""
    scores = ["n_predicted", "n_graded", "accuracy", "log_loss", "brier"]
    overall = F.col("model_version").isNull()
    baselines = F.struct(
        F.struct(
            F.col("n_graded"),
            F.col("coin_flip_accuracy").alias("accuracy"),
            F.col("coin_flip_log_loss").alias("log_loss"),
            F.col("coin_flip_brier").alias("brier"),
        ).alias("coin_flip"),
        F.struct(F.col("elo_dummy_n").alias("n_graded"), F.col("elo_dummy_accuracy").alias("accuracy")).alias(
            "higher_elo_dummy"
        ),
    )
    # One row per model version, so the collected list is short.
    by_version = F.map_from_entries(
        F.array_sort(
            F.collect_list(
                F.when(~overall, F.struct("model_version", F.struct(*scores, "first_prediction_at")))
            )
        )
    )
    return record.agg(
        F.lit(generated_at).alias("generated_at_utc"),
        F.max(F.when(overall, F.struct(*scores))).alias("overall"),
        by_version.alias("model_versions"),
        F.max(F.when(overall, baselines)).alias("baselines"),
    )


# --- M6, M7: decisions ------------------------------------------------------------------


def refresh_decision(raw_dates: DataFrame, processed: DataFrame) -> DataFrame:
    """Whether the raw table is newer, or else longer, than the processed one.

    Both frames need a ``date`` column, null where it could not be read.
    """
    raw = raw_dates.agg(F.max("date").alias("raw_max"), F.count("*").alias("raw_rows"))
    old = processed.agg(F.max("date").alias("processed_max"), F.count("*").alias("processed_rows"))
    newer = F.col("raw_max") > F.col("processed_max")
    more = F.col("raw_rows") > F.col("processed_rows")

    def day(c: str) -> Column:
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("unknown"))

    def n(c: str) -> Column:
        return F.col(c).cast("string")

    reason = (
        F.when(
            F.col("raw_max").isNull(),
            F.concat(F.lit("raw dates unparseable ("), n("raw_rows"), F.lit(" rows); skipping refresh for safety")),
        )
        .when(
            newer,
            F.concat(
                F.lit("raw max date "), day("raw_max"), F.lit(" is newer than processed max date "), day("processed_max")
            ),
        )
        .when(
            more,
            F.concat(
                F.lit("raw has more rows ("), n("raw_rows"), F.lit(") than processed ("), n("processed_rows"), F.lit(")")
            ),
        )
        .otherwise(
            F.concat(
                F.lit("raw data unchanged: max date "), day("raw_max"), F.lit(" / "), n("raw_rows"),
                F.lit(" rows vs processed max date "), day("processed_max"), F.lit(" / "), n("processed_rows"),
                F.lit(" rows"),
            )
        )
    )
    needed = F.col("raw_max").isNotNull() & (F.coalesce(newer, F.lit(False)) | more)
    return one_row(raw, old).select(needed.alias("needed"), reason.alias("reason"))


def graded_since(graded: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Graded predictions of events strictly after the one-row ``cutoff`` date."""
    done = graded.filter(~F.col("skipped") & F.col("actual_winner").isNotNull())
    return done.filter(F.col("event_date") > cutoff.select("cutoff").scalar())


def promotion_decision(
    graded: DataFrame,
    cutoff: DataFrame,
    scored: DataFrame,
    minimum: int = PROMOTION_MINIMUM,
    margin: float = PROMOTION_MARGIN,
) -> DataFrame:
    """Compare two models on the newest years once enough graded predictions exist.

    ``cutoff`` is one row with the newest date the current model has seen;
    ``scored`` has date, y, p_incumbent and p_candidate.
    """
    n = graded_since(graded, cutoff).agg(F.count("*").alias("n_graded"))
    start = scored.agg(F.add_months(F.max("date"), -12 * VALIDATION_YEARS).alias("start")).scalar()
    window = scored.filter(F.col("date") >= start)
    losses = window.agg(
        F.count("*").alias("n_window"),
        F.avg(log_loss_term(F.col("y"), F.col("p_incumbent"))).alias("incumbent_log_loss"),
        F.avg(log_loss_term(F.col("y"), F.col("p_candidate"))).alias("candidate_log_loss"),
    )
    better = F.col("candidate_log_loss") < F.col("incumbent_log_loss") - margin
    return one_row(n, losses).select(
        "*",
        (F.col("n_graded") >= minimum).alias("enough"),
        ((F.col("n_graded") >= minimum) & better).alias("promote"),
    )
