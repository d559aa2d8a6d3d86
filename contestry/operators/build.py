"""Building the stored tables: gates are measured by the writes themselves, and raise.

An ``Observation`` carries counts out of the job that writes a table, so a gate costs no
second scan of it.  A table that fails its gate has been written to a folder of its
own, but is handed to nobody.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from contestry.operators.dataset import sides
from contestry.operators.predictions import empty_cards, upcoming
from contestry.session import materialise

# The most participants without a row, the least labels known.
MOST_ORPHANS = 0.02
LEAST_COVERAGE = 0.95


class GateError(ValueError):
    """A table broke a rule; ``measured`` has what its write counted."""

    def __init__(self, table: str, failed: Sequence[str], measured: Mapping[str, object]) -> None:
        super().__init__(f"{table}: {', '.join(failed)} in {dict(measured)}")
        self.failed, self.measured = list(failed), dict(measured)


def measured_write(df: DataFrame, label: str, measures: Mapping[str, Column]) -> tuple[DataFrame, dict[str, object]]:
    """The stored table, and the aggregates its write has observed."""
    observation = Observation(label)
    stored = materialise(df.observe(observation, *[m.alias(name) for name, m in measures.items()]), label)
    return stored, dict(observation.get)


def _gate(table: str, measured: Mapping[str, object], broken: Mapping[str, bool]) -> None:
    failed = [name for name, bad in broken.items() if bad]
    if failed:
        raise GateError(table, failed, measured)


def keyed_write(
    df: DataFrame, label: str, keys: Sequence[str], forbidden: Mapping[str, Column] | None = None, more: Mapping[str, Column] | None = None
) -> tuple[DataFrame, dict[str, object]]:
    """Stores rows with a unique key without nulls, none of which is ``forbidden``; fails otherwise.

    Rows are dealt by the key, which later joins on it need as well, and each carries
    how many share its key until it is written.
    """
    copies = F.count("*").over(Window.partitionBy(*keys))
    forbidden = forbidden or {}
    measures = {
        "rows": F.count("*"),
        "missing_keys": F.count_if(_any_null(keys)),
        "repeated_keys": F.count_if(F.col("_copies") > 1),
        **{name: F.count_if(F.coalesce(bad, F.lit(False))) for name, bad in forbidden.items()},
        **(more or {}),
    }
    observation = Observation(label)
    counted = df.withColumn("_copies", copies).observe(observation, *[m.alias(name) for name, m in measures.items()])
    stored = materialise(counted.drop("_copies"), label)
    measured = dict(observation.get)
    _gate(label, measured, {n: bool(measured[n]) for n in ("missing_keys", "repeated_keys", *forbidden)})
    return stored, measured


def _any_null(columns: Sequence[str]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNull()
    return found


def store_competitors(competitors: DataFrame) -> DataFrame:
    """The competitors by unique id."""
    return keyed_write(competitors, "competitors", ["competitor_id"])[0]


def _covered(column: str) -> Column:
    return F.avg(F.col(column).isNotNull().cast("double"))


def store_contests(contests: DataFrame) -> tuple[DataFrame, dict[str, object]]:
    """The contests by unique id with two different sides, and what their write measured."""
    a, b = F.col("competitor_a_id"), F.col("competitor_b_id")
    return keyed_write(
        contests,
        "contests",
        ["contest_id"],
        {"missing_sides": a.isNull() | b.isNull(), "same_competitor": a == b},
        {
            "bad_dates": F.count_if(F.col("date").isNull()),
            "method_coverage": _covered("method"),
            "class_coverage": _covered("weight_class"),
        },
    )


def store_stats(stats: DataFrame) -> tuple[DataFrame, dict[str, object]]:
    """The side statistics by contest and side, and what their write measured."""
    return keyed_write(stats, "stats", ["contest_id", "side"])


def store_dataset(
    contests: DataFrame, stats: DataFrame, competitors: DataFrame,
    most_orphans: float = MOST_ORPHANS, least_coverage: float = LEAST_COVERAGE,
) -> dict[str, DataFrame]:
    """All three tables, or a ``GateError`` of the first rule that does not hold.

    Keys and sides per table; then over the batch: every date is parsed, statistics have
    two rows a contest, few participants lack a competitor, most methods and classes are
    known.  A batch without contests has no coverage and fails.
    """
    known = store_competitors(competitors)
    stored, of_contests = store_contests(contests)
    side_rows, of_stats = store_stats(stats)
    ids = sides(stored).select("competitor_id").distinct()
    flagged = ids.join(known.select("competitor_id", F.lit(True).alias("known")), "competitor_id", "left")
    participants, of_ids = measured_write(flagged, "participants", {"n": F.count("*"), "orphans": F.count_if(F.col("known").isNull())})
    measured = {**of_contests, "stats_rows": of_stats["rows"], "participants": of_ids["n"], "orphans": of_ids["orphans"]}
    _gate(
        "dataset",
        measured,
        {
            "unparsed dates": bool(measured["bad_dates"]),
            "statistics are not two rows a contest": measured["stats_rows"] != 2 * measured["rows"],
            "participants without competitor": not (measured["orphans"] < most_orphans * measured["participants"]),
            "unknown methods": not ((measured["method_coverage"] or 0.0) > least_coverage),
            "unknown classes": not ((measured["class_coverage"] or 0.0) > least_coverage),
        },
    )
    return {"contests": stored, "stats": side_rows, "competitors": known, "participants": participants}


def store_upcoming(events: DataFrame, bouts: DataFrame, today: Column, horizon_days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, bouts, events without bouts) of the horizon, events stored.

    A schedule without any event fails, as then its page has changed; an event whose
    card has no bouts is only listed.
    """
    schedule, counted = measured_write(events, "schedule", {"n": F.count("*")})
    _gate("schedule", counted, {"no events": not counted["n"]})
    near = upcoming(schedule, today, horizon_days)
    return near, bouts.join(near.select("event_name"), "event_name", "left_semi"), empty_cards(near, bouts)
